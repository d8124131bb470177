import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from groundmark.llm import simhash
from groundmark.llm.components import components


def union(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_print(text, words=4):
    found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_hash_is_that_of_spark(spark):
    assert spark.sql("select xxhash64('a b c d')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_near_duplicates_against_brute_force(docs, rows):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    prints = {i: brute_print(t) for i, t, *_ in rows}
    assert {r["doc_id"]: r["fp"] % 2**64 for r in found} == prints
    ids = [i for i in prints if i is not None]
    near = [(a, b) for a, b in itertools.combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = union(ids, near)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == want


@pytest.mark.parametrize("hot", [20_000, 4])
def test_links_join_every_near_pair(spark, hot):
    rng = random.Random(2)
    prints = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for bit in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << bit
            prints.add(x)
    near = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 4]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, 4, hot).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    assert union(prints, links) == union(prints, near)


def test_forest_is_small_and_whole():
    rng = np.random.default_rng(1)
    prints = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)))
    a, b = simhash.forest(prints, 2)
    assert len(a) == len(prints) - 1
    assert len(set(union(prints.tolist(), zip(a.tolist(), b.tolist())).values())) == 1


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (None, 3), (7, None)]
    random.Random(3).shuffle(chain)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1200)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

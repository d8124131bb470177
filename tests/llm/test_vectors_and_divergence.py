import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundmark.llm import divergence, queries, stable_knn, whitening
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


# neighbours


def brute(rows, k, every):
    """Exact neighbours: {query: [(id, score)]} of rows (id, vector) that take part."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            score = (x * x[i]).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
            out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found_by(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def frame(spark, rows, extra="x"):
    return spark.createDataFrame([(i, v, extra) for i, v in rows], "vec_id long, embedding array<float>, cell string")


@pytest.mark.parametrize("shape", ["unit", "lengths", "clusters"])
def test_recall_against_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24))
    if shape == "clusters":
        x = x * 0.2 + rng.standard_normal((30, 24))[rng.integers(0, 30, 3000)]
    if shape != "lengths":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute(rows, 20, 20), found_by(stable_knn.nearest(frame(spark, rows)))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = {(q, i): s for q in want for i, s in want[q]}
    for q, near in got.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        assert all(s == pytest.approx(exact[q, i], abs=1e-12) for i, s in near if (q, i) in exact)


def test_copies_tie_by_id_and_lose_none(spark):
    rng = np.random.default_rng(5)
    one = (rng.standard_normal(8)).tolist()
    rows = [(i, one if i % 3 else rng.standard_normal(8).tolist()) for i in range(900)]
    want, got = brute(rows, 20, 20), found_by(stable_knn.nearest(frame(spark, rows)))
    for q in want:
        if q % 3:  # asks with the common vector: its copies, smallest ids first, unless longer ones score more
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_neighbours_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
        (8, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (1, [1.0, 1.0]), (40, [-1.0, 0.0]), (40, [0.5, 0.5]),
    ]
    got = found_by(stable_knn.nearest(frame(spark, rows)))
    assert got[0] == [(1, 1.0), (40, 0.5), (20, 0.0)]
    assert got[20] == [(1, 2.0), (40, 1.0), (0, 0.0)]
    assert got[40] == [(1, 1.0), (20, 1.0), (0, 0.5)]
    assert set(got) == {0, 20, 40}


def test_neighbours_of_few_or_no_rows(spark):
    assert stable_knn.nearest(frame(spark, [])).collect() == []
    assert stable_knn.nearest(frame(spark, [(0, [1.0])])).collect() == []
    assert stable_knn.nearest(frame(spark, [(0, None), (20, [0.0])])).collect() == []
    assert found_by(stable_knn.nearest(frame(spark, [(0, [1.0]), (3, [2.0])]))) == {0: [(3, 2.0)]}


def test_chi_square_quantile_and_leaves():
    assert stable_knn.chi_square_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3)
    assert stable_knn.chi_square_quantile(0.5, 2) == pytest.approx(1.3863, abs=1e-4)
    points = np.random.default_rng(1).standard_normal((1000, 3))
    order, starts = stable_knn.leaves_of(points, 16)
    assert sorted(order) == list(range(1000)) and np.diff(starts).max() <= 16 and starts[-1] == 1000
    same, ends = stable_knn.leaves_of(np.zeros((100, 3)), 16)
    assert sorted(same) == list(range(100)) and np.diff(ends).max() <= 16


# whitening


def test_whitening_against_exact_arithmetic(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").limit(120)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    rows += [(10_000, rows[0][1]), (10_001, rows[0][1])]
    found = whitening.whitened(frame(spark, rows)).collect()
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(dims)]
    cov = np.array([[float(Fraction(sum(v[a] * v[b] for v in fit) * n - sums[a] * sums[b], n * n)) for b in range(dims)] for a in range(dims)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    assert len(found) == 16 * len(rows)
    by = {}
    for r in found:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x[r["vec_id"]], sums)) == int(r["deviation_exact"])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
        by.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
    for k, got in by.items():
        want = {i: sum((c - s / n) * a for c, s, a in zip(v, sums, axes[:, k - 1])) / values[k - 1] ** 0.5 for i, v in x.items()}
        sign = 1 if want[rows[0][0]] * got[rows[0][0]] > 0 else -1
        assert all(got[i] == pytest.approx(sign * want[i], abs=1e-7) for i in want)
        assert got[10_000] == got[10_001] == got[rows[0][0]]


def test_whitening_of_odd_few_and_no_rows(spark):
    odd = [(2, None), (3, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("-inf"), 1.0]), (8, [1.0, 2.0, 3.0])]
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [*odd, (1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # one distinct vector spreads over nothing
    found = whitening.whitened(frame(spark, [*odd, (1, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [3.0, 2.0])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], abs(r["whitened"]), r["explained"]) for r in sorted(found, key=lambda r: r["vec_id"] or 0)] == [(None, 1, 2, 1.0, 1.0), (1, 1, 2, 1.0, 1.0), (4, 1, 2, 1.0, 1.0)]


def test_huge_entries_stay_exact(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])]
    found = whitening.whitened(frame(spark, rows)).collect()
    top = 2**61
    steps = {1: (top, 64), 2: (-top, 128), 3: (0, 320)}
    sums = [sum(v[k] for v in steps.values()) for k in range(2)]
    for r in found:
        want = sum((3 * c - s) ** 2 for c, s in zip(steps[r["vec_id"]], sums))
        assert int(r["deviation_exact"]) == want and r["deviation"] == (want if want < 2**63 else None)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**61), 2**61), min_size=3, max_size=3), min_size=1, max_size=6), st.integers(0, 60))
def test_products_and_digits_are_exact(rows, shrink):
    rows = [[v >> shrink for v in r] for r in rows]
    got = whitening.products(np.array(rows, np.int64))
    wide = [[1, *r] for r in rows]
    assert got == [[sum(r[a] * r[b] for r in wide) for b in range(4)] for a in range(4)]
    for value in (v for row in got for v in row):
        assert sum(d << (32 * k) for k, d in enumerate(whitening.digits(int(value)))) == value


# divergence


def test_divergence_equals_its_sql(spark):
    name = "op12_source_divergence"
    assert differences(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) == []


def counted_by_hand(rows, least):
    import re
    from collections import Counter

    langs = {}
    for text, lang, source in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        docs, groups = langs.setdefault(lang or "", (Counter(), {}))
        docs.update(set(words))
        groups.setdefault(source or "", Counter()).update(words)
    out = []
    for lang, (docs, groups) in langs.items():
        kept = [t for t, n in docs.items() if n >= least]
        share = lambda c, n: 1 + 1_000_000_000 * (c + 5) // (n + 5 * len(kept))  # noqa: E731, B023
        total = Counter()
        for g in groups.values():
            total.update({t: g[t] for t in kept})
        p = {s: {t: share(g[t], sum(g[t] for t in kept)) for t in kept} for s, g in groups.items()}
        q = {t: share(total[t], sum(total.values())) for t in kept}
        for s in groups:
            parts = [("pair", o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [("term", t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, limit in ((parts, None), (terms, 50)):
                for rank, (kind, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:limit], 1):
                    out.append((lang, s, kind, item, value, rank))
    return sorted(out)


def test_divergence_of_odd_rows_against_counting_by_hand(spark, docs, rows, no_docs):
    assert divergence.audit(no_docs).collect() == []
    got = sorted(map(tuple, divergence.audit(docs, least_documents=3).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == counted_by_hand([(t, lang, s) for _, t, lang, s, _ in rows], 3)


def test_divergence_with_like_terms_many_sources_and_none_kept(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Aa", "bb", "ÇÇ", "dd", "ee"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    data = [(t, rng.choice(["en", None, "xx"]), rng.choice(["s1", "s2", None, "hot", "hot", "hot"])) for t in texts] + [("rare only", "lonely", "s1")]
    df = spark.createDataFrame(data, "text string, lang string, source string").repartition(7)
    got = sorted(map(tuple, divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == counted_by_hand(data, 30)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 10**13), min_size=1, max_size=5), st.integers(1, 10**4))
def test_shares_are_exact(counts, vocabulary):
    total = sum(counts) + 5 * vocabulary + 5 * len(counts)
    got = divergence.shares(np.array(counts, np.int64), np.array([total], np.int64))
    assert got.tolist() == [1 + 1_000_000_000 * (c + 5) // total for c in counts]


def test_share_columns_are_exact(spark):
    rows = [(3, 17), (10**13, 3 * 10**13), (0, 10**15)]
    got = spark.createDataFrame(rows, "c long, t long").select(divergence.share(F.col("c"), F.col("t")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 1_000_000_000 * (c + 5) // t for c, t in rows]


def test_terms_are_not_broadcast(spark):
    docs = spark.createDataFrame([(f"common own{'abc'[k % 3]}", "en", f"s{k % 3}") for k in range(30)], "text string, lang string, source string")
    found = divergence.audit(docs, least_documents=2)
    joins = [x.split("], [")[0] for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in x]
    assert [x.split("Join")[0].split()[-1] for x in joins if "vector" in x] == ["SortMerge"], joins
    assert {(r["source"], r["item"]) for r in found.filter("part = 'term'").collect()} == {(f"s{k}", f"own{c}") for k, c in enumerate("abc")}

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundmark.llm import packing, repair, token_counts
from groundmark.llm.tokens import byte_table, sentence_table, vocabulary

BYTE, PIECE = byte_table(vocabulary("byte_bpe_50k.json")), sentence_table(vocabulary("piece_bpe_32k.model"))
TEXT = st.text(st.sampled_from("ab \n\t'sé中▁😀1.!,\xa0\x1c\x85\x02"), max_size=20) | st.text(max_size=30)


def whole_byte(text):
    return BYTE.tokenizer.encode(text, add_special_tokens=False).ids


def whole_piece(text):
    return PIECE.processor.encode(text, num_threads=1)


@pytest.mark.parametrize("codec,whole", [(BYTE, whole_byte), (PIECE, whole_piece)])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=6))
def test_pieces_between_spaces_give_the_ids_of_the_whole_text(codec, whole, texts):
    texts = [x.encode("utf-8", "replace").decode() for x in texts] + ["a <|endoftext|> b"]
    ids, counts = codec.tokens(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [whole(x) for x in texts]


def test_cache_starts_anew_without_changing_ids():
    small = type(BYTE)(vocabulary("byte_bpe_50k.json"), limit=5)
    for text in ("one two three four five six seven", "eight nine ten", "one two three"):
        assert small.tokens([text])[0].tolist() == whole_byte(text)


def test_a_word_is_one_key_with_all_signs_behind_it():
    codec = type(BYTE)(vocabulary("byte_bpe_50k.json"))
    texts = ["word, other word. word*** (word) don't! don't word\nword; 1.5, 1.5 é? é", "a word\u0301, ٣.中! ×, x's."]
    ids, counts = codec.tokens(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [whole_byte(x) for x in texts]
    words = [k for k in codec.slots if k.startswith("word")]
    assert sorted(words) == ["word", "word\u0301,"]  # the mark is no letter, so its sign may be one pre-token with it


def test_a_full_cache_keeps_what_is_used_again():
    codec = type(BYTE)(vocabulary("byte_bpe_50k.json"), limit=40)
    encoded = []
    plain = codec.encode
    codec.encode = lambda keys: encoded.extend(keys) or plain(keys)
    for i in range(60):
        text = f"often again w{i}a w{i}b w{i}c w{i}d"
        assert codec.tokens([text])[0].tolist() == whole_byte(text)
    assert len(codec.slots) <= 50 and encoded.count("again") == 1


def expected_counts(rows):
    return sorted(((i, len((t or "").encode()), len(whole_piece(t or ""))) for i, t, *_ in rows), key=str)


@pytest.mark.parametrize("buckets", [1, 7])
def test_token_counts_match_the_library(docs, rows, buckets):
    found = token_counts.count_tokens(docs, "piece_bpe_32k.model", buckets).collect()
    assert sorted(map(tuple, found), key=str) == expected_counts(rows)


def test_token_counts_with_byte_vocabulary_and_empty_table(docs, rows, no_docs):
    found = token_counts.count_tokens(docs, "byte_bpe_50k.json", 3).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in found) == sorted((str(i), len(whole_byte(t or ""))) for i, t, *_ in rows)
    assert token_counts.count_tokens(no_docs, "piece_bpe_32k.model").collect() == []


def documents_in_order(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, out = 0, []
    for i, text, *_ in ordered:
        ids = np.array([*whole_byte(text or ""), 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_shards_read_back_as_written(docs, rows, no_docs):
    found = repair.read_shards(repair.write_shards(docs)).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == documents_in_order(rows)
    assert repair.read_shards(repair.write_shards(no_docs)).collect() == []


def pairs_of(symbols):
    """Neighbouring symbols without the end id of the document."""
    return list(zip(symbols[:-1], symbols[1:-1]))


def test_no_frequent_pair_is_left_in_a_large_shard():
    rng = np.random.default_rng(2)
    passage = rng.integers(3, 50_000, 400)
    documents = [np.concatenate((rng.zipf(1.3, 300) % 50_000 + 3, passage)) for _ in range(60)]
    ids = np.concatenate([np.append(x, 2) for x in documents]).astype(np.uint32)
    counts = np.array([len(x) + 1 for x in documents])
    shard = repair.Shard(repair.compress(ids, counts, 60_000))
    assert (shard.decode_all() == ids).all()
    left = [p for i in range(len(shard)) for p in pairs_of(shard.symbols[shard.places[i] : shard.places[i + 1]].tolist())]
    assert max(Counter(left).values()) < repair.LEAST
    assert shard.lengths.max() >= 200  # the passage became a few symbols


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(3, 9), max_size=60), min_size=1, max_size=8), st.integers(1, 6), st.integers(2, 5))
def test_grammar_round_trip_and_random_access(documents, rules, least):
    documents = [[*x, 2] for x in documents]
    ids = np.array([i for x in documents for i in x], np.uint32)
    shard = repair.Shard(repair.compress(ids, np.array([len(x) for x in documents]), 10, rules=rules, least=least))
    left = [p for i in range(len(shard)) for p in pairs_of(shard.symbols[shard.places[i] : shard.places[i + 1]].tolist())]
    assert max(Counter(left).values(), default=0) < least
    assert shard.decode_all().tolist() == ids.tolist()
    for k, x in enumerate(documents):
        assert shard.decode(k).tolist() == x
        assert [shard.token(k, i) for i in range(len(x))] == x


def test_grammar_compresses_repeats_and_needs_wide_symbols():
    ids = np.tile(np.array([5, 6, 7, 8, 9, 10, 11, 12], np.uint32), 4000)
    ids[-1] = 2
    data = repair.compress(ids, np.array([len(ids)]), 70_000)
    shard = repair.Shard(data)
    assert len(shard.symbols) < len(ids) / 6 and len(data) < len(ids)
    assert (shard.decode(0) == ids).all()


def check_packing(found, rows, size):
    want = {}
    for i, text, *_ in rows:
        ids = np.array([*whole_byte(text or ""), 2], "<u4")
        n = -(-len(ids) // size)
        cut = [0, *(len(ids) - size * (n - 1 - k) for k in range(n))]
        for k in range(n):
            part = ids[cut[k] : cut[k + 1]]
            key = (i, k, cut[k], len(part), zlib.crc32(part.tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in found:
        got[tuple(r)[:5]] = got.get(tuple(r)[:5], 0) + 1
    assert got == want
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


@pytest.mark.parametrize("size", [64, 1024])
def test_packing_is_gapless_and_near_the_bound(docs, rows, size):
    found = packing.pack(docs, size=size).collect()
    n = check_packing(found, rows, size)
    bound = -(-sum(r["length"] for r in found) // size)
    assert bound <= n <= bound * 1.02 + 2


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), max_size=12))
def test_plan_holds_the_demand_and_is_about_as_good_as_best_fit(lengths):
    demand = np.zeros(41, np.int64)
    for length, n in lengths.items():
        demand[length] = n
    chosen = packing.plan(demand, 40)
    held = np.zeros(41, np.int64)
    for config, times in chosen:
        assert sum(a * b for a, b in config) <= 40
        for length, n in config:
            held[length] += n * times
    assert (held == demand).all()
    rest = demand.copy()
    rest[40] = 0
    assert sum(t for _, t in chosen) <= demand[40] + sum(t for _, t in packing.best_fit(rest, 40)) + 1


def test_knapsack_against_all_configurations():
    from itertools import product

    values = np.zeros(11)
    values[[2, 3, 5]] = 0.3, 0.5, 0.8
    best = max(a * 0.3 + b * 0.5 + c * 0.8 for a, b, c in product(range(6), range(4), range(3)) if 2 * a + 3 * b + 5 * c <= 10)
    worth, pick = packing.knapsack(values, 10)
    config = packing.filling(pick, 10)
    assert sum(values[x] * n for x, n in config.items()) == pytest.approx(best) == worth[10]
    assert sum(x * n for x, n in config.items()) <= 10


@pytest.mark.parametrize("scale", [1, 50])
def test_the_program_is_solved_and_places_most_pieces(scale):
    rng = np.random.default_rng(3)
    demand = scale * np.bincount(np.minimum(1 + rng.exponential(90, 4000).astype(int), 255), minlength=257)
    amounts, bound = packing.configurations(demand, 256)
    held = np.zeros(257)
    for config, amount in amounts.items():
        assert sum(x * n for x, n in config) <= 256
        for length, n in config:
            held[length] += n * amount
    assert (held >= demand * (1 - 1e-9)).all()
    assert bound <= sum(amounts.values()) <= bound * (1 + packing.GAP + 1e-9)
    assert bound >= (demand @ np.arange(257)) / 256 - 1e-6
    chosen, rest = packing.rounded(demand, 256)
    assert rest.min() >= 0 and rest.sum() <= 0.3 * demand.sum()
    assert sum(t for _, t in packing.plan(demand, 256)) <= 1.01 * bound + 2


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), max_size=12))
def test_plan_is_never_worse_than_best_fit(lengths):
    demand = np.zeros(41, np.int64)
    for length, n in lengths.items():
        demand[length] = n
    rest = demand.copy()
    rest[40] = 0
    assert sum(t for _, t in packing.plan(demand, 40)) <= demand[40] + sum(t for _, t in packing.best_fit(rest, 40))


@pytest.mark.parametrize("demand", [{10: 8, 21: 128}, {4: 181, 8: 270, 22: 55, 33: 253, 35: 290}])
def test_small_demands_need_no_more_than_best_fit_with_the_program(demand):
    wanted = np.zeros(41, np.int64)
    for length, n in demand.items():
        wanted[length] = n
    chosen, rest = packing.rounded(wanted, 40)
    assert chosen and sum(t for _, t in packing.best_fit(rest, 40, chosen)) <= sum(t for _, t in packing.best_fit(wanted, 40))

"""Near-duplicate documents by SimHash, found through deletion variants of few, wide segments.

A fingerprint has 64 bits: the majority of the XXH64 values (seed 42) of a text's word shingles. Documents with one
fingerprint are one class, so copies are never paired. With K differing bits allowed, a fingerprint is cut into
K // 2 + 1 segments: two that differ in at most K bits have one segment in which they differ in at most one. Every
segment is indexed under its variants with one bit blanked; two such segments share at least one variant, so an
equality join on the variants loses no link. The members of a variant are verified by their differing bits and linked
in a spanning forest (at most one link a member), never as all pairs. A variant with more than `hot` members is cut into
blocks, and every pair of blocks is one task's work, so none grows beyond two blocks; this is exact at any size.

Nulls: a null text has no words, so fingerprint zero, linked like any other; an empty or blank text likewise. A null
doc_id is kept, in the component of its fingerprint, but never names one unless the component has no other. Repeated
rows give repeated rows; an empty table an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, strings, table
from .components import components

BITS = 64
#: Bytes with A-Z as a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text with A-Z in lower case; short texts are one shingle."""
    from xxhash import xxh64_intdigest

    found = text.encode().translate(LOWER).split()
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), 42)] if found else [], np.uint64)
    data = b" ".join(found)
    ends = (np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1).tolist()
    starts = [0, *(x + 1 for x in ends[:-words])]
    return np.array([xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero without hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([majority(shingle_hashes(x, words)) for x in strings(batch.column("text"))], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_fingerprints(words), "doc_id long, fp long")


def segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments for links of at most `bits` differing bits."""
    n = bits // 2 + 1
    edges = [round(k * BITS / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _cut(shift: int, width: int):
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))


def variants(prints: DataFrame, bits: int) -> DataFrame:
    """(key, fp): every fingerprint under each segment with one bit blanked. A key holds bit position and the rest."""
    keys = []
    for shift, width in segments(bits):
        for i in range(width):
            place = shift + i
            keys.append(_cut(shift, width).bitwiseAND(F.lit(~(1 << i))).bitwiseOR(F.lit(place << 48)))
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all members within `bits` differing bits of each other, one a member at most.

    Breadth-first: the members not yet reached are compared with one that is, so near copies are left out early.
    """
    rest, left, right = prints, [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = _popcount(rest ^ at) <= bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left.append(np.full(len(found), at))
                right.append(found)
                front.extend(found)
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _links(bits: int):
    """Links of each run of rows with one key; a partition is sorted by key and read batch by batch."""

    def verify(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(first, append=len(keys))
        out = []
        two = first[sizes == 2]  # by far the most: no call for each of them
        near = _popcount(prints[two] ^ prints[two + 1]) <= bits
        out.append((prints[two][near], prints[two + 1][near]))
        for a, n in zip(first[sizes > 2], sizes[sizes > 2]):
            out.append(forest(prints[a : a + n], bits))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((held_keys, batch.column("key").to_numpy()))
            prints = np.concatenate((held, batch.column("fp").to_numpy().view(np.uint64)))
            if not len(keys):
                continue
            end = np.searchsorted(keys == keys[-1], True)
            a, b = verify(keys[:end], prints[:end])
            held_keys, held = keys[end:], prints[end:]
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        a, b = verify(held_keys, held)
        yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def _cooled(keyed: DataFrame, prints: DataFrame, bits: int, hot: int) -> DataFrame:
    """`keyed` with the keys that may have over `hot` members dealt out over pairs of blocks.

    A key's members have one of two values of its segment; if it has over `hot`, one value has over half of that.
    """
    each = [F.struct(F.lit(shift).alias("shift"), _cut(shift, width).alias("value")) for shift, width in segments(bits)]
    many = prints.select(F.explode(F.array(*each)).alias("x")).select("x.*").groupBy("shift", "value").agg(F.count("*").alias("n")).filter(F.col("n") > hot // 2)
    many = materialise(many, "hot-segments")
    if many.isEmpty():
        return keyed
    widths = F.create_map(*(F.lit(x) for pair in segments(bits) for x in pair))[F.col("shift")]
    place = F.explode(F.sequence(F.lit(0), widths - 1))
    hot_keys = many.select("shift", "value", "n", place.alias("i")).select(
        F.expr("(value & ~shiftleft(1L, i)) | shiftleft(cast(shift + i as bigint), 48)").alias("key"),
        F.ceil(F.col("n") * 2 / hot).alias("blocks"),
    )
    hot_keys = hot_keys.groupBy("key").agg((F.sum("blocks") + 1).alias("blocks"))
    dealt = keyed.join(hot_keys, "key", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), "blocks")))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", "fp", "own", other.alias("other"))
    # a pair of blocks, itself included, becomes a key of its own
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(F.when(F.col("other") < 0, F.col("key")).otherwise(pair).alias("key"), "fp")


def links(prints: DataFrame, bits: int = 4, hot: int = 20_000) -> DataFrame:
    """(a, b) of distinct fingerprints, enough to join all that are within `bits` differing bits of each other.

    `prints` has distinct fp. Members that a hash brings under one key besides are compared and cost only time.
    """
    keyed = _cooled(variants(prints, bits), prints, bits, hot)
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, hot: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs`: component_id is the smallest doc_id of the reachable ones."""
    prints = materialise(fingerprints(docs, words), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    joined = components(links(classes.select("fp"), bits, hot), "simhash")
    named = classes.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = named.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`near_duplicates` over all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

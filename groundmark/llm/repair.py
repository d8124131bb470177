"""Token ids of whole texts in grammar-compressed shards, by Re-Pair, with random access.

Documents are range-partitioned and sorted by doc_id; each partition writes shards of about `SHARD` characters in order. A
shard replaces frequent pairs of neighbouring symbols by new symbols, round after round, until no pair occurs `LEAST` times:
the pairs are counted exactly, the most frequent become rules, and all their occurrences that do not overlap are replaced
at once. No rule holds the end id of a document, so every document starts at a symbol of its own. A shard holds the rules
as pairs of symbols, how many ids each rule expands to, the symbols, and for each document where its symbols and its ids
begin. `decode` expands a document, `token` one id of it, without touching the rest of the shard.

Shards are rows of a Parquet table (partition, number in it, first doc_ids, blob); their order is that of the ids.
Nulls: a null text is empty (its end id only); a null doc_id comes before all others, rows with one doc_id are ordered by
a hash of their text, over more than one partition if they are many, and each row is a document. An empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, ragged, shuffle_partitions, slices, strings, table
from .packing import with_end
from .tokens import byte_table, vocabulary

VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Characters of a shard, about four ids to ten of them.
SHARD = 4_000_000
#: Rules of a round at most, and how often a pair occurs at least to become one.
RULES, LEAST = 4500, 8
SLOT_BITS = 18
HEAD = struct.Struct("<4sIIIIII")
MAGIC = b"GRP1"


def _count(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    ordered = np.sort(pairs)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def grammar_of(ids: np.ndarray, base: int, end: int, rules: int = RULES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Rules as pairs of symbols, and the symbols that are left, in which no pair without `end` occurs `least` times.

    Each round counts the pairs exactly and replaces up to `rules` of the most frequent at once; of two that would share
    a slot of the table by which their occurrences are found, one waits for the next round. A pair that is rare stays
    rare unless it holds a new symbol, so each round looks only at frequent pairs and at those beside new symbols.
    """
    seq = ids.astype(np.uint32)
    grammar: list[np.ndarray] = []
    size = base
    may = np.ones(max(0, len(seq) - 1), bool)  # pairs, by their first place, that may be frequent
    while may.any():
        may &= (seq[:-1] != end) & (seq[1:] != end)
        at = np.flatnonzero(may)
        if not len(at):
            break
        pairs = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        narrow = size <= 1 << 16
        names, counts = _count((seq[at] << np.uint32(16)) | seq[at + 1] if narrow else pairs)
        often = counts >= least
        names, counts = names[often].astype(np.uint64), counts[often]
        if narrow:
            names = (names >> np.uint64(16)) << np.uint64(32) | (names & np.uint64(0xFFFF))
        if not len(names):
            break
        top = names if len(names) <= rules else names[np.argpartition(counts, len(names) - rules)[-rules:]]
        slots = _slot(pairs)
        frequent = np.zeros(1 << SLOT_BITS, bool)
        frequent[_slot(names)] = True
        owner = np.zeros(1 << SLOT_BITS, np.uint64)
        owner[_slot(top)] = top
        symbol = np.zeros(1 << SLOT_BITS, np.uint32)
        top = np.sort(owner[owner > 0])
        symbol[_slot(top)] = size + np.arange(len(top), dtype=np.uint32)
        hit = np.flatnonzero(owner[slots] == pairs)
        new = symbol[slots[hit]]
        still = frequent[slots]
        hit = at[hit]
        # of occurrences that overlap in a run, every second one from the first on
        order = np.arange(len(hit))
        run_start = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, order, 0))
        every = (order - run_start) % 2 == 0
        hit, new = hit[every], new[every]
        may[at] = still
        fresh = np.zeros(len(seq), bool)
        fresh[hit] = True
        seq[hit] = new
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        # the pair behind a replaced one begins at its new symbol
        may = np.append(may, False)[keep][:-1]
        seq, fresh = seq[keep], fresh[keep]
        may |= fresh[:-1] | fresh[1:]
        grammar.append(np.stack((top >> np.uint64(32), top & np.uint64(0xFFFFFFFF)), axis=1).astype(np.uint32))
        size += len(top)
    return np.concatenate(grammar) if grammar else np.empty((0, 2), np.uint32), seq


def compress(ids: np.ndarray, counts: np.ndarray, base: int, end: int = END, rules: int = RULES, least: int = LEAST) -> bytes:
    """A shard of documents: `ids` one after the other, each document's last one being `end`; ids are below `base`."""
    grammar, seq = grammar_of(ids, base, end, rules, least)
    lengths = expansions(grammar, base)
    ends = np.concatenate(([0], np.cumsum(lengths[seq])))
    starts = np.cumsum(counts) - counts
    places = np.searchsorted(ends, np.append(starts, len(ids)))
    wide = base + len(grammar) > 1 << 16
    body = seq.astype("<u4" if wide else "<u2").tobytes()
    return b"".join((
        HEAD.pack(MAGIC, base, end, len(grammar), len(seq), len(counts), wide), grammar.astype("<u4").tobytes(),
        lengths[base:].astype("<u4").tobytes(), places.astype("<u4").tobytes(), np.append(starts, len(ids)).astype("<u4").tobytes(), body,
    ))


def expansions(grammar: np.ndarray, base: int) -> np.ndarray:
    """How many ids each symbol stands for; a rule's symbols come before it, round by round."""
    lengths = np.ones(base + len(grammar), np.int64)
    done = 0
    while done < len(grammar):  # rules of one round only name symbols of earlier ones
        block = grammar[done:]
        n = int(np.argmax((block >= base + done).any(axis=1))) if (block >= base + done).any() else len(block)
        lengths[base + done : base + done + n] = lengths[block[:n]].sum(axis=1)
        done += n
    return lengths


class Shard:
    """Reads a shard."""

    def __init__(self, data: bytes):
        magic, self.base, self.end, rules, symbols, documents, wide = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.grammar = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = np.concatenate((np.ones(self.base, np.int64), take("<u4", rules).astype(np.int64)))
        self.places = take("<u4", documents + 1)
        self.starts = take("<u4", documents + 1).astype(np.int64)
        self.symbols = take("<u4" if wide else "<u2", symbols)
        self._rules: tuple[np.ndarray, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.places) - 1

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all symbols one after the other and where each symbol's begin, rules from shorter ones."""
        if self._rules is None:
            ends = np.cumsum(self.lengths)
            begins = ends - self.lengths
            flat = np.empty(int(ends[-1]), np.uint32)
            flat[: self.base] = np.arange(self.base)
            done = 0
            while done < len(self.grammar):
                block = self.grammar[done:]
                later = (block >= self.base + done).any(axis=1)
                n = int(np.argmax(later)) if later.any() else len(block)
                parts = block[:n].ravel()
                flat[begins[self.base + done] : ends[self.base + done + n - 1]] = flat[ragged(begins[parts], self.lengths[parts])]
                done += n
            self._rules = flat, begins
        return self._rules

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begins = self._expanded()
        return flat[ragged(begins[symbols], self.lengths[symbols])]

    def decode(self, document: int) -> np.ndarray:
        """The ids of one document."""
        return self.expand(self.symbols[self.places[document] : self.places[document + 1]])

    def decode_all(self) -> np.ndarray:
        return self.expand(self.symbols)

    def token(self, document: int, index: int) -> int:
        """One id: a search for its symbol by expansion lengths, then a walk down its rules."""
        symbols = self.symbols[self.places[document] : self.places[document + 1]]
        ends = np.cumsum(self.lengths[symbols])
        k = int(np.searchsorted(ends, index, "right"))
        index -= int(ends[k] - self.lengths[symbols[k]])
        symbol = int(symbols[k])
        while symbol >= self.base:
            a, b = self.grammar[symbol - self.base].tolist()
            symbol, index = (a, index) if index < self.lengths[a] else (b, index - int(self.lengths[a]))
        return symbol


def _write(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, number = byte_table(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = strings(batch.column("text"))
            for begin, stop in slices(texts, SHARD):
                ids, counts = with_end(*codec.tokens(texts[begin:stop]), end)
                yield pa.record_batch([
                    pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                    pa.array([batch.column("doc_id")[begin:stop].to_pylist()], pa.list_(pa.int64())),
                    pa.array([len(ids)], pa.int64()), pa.array([compress(ids, counts, len(codec.bytes_of), end)], pa.binary()),
                ], names=["part", "number", "doc_ids", "n_ids", "blob"])
                number += 1

    return run


def write_shards(docs: DataFrame, vocabulary_file: str = VOCABULARY, end: int = END) -> DataFrame:
    """The shards of the documents' ids in order of doc_id, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return materialise(ordered.mapInArrow(_write(vocabulary(vocabulary_file), end), "part int, number int, doc_ids array<long>, n_ids long, blob binary"), "shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard(batch.column("blob")[i].as_buffer())
            raw = memoryview(shard.decode_all().astype("<u4")).cast("B")
            ends = shard.starts[1:]
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(shard.starts.tolist(), ends.tolist())]
            n = len(shard)
            yield pa.record_batch([
                pa.array(np.full(n, batch.column("part")[i].as_py(), np.int32)), pa.array(np.full(n, batch.column("number")[i].as_py(), np.int32)),
                batch.column("doc_ids")[i].values, pa.array(shard.starts[:-1]), pa.array(np.diff(shard.starts)), pa.array(crc, pa.int64()),
            ], names=["part", "number", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' bytes; start counts all ids before it."""
    sizes = shards.select("part", "number", "n_ids")
    by_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    starts = sizes.withColumn("within", within).join(before, "part").select("part", "number", (F.col("within") + F.col("before")).alias("base"))
    found = shards.select("part", "number", "doc_ids", "blob").mapInArrow(_read, "part int, number int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "number"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op1_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as shards and read back."""
    return read_shards(write_shards(table(spark, sf_dir, "documents")))

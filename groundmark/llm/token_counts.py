"""Token counts without ids: pieces counted once per distinct pre-token, summed over per-document frequencies.

Texts are cut into pre-tokens in Arrow batches. For each block of documents and each bucket of pre-tokens (by hash) one
frame travels: the block's distinct pre-tokens of that bucket with the documents that have them and how often. All
frames of a bucket meet in one partition, where a pre-token that any of them holds is encoded once (or again once
`KNOWN` others have been), only its length is kept, and joined by equality to the frequencies. What leaves is one array of sums per frame, one sum a document of the
block; the arrays of a block are added up. A word that every document has adds one frequency per document to one bucket,
whatever its weight in the corpus, and no row per document and bucket is made.

Nulls: a null text counts as empty (0 tokens, 0 bytes); a null or repeated doc_id is carried through, one row out per
row in. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, strings, table
from .tokens import PieceTable, byte_table, sentence_table, vocabulary

LIMIT = 4096
#: Pre-tokens whose counts a task keeps at a time, besides those of one frame; about 150 bytes each.
KNOWN = 1_000_000
#: A frame is one row of four lists: the pre-tokens, how many documents each has, and those documents and frequencies.
FRAME = ["pretoken", "documents", "document", "times"]


def piece_table(path: str) -> PieceTable:
    return sentence_table(path) if path.endswith(".model") else byte_table(path)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


FRAMES = "bucket int, block long, doc_id array<long>, n_bytes array<long>, frame binary"
SUMS = "block long, doc_id array<long>, n_bytes array<long>, n_tokens array<long>"


def _frequencies(path: str, buckets: int, chars: int):
    """Frames of each block of about `chars` characters, and a row with the block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = piece_table(path).distinct
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = strings(batch.column("text"))
            for begin, end in slices(texts, chars):
                names, codes, counts = cut(texts[begin:end])
                own = np.fromiter((zlib.crc32(k.encode()) % buckets for k in names), np.int64, len(names))
                place = np.argsort(own, kind="stable")
                rank = np.empty_like(place)
                rank[place] = np.arange(len(place))
                n = end - begin
                pairs, times = np.unique(rank[codes] * n + np.repeat(np.arange(n), counts), return_counts=True)
                word, doc = np.divmod(pairs, n)
                ends = np.searchsorted(word, np.arange(len(place)), "right")
                bounds = np.searchsorted(own[place], np.arange(buckets + 1))
                owners = np.flatnonzero(np.diff(bounds)).tolist()
                frames = []
                for b in owners:
                    lo, hi = bounds[b], bounds[b + 1]
                    first, last = (ends[lo - 1] if lo else 0), ends[hi - 1]
                    frames.append(_pack(pa.record_batch([
                        pa.array([[names[i] for i in place[lo:hi]]], pa.list_(pa.string())),
                        pa.array([np.diff(ends[lo:hi], prepend=first).astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([doc[first:last].astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([times[first:last].astype(np.int32)], pa.list_(pa.int32())),
                    ], names=FRAME)))
                nothing = [None] * len(frames)
                yield pa.record_batch([
                    pa.array([block % buckets, *owners], pa.int32()),
                    pa.array([block] * (len(frames) + 1), pa.int64()),
                    pa.array([batch.column("doc_id")[begin:end].to_pylist(), *nothing], pa.list_(pa.int64())),
                    pa.array([[len(x.encode()) for x in texts[begin:end]], *nothing], pa.list_(pa.int64())),
                    pa.array([None, *frames], pa.binary()),
                ], names=["bucket", "block", "doc_id", "n_bytes", "frame"])
                block += 1

    return run


def _lookup(path: str):
    """The sums of each frame by document of its block; each pre-token is encoded at its first frame only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_table(path).encode
        known: dict[str, int] = {}
        for batch in batches:
            found = []
            for frame in batch.column("frame"):
                if not frame.is_valid:
                    found.append(None)
                    continue
                part = pa.ipc.open_stream(frame.as_buffer()).read_next_batch()
                names = part.column(0).flatten().to_pylist()
                if len(known) > KNOWN:  # those of other frames can be counted anew
                    known.clear()
                fresh = [x for x in names if x not in known]
                if fresh:
                    known.update(zip(fresh, encode(fresh)[1].tolist()))
                pieces = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
                documents, docs, times = (part.column(k).flatten().to_numpy() for k in (1, 2, 3))
                found.append(np.bincount(docs, np.repeat(pieces, documents) * times).astype(np.int64))
            yield pa.record_batch([batch.column("block"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.list_(pa.int64()))], names=["block", "doc_id", "n_bytes", "n_tokens"])

    return run


def _add_up(block: pa.Table) -> pa.Table:
    """The documents of a block with the sums of its frames; a frame's array ends at its last document."""
    ids = block.column("doc_id").combine_chunks().flatten()
    total = np.zeros(len(ids), np.int64)
    for part in block.column("n_tokens"):
        if part.is_valid:
            values = part.values.to_numpy()
            total[: len(values)] += values
    return pa.table({"doc_id": ids, "n_bytes": block.column("n_bytes").combine_chunks().flatten(), "n_tokens": total})


def count_tokens(docs: DataFrame, vocabulary_file: str, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of the whole texts of `docs` (doc_id, text).

    `buckets` (the shuffle partitions unless given) also sets how many characters a block has, so that a frame keeps
    its size as both grow.
    """
    buckets = buckets or shuffle_partitions(docs.sparkSession)
    path = vocabulary(vocabulary_file)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    frames = rows.mapInArrow(_frequencies(path, buckets, max(2_000_000, 16_000 * buckets)), FRAMES)
    parts = frames.repartition(buckets, "bucket").mapInArrow(_lookup(path), SUMS)
    return parts.groupBy("block").applyInArrow(_add_up, "doc_id long, n_bytes long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`count_tokens` over all documents with the piece vocabulary."""
    out = count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)

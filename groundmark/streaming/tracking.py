"""The tracker as a stateful stream, and recordings that are followed file by file.

Blobs arrive in files, one a piece of recording. State is kept by session: rows wait in event order until the watermark has
passed them, then frame after frame goes to the open tracks, which hold their count and latest observations only. A pause
ends all tracks of a session, also when nothing follows it. What comes out are events: each blob `seen` with its track,
each track `ended`, each file `failed`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.tracks import FLUSH_S, GATE_PX, MAX_MISSES, Open, step

BLOB = "session string, frame long, at timestamp, ordinal long, cx double, cy double, area double"
EVENT = "session string, event string, track string, frame long, at timestamp, ordinal long, cx double, cy double, area double, note string"
_WAITING = "frame long, at_us long, ordinal long, cx double, cy double, area double"
_OPEN = "piece long, count long, last_us long, number array<long>, length array<long>, missed array<long>, frames array<array<long>>, xs array<array<double>>, ys array<array<double>>"

#: State by session needs the state store that can hold lists and timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Tracker(StatefulProcessor):
    """Blobs of a session to events, with rows ordered by frame behind the watermark."""

    def __init__(self, gate_px: float = GATE_PX, max_misses: int = MAX_MISSES, flush_s: float = FLUSH_S):
        self.gate_px, self.max_misses, self.flush_us = gate_px, max_misses, int(flush_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        latest = None
        for part in rows:
            failed = part[part["note"].notna()]
            if len(failed):
                yield _events(key[0], [("failed", None, None, None, None, None, None, None, note) for note in failed["note"]])
            part = part[part["note"].isna()]
            if not len(part):
                continue
            at = part["at"].to_numpy("datetime64[us]").astype(np.int64)
            rest = [part[c].to_numpy() for c in ("frame", "ordinal", "cx", "cy", "area")]
            self.waiting.appendList([(int(f), int(a), int(o), *(None if np.isnan(v) else float(v) for v in values)) for a, f, o, *values in zip(at, *rest)])
            latest = max(latest or int(at.max()), int(at.max()))
        if latest is not None:
            self.handle.registerTimer(latest // 1000)
            self.handle.registerTimer((latest + self.flush_us) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get())
        due = sorted((r for r in rows if r[1] // 1000 <= now), key=lambda r: (r[0], r[2]))
        later = [r for r in rows if r[1] // 1000 > now]
        state = self.open.get()
        piece, count, last, open_ = _unpacked(state)
        events: list[tuple] = []

        def flush(frame: int | None, at: int) -> None:
            events.extend(("ended", f"{piece}-{t.number}", frame, at, None, None, None, None, None) for t in open_)
            open_.clear()

        k = 0
        while k < len(due):
            end = k
            while end < len(due) and due[end][0] == due[k][0]:
                end += 1
            frame, at = due[k][0], due[k][1]
            if last is not None and at - last > self.flush_us:
                flush(None, last)
                piece, count = piece + 1, 0
            last = at
            blobs = [r for r in due[k:end] if r[3] is not None]
            centres = np.array([[r[3], r[4]] for r in blobs], float).reshape(-1, 2)
            numbers, ended, count = step(open_, frame, centres, count, self.gate_px, self.max_misses)
            events.extend(("seen", f"{piece}-{n}", r[0], r[1], r[2], r[3], r[4], r[5], None) for n, r in zip(numbers, blobs))
            events.extend(("ended", f"{piece}-{t.number}", frame, at, None, None, None, None, None) for t in ended)
            k = end
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if open_ and not later and last is not None and now * 1000 - last > self.flush_us:
            flush(None, last)
        if due or state is not None:
            self.open.update(_packed(piece, count, last, open_))
        if events:
            yield _events(key[0], events)


def _unpacked(state: Any) -> tuple[int, int, int | None, list[Open]]:
    if state is None:
        return 0, 0, None, []
    piece, count, last, number, length, missed, frames, xs, ys = state
    return piece, count, last, [Open(n, k, m, [(f, np.array([x, y])) for f, x, y in zip(*seen)]) for n, k, m, *seen in zip(number, length, missed, frames, xs, ys)]


def _packed(piece: int, count: int, last: int | None, tracks: list[Open]) -> tuple:
    seen = [t.seen for t in tracks]
    return (piece, count, last, [t.number for t in tracks], [t.length for t in tracks], [t.missed for t in tracks], [[int(f) for f, _ in s] for s in seen], [[float(c[0]) for _, c in s] for s in seen], [[float(c[1]) for _, c in s] for s in seen])


def _events(session: str, events: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame([(session, *e) for e in events], columns=[x.split()[0] for x in EVENT.split(", ")])
    frame["at"] = pd.to_datetime(frame["at"].astype("Int64"), unit="us")
    return frame.astype({"frame": "Int64", "ordinal": "Int64"})


def tracked(blobs: DataFrame, lateness: str = "0 seconds", **limits: float) -> DataFrame:
    """Events of a stream of blobs (session, frame, at, ordinal, cx, cy, area, and note for what failed).

    Frames without blobs are rows with null cx. Rows that come more than `lateness` behind the latest of all sessions are
    late and left out by the watermark; within it their order is of no account.
    """
    if "note" not in blobs.columns:
        blobs = blobs.withColumn("note", F.lit(None).cast("string"))
    rows = blobs.select(*(x.split()[0] for x in BLOB.split(", ")), "note").withWatermark("at", lateness)
    return rows.groupBy("session").transformWithStateInPandas(Tracker(**limits), EVENT, "Append", "EventTime")


def detections(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of the blobs of JSON Lines files, oldest file first, and a row with a `note` for a file that is none.

    A file is read as a whole: one bad line fails all of it, once, so that no part of a piece of recording is tracked.
    """
    read = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).load(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    each = F.transform(lines, lambda x: F.from_json(x, BLOB))
    bad = F.exists(each, lambda x: x.isNull() | x["session"].isNull() | x["frame"].isNull() | x["at"].isNull()) | (F.size(lines) == 0)
    none = F.struct(name.alias("session"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in BLOB.split(", ")[1:])))
    rows = read.select(name.alias("file"), F.when(bad, F.array(none)).otherwise(each).alias("rows"), bad.alias("bad"))
    note = F.when(F.col("bad"), F.concat(F.col("file"), F.lit(" cannot be read")))
    return rows.select(F.explode("rows").alias("r"), note.alias("note")).select("r.*", "note")  # a failed file has no instant: no watermark moves


def follow(events: DataFrame, out: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", **trigger: Any) -> StreamingQuery:
    """Writes each batch of events under `out`, in a folder of its own that a repeated batch replaces.

    A batch that was written but not yet committed when the query was killed is computed again from the same files and the
    same state, and overwrites its folder, so nothing is lost or doubled. `each` gets the batch's written rows and its number.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        path = f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        if each is not None:
            each(spark.read.schema(batch.schema).parquet(path), number)

    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        return events.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])


def followed(spark: SparkSession, out: str) -> DataFrame:
    """All events written so far, with the number of their batch."""
    return spark.read.schema(EVENT + ", batch long").option("basePath", out).parquet(f"{out}/batch=*")

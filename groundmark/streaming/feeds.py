"""Streams: position fixes without repeats, recordings that are followed, a board that is kept up, exports on change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.results import keyed
from ..schemas import FIX, SEGMENT
from ..sources.shared import shared_folder
from .keys import kept, without_repeats_ever


def _state_dir(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def fixes(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes of JSON Lines files as they arrive."""
    return spark.readStream.schema(FIX).json(folder)


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SEGMENT).json(folder)


def without_repeats(stream: DataFrame, keys: list[str], at: str, lateness: str = "10 minutes") -> DataFrame:
    """A stream's first row of each key. Keys are forgotten once the watermark has passed them, so state is bounded."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def board(stream: DataFrame) -> DataFrame:
    """Totals and counts of a stream of scored landings by ranking key, for complete output."""
    return keyed(stream).groupBy("key").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"), F.count("*").alias("n"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives for the files that are there now, as a table in memory; for small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", _state_dir(stream.sparkSession)).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def landed(stream: DataFrame) -> DataFrame:
    """What a stream gives for the files that are there now, written as Parquet and read back; of any size."""
    folder = _state_dir(stream.sparkSession)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def on_change(stream: DataFrame, export: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Calls `export` with each batch that has rows; batches already exported are not repeated after a restart."""
    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            export(batch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated_counts(spark: SparkSession, path: str) -> DataFrame:
    """(n, users) of the rows of an events table after dropping repeats of (user_id, ts), as a stream."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    read = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    store, state = shared_folder(spark, "kept"), _state_dir(spark)
    without_repeats_ever(read.select("user_id", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "ts"], "ts", store, state).awaitTermination()
    return kept(spark, store, "user_id long, ts timestamp").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))

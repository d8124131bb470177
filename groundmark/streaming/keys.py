"""Rows of a stream that were never seen before, by key, for as long as the store is kept.

What was kept is the index: each batch is anti-joined with what earlier batches kept on the same days, and adds its own new
rows in a folder of its own, which a repeated batch replaces. A watermark would forget keys; this keeps them all on shared
storage and reads only the days that a batch has.
"""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def kept(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """All rows kept so far, with `batch` and `day`; none where nothing was kept yet."""
    kind = f"{schema}, batch long, day date"
    try:
        return spark.read.schema(kind).option("basePath", store).parquet(f"{store}/batch=*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def keep_new(batch: DataFrame, number: int, store: str, keys: list[str], at: str) -> None:
    """Adds to the store the rows of a batch whose key no earlier batch kept: of one key the first row by `at`.

    The instant is part of the key, so equal keys are of one day. Null keys are keys like any other.
    """
    spark = batch.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    first = Window.partitionBy(*keys).orderBy(at, F.xxhash64(*batch.columns))
    rows = batch.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").withColumn("day", F.to_date(at))
    # a batch that is repeated after a failure must not see what it wrote itself
    before = kept(spark, store, schema).filter(F.col("batch") < number).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("day").alias("_day"))
    same = rows["day"].eqNullSafe(before["_day"])
    for k in keys:
        same = same & rows[k].eqNullSafe(before[f"_{k}"])
    rows.join(before, same, "left_anti").write.mode("overwrite").partitionBy("day").parquet(f"{store}/batch={number}")


def without_repeats_ever(stream: DataFrame, keys: list[str], at: str, store: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Keeps the rows of a stream that were never seen before; `at` must be among the keys."""
    if at not in keys:
        raise ValueError("the instant must be part of the key")
    each = lambda batch, number: keep_new(batch, number, store, keys, at)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

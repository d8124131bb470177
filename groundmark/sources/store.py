"""A store of landings in versions, and the log of changes beside it.

A version is a folder of Parquet under `landings`. It counts once a row in `versions` names it, which its writer adds as the
last thing it does, in one file that appears as a whole. Readers take the highest version named, so one that reads during a
write sees the old version or the new one, never parts, and what a killed writer left is never named. Changes come in
batches, folders under `log` that count once `batches` names them. Compaction folds the batches that it sees into a new
version and lists them in `folded` before that version is named; the current landings are the latest version and the
batches that it does not list. So appending needs no lock, and no batch is lost or applied twice, whatever is written at
the same time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..plans import judging

SCHEMA_VERSION = 1
_VERSION, _BATCH = "number int, folder string, schema_version int", "name string"


def _rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of a table that may not be there yet."""
    try:
        return spark.read.schema(kind).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def _name(spark: SparkSession, path: str, kind: str, *values: object) -> None:
    spark.createDataFrame([values], kind).coalesce(1).write.mode("append").parquet(path)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(number, folder, schema_version) of the versions of a store."""
    return _rows(spark, f"{path}/versions", _VERSION)


def _version(spark: SparkSession, path: str, number: int | None = None) -> Row | None:
    """A version's row, the highest one unless told; of two writers of one number the one of the greater folder stands."""
    found = versions(spark, path)
    return (found if number is None else found.filter(F.col("number") == number)).orderBy(F.desc("number"), F.desc("folder")).first()


def write(landings: DataFrame, path: str, folded: DataFrame | None = None) -> int:
    """Writes a new version and returns its number. `folded` (name) lists the batches of changes that it holds."""
    spark, last = landings.sparkSession, _version(landings.sparkSession, path)
    number, folder = (last["number"] if last else 0) + 1, uuid.uuid4().hex
    landings.write.parquet(f"{path}/landings/{folder}")
    (folded if folded is not None else spark.createDataFrame([], _BATCH)).write.parquet(f"{path}/folded/{folder}")
    _name(spark, f"{path}/versions", _VERSION, number, folder, SCHEMA_VERSION)
    return number


def _read(spark: SparkSession, path: str, number: int | None) -> tuple[DataFrame, DataFrame]:
    """The landings of a version, and the batches that it has folded."""
    row = _version(spark, path, number)
    if row is None:
        raise ValueError(f"{path} has no version{'' if number is None else f' {number}'}")
    if row["schema_version"] > SCHEMA_VERSION:
        raise ValueError(f"{path} was written by a later program")
    return spark.read.parquet(f"{path}/landings/{row['folder']}"), spark.read.schema(_BATCH).parquet(f"{path}/folded/{row['folder']}")


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The landings of a version, the latest one unless told."""
    return _read(spark, path, number)[0]


def append(log: DataFrame, path: str) -> str:
    """Adds a batch of changes, rows of `judging.changes`; returns its name."""
    name = uuid.uuid4().hex
    log.write.parquet(f"{path}/log/{name}")
    _name(log.sparkSession, f"{path}/batches", _BATCH, name)
    return name


def _waiting(spark: SparkSession, path: str, folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, names) of the batches that are not among the folded."""
    names = [r["name"] for r in _rows(spark, f"{path}/batches", _BATCH).join(folded, "name", "left_anti").distinct().collect()]  # a name a batch
    kind = f"id string, seq long, action string, {', '.join(f'{c} {t}' for c, t in judging.FIELDS.items())}"
    log = spark.read.schema(kind).parquet(*(f"{path}/log/{n}" for n in names)) if names else spark.createDataFrame([], kind)
    return log, spark.createDataFrame([(n,) for n in names], _BATCH)


def _after(landings: DataFrame, log: DataFrame) -> DataFrame:
    """The landings after the log; their history, if they have one, goes on."""
    if "history" not in landings.columns:
        return judging.current(landings, log)
    before = landings.select("id", F.col("history").alias("_before"))
    after = judging.current(landings.drop("history"), log).join(before, "id", "left")
    return after.withColumn("history", F.concat(F.coalesce("_before", F.array().cast("array<string>")), "history")).drop("_before")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The landings as the judge's changes leave them: the latest version and the batches that it has not folded."""
    landings, folded = _read(spark, path, None)
    return _after(landings, _waiting(spark, path, folded)[0])


def compact(spark: SparkSession, path: str) -> int:
    """Folds the waiting batches into a new version. Batches that come in the meantime wait for the next one."""
    landings, folded = _read(spark, path, None)
    log, names = _waiting(spark, path, folded)
    return write(_after(landings, log), path, folded.unionByName(names))


def landing(spark: SparkSession, path: str, id: str) -> Row:
    """One landing by its id; an error where the store has none."""
    row = current(spark, path).filter(F.col("id") == id).first()
    if row is None:
        raise KeyError(id)
    return row

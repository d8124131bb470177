"""Records of JSON as rows of a fixed type, with a lane for those that are none.

Two manners. Tolerant: keys that are not known go, missing ones take their default, and only a record without its needed
keys is none. Strict: the keys must be just those of the type. Either way no record is lost: those that do not decode come
out with their text and the reason, as do those with a value that does not fit its type.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType

from ..schemas import FIX, LANDING, TRACK_POINT

#: Keys without which a landing is none, and what others have where they are missing; keys of a track point that may be missing.
LANDING_NEEDS = ("id", "session", "created_utc", "kind", "outcome")
LANDING_DEFAULTS: dict[str, Any] = {
    "status": "pending", "fps": 60.0, "direction": 1, "method": "", "flags": [], "track": [], "registration": "", "competition_number": "",
    "aircraft_type": "", "identified_by": "", "pilot": "", "note": "",
}
POINT_OPTIONS = ("gap_px", "reach_px", "tyre_seen")

Lanes = tuple[DataFrame, DataFrame]


def _names(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def _wrong(kind: StructType) -> Column:
    """The keys of numbers, instants and truth values whose value is none, by the columns of `_read`."""
    plain = [f.name for f in kind if not isinstance(f.dataType, (ArrayType, MapType, StructType)) and f.dataType.typeName() != "string"]
    none = lambda c: F.try_element_at("_raw", F.lit(c)).isNotNull() & F.col("_parsed")[c].isNull()
    return F.array_compact(F.array(*(F.when(none(c), F.lit(c)) for c in plain)).cast("array<string>"))


def _read(records: DataFrame, kind: StructType, text: str) -> DataFrame:
    """`records` with each text read once: its keys, its values as texts and by `kind`."""
    column = F.col(text)
    return records.withColumns({"_keys": F.json_object_keys(column), "_raw": F.from_json(column, "map<string,string>"), "_parsed": F.from_json(column, kind)})


def _reason(keys: Column, refusals: list[tuple[str, Column]]) -> Column:
    """Why a record is none: no object, or the first refusal that names keys; null where it is one."""
    found = F.lit(None).cast("string")
    for why, which in reversed(refusals):
        found = F.when(F.size(which) > 0, F.concat(F.lit(why + " "), F.array_join(F.array_sort(which), ", "))).otherwise(found)
    return F.when(keys.isNull(), "no object").otherwise(found)


def _judged(records: DataFrame, reason: Column, value: Column, columns: list[str]) -> DataFrame:
    """`columns` of `_read`'s rows with `reason`, null where the text is a record, and that `value`."""
    return records.withColumns({"_reason": reason, "_value": value}).select(*columns, F.col("_reason").alias("reason"), F.col("_value").alias("value"))


def _lanes(judged: DataFrame, text: str) -> Lanes:
    others = [c for c in judged.columns if c not in (text, "reason", "value")]
    # rows of an array, so that no condition on a reason moves below the reading and has it done again
    marked = judged.select(*others, text, F.explode(F.array(F.struct("reason", "value"))).alias("_of"))
    rows = marked.filter("_of.reason is null").select(*others, "_of.value.*")
    return rows, marked.filter("_of.reason is not null").select(*others, F.col(text).alias("record"), F.col("_of.reason").alias("reason"))


def _filled(f: StructField, parsed: Column, keys: Column, defaults: dict[str, Any]) -> Column:
    if f.name not in defaults:
        return parsed[f.name].alias(f.name)
    value = F.array() if defaults[f.name] == [] else F.lit(defaults[f.name])
    return F.when(F.array_contains(keys, f.name), parsed[f.name]).otherwise(value.cast(f.dataType)).alias(f.name)


def _tolerated(
    records: DataFrame, schema: str, needs: tuple[str, ...] = (), defaults: dict[str, Any] | None = None, text: str = "text", refusals: list[tuple[str, Column]] | None = None
) -> DataFrame:
    kind = StructType.fromDDL(schema)
    reason = _reason(F.col("_keys"), [("misses", F.array_except(_names(needs), F.col("_keys"))), *(refusals or []), ("does not fit", _wrong(kind))])
    value = F.struct(*(_filled(f, F.col("_parsed"), F.col("_keys"), defaults or {}) for f in kind))
    return _judged(_read(records, kind, text), reason, value, records.columns)


def tolerant(
    records: DataFrame, schema: str, needs: tuple[str, ...] = (), defaults: dict[str, Any] | None = None, text: str = "text", refusals: list[tuple[str, Column]] | None = None
) -> Lanes:
    """(rows, rescued) of a column of JSON objects. A key that is there with a null stays null; only missing ones take a default."""
    return _lanes(_tolerated(records, schema, needs, defaults, text, refusals), text)


def strict(records: DataFrame, schema: str, text: str = "text") -> Lanes:
    """(rows, rescued) of a column of JSON objects that must have just the keys of `schema`; blank texts are neither."""
    kind, keys = StructType.fromDDL(schema), F.col("_keys")
    names = _names([f.name for f in kind])
    lines = records.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    reason = _reason(keys, [("knows no", F.array_except(keys, names)), ("misses", F.array_except(names, keys)), ("does not fit", _wrong(kind))])
    return _lanes(_judged(_read(lines, kind, text), reason, F.col("_parsed"), records.columns), text)


def judged_landings(records: DataFrame, text: str = "text") -> DataFrame:
    """`records` with `reason`, null where the text is a landing, and the landing as `value`: tolerant, but the points of a
    track must have the keys of a point, and no others. Each text is read once."""
    names = [f.name for f in StructType.fromDDL(TRACK_POINT)]
    points = F.from_json(F.get_json_object(text, "$.track"), "array<string>")
    odd = lambda p: F.array_union(F.array_except(F.json_object_keys(p), _names(names)), F.array_except(_names([n for n in names if n not in POINT_OPTIONS]), F.json_object_keys(p)))
    wrong = F.coalesce(F.array_distinct(F.flatten(F.transform("_points", odd))), _names([]))
    read = records.withColumn("_points", points)
    judged = _tolerated(read, LANDING, LANDING_NEEDS, LANDING_DEFAULTS, text, [("has points off in", wrong)])
    seen = F.transform(F.col("value.track"), lambda p: p.withField("tyre_seen", F.coalesce(p["tyre_seen"], F.lit(False))))
    return judged.select(*records.columns, "reason", F.col("value").withField("track", seen).alias("value"))


def landing_records(records: DataFrame, text: str = "text") -> Lanes:
    """(landings, rescued) of `judged_landings`."""
    return _lanes(judged_landings(records, text), text)


def fix_records(records: DataFrame, text: str = "text") -> Lanes:
    """(fixes, rescued): strict."""
    return strict(records, FIX, text)

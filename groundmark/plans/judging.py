"""The judge's changes as an append-only log, and landings as what it folds to.

A change is a row (id, seq, action, and any of the fields below, null where untouched). The last word per field wins, by
`seq`; history is the list of actions in that order. Nothing is rewritten: readers fold the log over the landings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import blank_to_null, kind, stripped

#: Fields that a change may set, and their types.
FIELDS = {
    "registration": "string", "pilot": "string", "competition_number": "string", "aircraft_type": "string", "note": "string",
    "outcome": "string", "status": "string", "confirmed_frame": "int", "confirmed_longitudinal_m": "double", "confirmed_utc": "timestamp",
}
STATUS = {"confirm": "confirmed", "reject": "rejected", "reopen": "pending"}


def _row(requests: DataFrame, **values: Column) -> DataFrame:
    return requests.select("id", "seq", "action", *((values[c].cast(t) if c in values else F.lit(None).cast(t)).alias(c) for c, t in FIELDS.items()))


def changes(requests: DataFrame) -> DataFrame:
    """Log rows from requests (id, seq, at_utc, action, registration, pilot, note, outcome, frame, offset_m, ...).

    `confirm` takes a registration, a pilot and a note where they are not blank; `reject` a note; `edit` whatever is not
    null, texts stripped and codes in capitals; a picked frame makes the landing measured; `reset` drops the picked one.
    """
    have = set(requests.columns)
    col = lambda c, t="string": F.col(c) if c in have else F.lit(None).cast(t)
    edit = F.col("action") == "edit"
    filled = lambda c: F.when(edit, c).otherwise(blank_to_null(c))
    status = F.lit(None).cast("string")
    for action, value in STATUS.items():
        status = F.when(F.col("action") == action, value).otherwise(status)
    picked = col("frame", "int").isNotNull()
    return _row(
        requests, registration=filled(F.upper(stripped(col("registration")))), pilot=filled(stripped(col("pilot"))),
        competition_number=F.upper(stripped(col("competition_number"))), aircraft_type=stripped(col("aircraft_type")), note=filled(col("note")),
        outcome=F.when(picked, "measured").otherwise(col("outcome")), status=status,
        confirmed_frame=col("frame", "int"), confirmed_longitudinal_m=F.when(picked, col("offset_m", "double")),
        confirmed_utc=F.when(F.col("action") == "confirm", col("at_utc", "timestamp")),
    )


def folded(log: DataFrame) -> DataFrame:
    """(id, each field, history): last word of each field over a landing's changes, and its actions in order.

    Maxima combine before the shuffle, so a landing with very many changes sends one row a task, but for its history.
    """
    reopened = F.max(F.when(F.col("action") == "reopen", F.col("seq")))
    reset = F.max(F.when(F.col("action") == "reset", F.col("seq")))
    last = {c: F.max_by(F.struct(c, "seq"), F.when(F.col(c).isNotNull(), F.col("seq"))) for c in FIELDS}
    found = log.groupBy("id").agg(
        *(x.alias(c) for c, x in last.items()), reopened.alias("_reopened"), reset.alias("_reset"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "action"))), lambda x: x["action"]).alias("history"),
    )
    after = lambda c, mark: F.when(F.coalesce(F.col(f"{c}.seq") > F.col(mark), F.lit(True)), F.col(f"{c}.{c}"))
    undone = {"confirmed_utc": "_reopened", "confirmed_frame": "_reset", "confirmed_longitudinal_m": "_reset"}
    return found.select("id", *((after(c, undone[c]) if c in undone else F.col(f"{c}.{c}")).alias(c) for c in FIELDS), F.col("_reset").isNotNull().alias("was_reset"), "history")


def current(landings: DataFrame, log: DataFrame) -> DataFrame:
    """`landings` after the log: fields of the judge over those measured, kind from the outcome, bound from the track's edge."""
    fold = folded(log).select("id", *(F.col(c).alias(f"_{c}") for c in FIELDS), "was_reset", "history")
    joined = landings.join(fold, "id", "left")
    new = {c: F.coalesce(f"_{c}", c) for c in FIELDS if c in landings.columns}
    for c in ("confirmed_frame", "confirmed_longitudinal_m", "confirmed_utc"):
        if c in landings.columns:
            dropped = F.col("was_reset") if c != "confirmed_utc" else F.array_contains("history", "reopen")
            new[c] = F.when(F.coalesce(dropped, F.lit(False)), F.col(f"_{c}")).otherwise(new[c])
    if "registration" in landings.columns:
        new["identified_by"] = F.when(F.col("_registration") != "", "judge").when(F.col("_registration") == "", "").otherwise(F.col("identified_by") if "identified_by" in landings.columns else F.lit(None))
    out = joined.withColumns(new)
    if "kind" in landings.columns:
        out = out.withColumn("kind", F.when(F.col("_outcome").isNotNull(), kind("outcome")).otherwise(F.col("kind")))
    if {"bound_m", "track", "direction"} <= set(landings.columns):
        edge = F.when(F.col("_outcome") == "short", F.get("track", 0)).when(F.col("_outcome") == "long", F.get("track", F.size("track") - 1))
        out = out.withColumn("bound_m", F.coalesce(F.col("direction") * edge["world_x"], F.col("bound_m")))
    return out.select(*landings.columns, *(["identified_by"] if "identified_by" not in landings.columns and "registration" in landings.columns else []), F.coalesce("history", F.array().cast("array<string>")).alias("history"))


def renamed(landings: DataFrame, stem: Column) -> DataFrame:
    """(id, clip_path, new_path): the clips whose name does not follow from the landing any more."""
    new = F.concat(F.regexp_extract("clip_path", r"^(.*/)?[^/]*$", 1), stem, F.regexp_extract("clip_path", r"(\.\w+)$", 1))
    return landings.select("id", "clip_path", new.alias("new_path")).filter("new_path <> clip_path")

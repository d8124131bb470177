"""Scored landings, the ranking of pilots, counters and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import blank_to_null, label, rounded, score, scored_offset, stripped, unrounded_score
from ..schemas import Rules
from .ordered import numbered, places


def scored(landings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`landings` with `scored_longitudinal_m`, `label` and `score`; rejected ones have no score."""
    x = scored_offset("confirmed_longitudinal_m", "longitudinal_m")
    out = landings.withColumn("scored_longitudinal_m", x)
    points = F.when(F.col("status") != "rejected", score("scored_longitudinal_m", "outcome", rules))
    return out.withColumn("label", label("outcome", "scored_longitudinal_m", "bound_m")).withColumn("score", points)


def ordered(landings: DataFrame) -> DataFrame:
    """The order of a store: by touchdown or first sight, then id."""
    return landings.orderBy(F.coalesce("touchdown_utc", "first_utc").asc_nulls_first(), "id")


def live_order(landings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The scoring page: confirmed landings before pending ones, by unrounded score, unscored ones as -1."""
    live = landings.withColumn("live_score", unrounded_score("scored_longitudinal_m", "outcome", rules))
    return live.orderBy((F.col("status") != "confirmed").cast("int"), F.coalesce("live_score", F.lit(-1.0)).desc(), "id")


def shown(landings: DataFrame) -> DataFrame:
    return landings.filter((F.col("kind") == "landing") & (F.col("status") != "rejected"))


def pending(landings: DataFrame) -> DataFrame:
    return shown(landings).filter("status <> 'confirmed'").orderBy(F.coalesce("touchdown_utc", "first_utc").asc_nulls_first(), "id")


def keyed(landings: DataFrame) -> DataFrame:
    """Confirmed landings with the key that they are ranked under: pilot, else aircraft, else the landing itself."""
    pilot = F.coalesce(stripped("pilot"), F.lit(""))
    craft = F.coalesce("registration", F.lit(""))
    key = F.when(pilot != "", F.concat(F.lit("p:"), F.lower(pilot))).when(craft != "", F.concat(F.lit("a:"), craft)).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    at = F.coalesce("touchdown_utc", "first_utc")
    return shown(landings).filter("status = 'confirmed'").withColumns({"key": key, "_pilot": pilot, "_craft": craft, "_at": at})


def rank(landings: DataFrame, buckets: int = 64) -> DataFrame:
    """(position, key, name, total, n, aircraft): by total, then count, then name; positions are never shared.

    A pilot's name is spelt as in the latest landing. `aircraft` lists the distinct ones in the order in which they were
    first seen. Sums combine before the shuffle, and positions come bucket by bucket, so neither a pilot nor the whole
    list ever sits in one task.
    """
    rows = keyed(landings)
    order = F.struct("_at", "id")
    text = F.concat_ws(" ", blank_to_null("_craft"), blank_to_null("competition_number"))
    kind = F.when((F.col("_pilot") == "") & (text == ""), F.coalesce("aircraft_type", F.lit(""))).otherwise("")
    rows = rows.withColumn("_text", F.when(text != "", text).otherwise(kind)).withColumn("_typed", text == "")
    totals = rows.groupBy("key").agg(
        F.sum(F.coalesce("score", F.lit(0.0))).alias("total"), F.count("*").alias("n"),
        F.max_by(F.coalesce(blank_to_null("_pilot"), blank_to_null("_craft"), F.lit("unknown")), order).alias("name"),
    )
    first = rows.filter("_text <> ''").groupBy("key", "_text").agg(F.min(F.struct("_at", "id", "_typed")).alias("seen"))
    lists = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seen", "_text"))).alias("l"))
    # an aircraft's type stands in only as long as nothing better was seen
    lists = lists.select("key", F.transform(F.filter("l", lambda x, i: ~x["seen"]["_typed"] | (i == 0)), lambda x: x["_text"]).alias("aircraft"))
    found = totals.join(lists, "key", "left").withColumn("aircraft", F.coalesce("aircraft", F.array().cast("array<string>")))
    by = [F.col("total").desc(), F.col("n").desc(), F.lower("name"), F.col("key")]
    return numbered(found, -F.col("total"), by, "position", buckets).select("position", "key", "name", "total", "n", "aircraft")


def ranked_landings(landings: DataFrame, bucket_s: float = 30 * 86_400.0) -> DataFrame:
    """Confirmed landings under their key with their place in time, from 1, and from the latest, from 1."""
    bucket = F.floor(F.unix_micros("_at") / (bucket_s * 1e6)).cast("long")
    rows = places(keyed(landings).withColumn("_at", F.col("_at").cast("timestamp")), ["key"], ["_at", "id"], bucket, "ordinal", "_total")
    return rows.withColumn("from_latest", F.col("_total") - F.col("ordinal") + 1).drop("_pilot", "_craft", "_at", "_total")


def last_landings(landings: DataFrame, n: int = 4) -> DataFrame:
    """The last `n` landings of each key, and how many there are before them."""
    rows = ranked_landings(landings)
    return rows.filter(F.col("from_latest") <= n).withColumn("earlier", F.greatest(F.col("ordinal") - n, F.lit(0)))


def counters(landings: DataFrame, by: list[str]) -> DataFrame:
    """Landings by key: all, confirmed and rejected of every kind, and pending ones that are landings."""
    return landings.groupBy(*by).agg(
        F.count("*").alias("count"), F.count_if((F.col("status") == "pending") & (F.col("kind") == "landing")).alias("pending"),
        F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "rejected").alias("rejected"),
    )


def confirmed(ranking: DataFrame) -> DataFrame:
    """(confirmed): the landings that a ranking counts."""
    return ranking.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("confirmed"))


def next_id(landings: DataFrame) -> DataFrame:
    """The id that follows the number of landings. Ids can repeat once rows were removed: do not allocate by it."""
    return landings.agg(F.format_string("L%04d", F.count("*") + 1).alias("next_id"))


def pages(rows: DataFrame, per_page: int, position: str = "position") -> DataFrame:
    place = F.col(position) - 1
    return rows.withColumn("page", F.floor(place / per_page).cast("long")).withColumn("row", (place % per_page).cast("long"))


def sessions(landings: DataFrame) -> DataFrame:
    """Sessions with results, newest name first."""
    return landings.groupBy("session").agg(F.count("*").alias("landings")).orderBy(F.desc("session"))


def without_segment(landings: DataFrame, segment: str) -> DataFrame:
    return landings.filter(~F.col("segment").eqNullSafe(segment))


def sheet(landings: DataFrame, rules: Rules = Rules(), buckets: int = 64) -> DataFrame:
    """The rows of the results sheet: every confirmed landing under its pilot's position, in time order."""
    rows = scored(landings, rules)
    places = rank(rows, buckets).select("position", "key", "name")
    metres = F.when(F.col("outcome") == "measured", rounded("scored_longitudinal_m", 2))
    return ranked_landings(rows).join(places, "key").select("position", "name", "ordinal", "id", "registration", metres.alias("offset_m"), "label", "score")

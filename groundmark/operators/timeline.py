"""Segments on a time line: clamped extents, gaps and overlaps, reports, and range joins by time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import seconds_between, seconds_later
from .ordered import last_known, neighbours, places, quantiles

GAP_S = 1.5

#: Levels of time buckets, and by how many bits each is wider than the one below.
LEVELS, STEP_BITS = 10, 3


def _bucket(instant: Column, width_s: float) -> Column:
    return F.floor(F.unix_micros(instant) / (width_s * 1e6)).cast("long")


def followed(segments: DataFrame, by: list[str], bucket_s: float = 3600.0) -> DataFrame:
    """`segments` (start_utc, duration_s, name) with their own end and the struct `next` of the one that starts next."""
    ended = segments.withColumn("end_utc", seconds_later(F.col("start_utc"), F.col("duration_s")))
    return neighbours(ended, by, F.struct("start_utc", "name"), _bucket(F.col("start_utc"), bucket_s))


def extents(segments: DataFrame, by: list[str], bucket_s: float = 3600.0) -> DataFrame:
    """`segments` with `until_utc`: their end, but not past the start of the next, nor before their own start."""
    clamped = F.greatest("start_utc", F.least("end_utc", F.col("next.start_utc")))
    return followed(segments, by, bucket_s).withColumn("until_utc", clamped).drop("next")


def gaps(segments: DataFrame, by: list[str], tolerance_s: float = GAP_S, bucket_s: float = 3600.0) -> DataFrame:
    """(by, after, before, kind, start_utc, seconds): where the next start is over `tolerance_s` off the unclamped end."""
    apart = seconds_between(F.col("next.start_utc"), F.col("end_utc"))
    found = followed(segments, by, bucket_s).withColumn("delta", apart).filter(F.abs("delta") > tolerance_s)
    return found.select(
        *by, F.col("name").alias("after"), F.col("next.name").alias("before"), F.when(F.col("delta") > 0, "gap").otherwise("overlap").alias("kind"),
        F.col("end_utc").alias("start_utc"), F.abs("delta").alias("seconds"),
    )


def report_head(found: DataFrame, by: list[str], shown: int = 10, bucket_s: float = 30 * 86_400.0) -> DataFrame:
    """The first `shown` gaps of each key by their start, with how many `more` there are; of a report's list, as it is printed."""
    rows = places(found, by, ["start_utc", "after"], _bucket(F.col("start_utc"), bucket_s), "place", "_total")
    return rows.filter(F.col("place") <= shown).withColumn("more", F.greatest(F.col("_total") - shown, F.lit(0))).drop("_total")


def holds(segment_start: Column, duration_s: Column, instant: Column) -> Column:
    """Whether an instant lies in a segment: at its start or later, and before its end."""
    return (instant >= segment_start) & (instant < seconds_later(segment_start, duration_s))


def fps_outliers(segments: DataFrame, target_fps: float) -> DataFrame:
    return segments.filter(F.abs(F.col("fps") - target_fps) > 1.0)


def report(segments: DataFrame, by: list[str], target_fps: float | None = None, tolerance_s: float = GAP_S, bucket_s: float = 3600.0) -> DataFrame:
    """One row a key: segments, first and last instant, recorded and spanned seconds, coverage, gaps, overlaps, outliers.

    Recorded seconds are of clamped extents, so coverage is at most 1; it is 0 if nothing is spanned. Without `by`, no
    segments give one row of zeros.
    """
    apart = seconds_between(F.col("next.start_utc"), F.col("end_utc"))
    until = F.greatest("start_utc", F.least("end_utc", F.col("next.start_utc")))
    rows = followed(segments, by, bucket_s).withColumn("delta", apart).withColumn("until_utc", until)
    off = F.abs(F.col("fps") - target_fps) > 1.0 if target_fps else F.lit(False)
    span = seconds_between(F.col("last_utc"), F.col("first_utc"))
    # the last extent ends last: those before it end at or before its start
    found = rows.groupBy(*by).agg(
        F.count("*").alias("segments"), F.min("start_utc").alias("first_utc"), F.max("until_utc").alias("last_utc"),
        F.coalesce(F.sum(seconds_between(F.col("until_utc"), F.col("start_utc"))), F.lit(0.0)).alias("recorded_s"),
        F.count_if(F.col("delta") > tolerance_s).alias("gaps"), F.count_if(F.col("delta") < -tolerance_s).alias("overlaps"),
        F.coalesce(F.sum(F.when(F.col("delta") > tolerance_s, F.col("delta"))), F.lit(0.0)).alias("gap_s"), F.count_if(off).alias("fps_outliers"),
    )
    found = found.withColumn("span_s", F.coalesce(span, F.lit(0.0)))
    return found.withColumn("coverage", F.when(F.col("span_s") > 0, F.col("recorded_s") / F.col("span_s")).otherwise(0.0))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width_s: float, points: bool = False, short: bool = False) -> DataFrame:
    """Pairs of rows with equal `on` whose half-open ranges overlap: left end > right start, left start < right end.

    Time is cut into buckets of `width_s` and, level by level, into buckets that are `2 ** STEP_BITS` times as wide. A range
    is put into the buckets it meets at its own level, the first where they are about `2 ** STEP_BITS` at most, and into
    the few of each level above, so a row becomes some thirty rows at most however long its range. Two ranges meet at the
    higher of their levels, in the first bucket they share, by an equality join that Spark can split where it is hot. With
    `points`, the left side is instants: start and end are one column, and a start of the right side is inside. Instants, and
    left ranges that the caller says are `short` beside `width_s`, are all at the first level, so a range of the right side
    is put into the buckets of its own level alone.
    """
    def at_level(c: str | Column, level: Column) -> Column:
        return F.call_function("shiftright", F.col(c) if isinstance(c, str) else c, (level * STEP_BITS).cast("int"))

    low = points or short

    def cut(df: DataFrame, ends: tuple[str, str], tag: str) -> DataFrame:
        first, last = _bucket(F.col(ends[0]), width_s), _bucket(F.col(ends[1]), width_s)
        df = df.filter(F.col(ends[0]).isNotNull() & F.col(ends[1]).isNotNull() & (F.col(ends[0]) <= F.col(ends[1])))
        df = df.withColumns({"_first": first, "_last": last})
        own = F.lit(LEVELS - 1)
        for level in reversed(range(LEVELS - 1)):
            few = at_level("_last", F.lit(level)) - at_level("_first", F.lit(level)) <= 1 << STEP_BITS
            own = F.when(few, level).otherwise(own)
        own = F.lit(0) if low and tag == "l" else own
        levels = F.col(f"_own_{tag}") if low and tag == "r" else F.explode(F.sequence(F.col(f"_own_{tag}"), F.lit(LEVELS - 1)))
        df = df.withColumn(f"_own_{tag}", own).withColumn("_level", levels)
        df = df.withColumns({f"_{tag}": at_level("_first", F.col("_level")), "_last": at_level("_last", F.col("_level"))})
        return df.withColumn("_bucket", F.explode(F.sequence(f"_{tag}", "_last"))).drop("_first", "_last")

    both = cut(left, left_range, "l").join(cut(right, right_range, "r"), [*on, "_level", "_bucket"])
    later = F.col(left_range[1]) >= F.col(right_range[0]) if points else F.col(left_range[1]) > F.col(right_range[0])
    here = (F.col("_level") == F.greatest("_own_l", "_own_r")) & (F.col("_bucket") == F.greatest("_l", "_r"))
    overlap = later & (F.col(left_range[0]) < F.col(right_range[1])) & here
    return both.filter(overlap).drop("_bucket", "_level", "_l", "_r", "_own_l", "_own_r")


def covering(windows: DataFrame, segments: DataFrame, by: list[str], clamped: bool = True, width_s: float = 60.0, short: bool = False) -> DataFrame:
    """`windows` (from_utc, to_utc) with the segments that they overlap: by clamped extents, or for cutting by raw ones.

    `short` says that no window is much longer than `width_s`.
    """
    if clamped:
        spans = extents(segments, by)
    else:
        spans = segments.withColumn("until_utc", seconds_later(F.col("start_utc"), F.col("duration_s")))
    return overlap_join(windows, spans, by, ("from_utc", "to_utc"), ("start_utc", "until_utc"), width_s, short=short)


def resolve(instants: DataFrame, segments: DataFrame, by: list[str], when: str = "when_utc", width_s: float = 60.0) -> DataFrame:
    """`instants` inside a recording, with the segment's name, the offset in it and the frame (null without a rate)."""
    spans = extents(segments, by).select(*by, "name", "start_utc", "until_utc", "fps")
    found = overlap_join(instants, spans, by, (when, when), ("start_utc", "until_utc"), width_s, points=True)
    offset = seconds_between(F.col(when), F.col("start_utc"))
    frame = F.when(F.col("fps") != 0, (offset * F.col("fps")).cast("int"))
    return found.select(*instants.columns, F.col("name").alias("segment"), offset.alias("offset_s"), frame.alias("frame_index"))


def cut_plan(landings: DataFrame, segments: DataFrame, by: list[str], before_s: float = 3.0, after_s: float = 5.0) -> DataFrame:
    """For each landing (id, touchdown_utc): the pieces of segments that its clip is cut from, by raw extents."""
    windows = landings.filter("touchdown_utc is not null").select(*by, "id", seconds_later(F.col("touchdown_utc"), F.lit(-before_s)).alias("from_utc"), seconds_later(F.col("touchdown_utc"), F.lit(after_s)).alias("to_utc"))
    width_s = max(60.0, before_s + after_s)
    found = covering(windows, segments, by, clamped=False, width_s=width_s, short=True)
    offset = seconds_between(F.greatest("from_utc", "start_utc"), F.col("start_utc"))
    length = seconds_between(F.least("to_utc", "until_utc"), F.greatest("from_utc", "start_utc"))
    return found.select(*by, "id", "name", offset.alias("offset_s"), length.alias("duration_s"))


def first_differences(df: DataFrame, by: list[str], at: str, tie: str, bucket_s: float = 86_400.0) -> DataFrame:
    """`df` with `gap_s`, the seconds since the row before it of the same key; null for the first."""
    seen = neighbours(df, by, F.struct(at, tie), _bucket(F.col(at), bucket_s), following=False, name="_prev")
    return seen.withColumn("gap_s", seconds_between(F.col(at), F.col(f"_prev.{at}"))).drop("_prev")


def spacing(differences: DataFrame, by: list[str], tolerance: float = 0.2) -> DataFrame:
    """(by, n, median_s, irregular_share): the share of intervals that are off the median by over `tolerance` of it."""
    rows = differences.filter("gap_s is not null")
    middle = quantiles(rows, by, "gap_s", [0.5]).select(*by, F.col("quantiles")[0].alias("median_s"))
    off = F.abs(F.col("gap_s") - F.col("median_s")) > F.col("median_s") * tolerance
    return rows.join(middle, by).groupBy(*by).agg(F.count("*").alias("n"), F.first("median_s").alias("median_s"), F.avg(off.cast("double")).alias("irregular_share"))


def median3(df: DataFrame, by: list[str], order: str, tie: str, value: str, bucket: Column) -> DataFrame:
    """`df` with `smooth`: the median of each value and its neighbours; the first and last of a key stay as they are."""
    row = F.struct(order, tie, value)
    near = neighbours(neighbours(df, by, row, bucket, name="_next"), by, row, bucket, following=False, name="_prev")
    a, b, c = F.col("_prev")[value], F.col(value), F.col("_next")[value]
    middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    inside = F.col("_prev").isNotNull() & F.col("_next").isNotNull()
    return near.withColumn("smooth", F.when(inside, middle).otherwise(b)).drop("_prev", "_next")


def latest(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """(by, name): the value of the row of each key that comes last in order."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(name))


def previous_known(df: DataFrame, by: list[str], order: list[str], value: str, name: str, bucket_s: float = 30 * 86_400.0) -> DataFrame:
    """`df` with the last known `value` of the rows of the key before each row, as a suggestion for it.

    The first of `order` is an instant; its time is cut into buckets, so a key with very many rows is no single task.
    """
    return last_known(df, by, order, _bucket(F.col(order[0]), bucket_s), value, name)

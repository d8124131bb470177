"""What viewers and reports of a session ask for: windows of frames, lists of work, totals, medians over columns, lines on the ground."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import blank_to_null, finite, project, stripped

#: Frames on each side of the one looked at, and how near to an edge of the window it may come.
HALF_WINDOW, EDGE = 60, 5


def frame_window(rows: DataFrame, half: int = HALF_WINDOW, edge: int = EDGE) -> DataFrame:
    """`rows` (frame, total, cached_first, cached_count, fps) with the frame in bounds, the window's first frame and the offset.

    The window at hand stays as long as the frame is not near its edges; else one is cut around the frame.
    """
    frame = F.greatest(F.lit(0), F.least(F.col("frame"), F.greatest(F.lit(0), F.col("total") - 1)))
    rows = rows.withColumn("frame", frame)
    inside = F.col("frame").between(F.col("cached_first") + edge, F.col("cached_first") + F.col("cached_count") - edge - 1)
    first = F.when(F.coalesce(inside, F.lit(False)), F.col("cached_first")).otherwise(F.greatest(F.lit(0), F.col("frame") - half))
    return rows.withColumns({"first_frame": first, "reused": F.coalesce(inside, F.lit(False)), "offset_s": F.col("frame") / F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(60.0))})


def place_in_window(frame: Column, first: Column, paths: Column) -> Column:
    """The path of a frame in a window's list of paths; null outside."""
    return F.when(frame >= first, F.get(paths, (frame - first).cast("int")))


def frame_time(frame: Column, fps: Column) -> Column:
    return F.coalesce(F.try_divide(frame, F.nullif(fps, F.lit(0.0))), F.lit(0.0))


def local_time(instant: Column | str, zone: str, pattern: str = "HH:mm:ss") -> Column:
    """An instant as text in a zone; blank without one."""
    c = F.col(instant) if isinstance(instant, str) else instant
    return F.coalesce(F.date_format(F.from_utc_timestamp(c, zone), pattern), F.lit(""))


def session_title(session: Column | str) -> Column:
    """The day that a session's name begins with, in words; the name itself if it begins with none."""
    c = F.col(session) if isinstance(session, str) else session
    return F.coalesce(F.date_format(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")), "EEEE, dd MMMM yyyy"), c)


def indexed_only(requests: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Requests for segments that the index names."""
    return requests.join(index.select(*keys).distinct(), keys, "left_semi")


def waiting(known: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """What is known and not yet processed."""
    return known.join(processed.select(*keys), keys, "left_anti")


def gap_totals(gaps: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    return gaps.groupBy(*by).agg(F.count("*").alias("gaps"), F.sum(seconds).alias("gap_s"))


def recorder_status(sessions: DataFrame, counters: DataFrame, gaps: DataFrame, written: DataFrame) -> DataFrame:
    """One row a session: its latest counters, gaps and their seconds, files and gigabytes on disk; what is missing is 0.

    `counters` (session, key, value) are those of `files.progress`, `gaps` (session, seconds), `written` (session, files, bytes).
    """
    number = lambda k: F.max(F.when(F.col("key") == k, F.col("value").try_cast("double")))
    names = ("frame", "fps", "drop_frames", "dup_frames")
    latest = counters.groupBy("session").agg(*(number(k).alias(k) for k in names))
    held = gap_totals(gaps, ["session"], "seconds")
    out = sessions.select("session").distinct().join(latest, "session", "left").join(held, "session", "left").join(written.select("session", "files", "bytes"), "session", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("session", *(zero(k).alias(k) for k in names), zero("gaps").alias("gaps"), zero("gap_s").alias("gap_seconds"), zero("files").alias("segments"), (zero("bytes") / 1e9).alias("written_gb"))


def match_counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """(matched, landings): how many landings got another registration. Confirmed ones and those a judge named are not looked at."""
    old = before.select("id", blank_to_null(stripped("registration")).alias("_old"))
    free = (F.col("status") != "confirmed") & ~F.col("identified_by").eqNullSafe("judge")
    changed = free & ~blank_to_null(stripped("registration")).eqNullSafe(F.col("_old"))
    return after.join(old, "id", "left").agg(F.count_if(changed).alias("matched"), F.count("*").alias("landings"))


def frame_meta(frames: DataFrame, meta: DataFrame, keys: list[str], known_only: bool = False) -> DataFrame:
    """Frames with their recording's row; without one they are kept with nulls, or left out."""
    return frames.join(meta, keys, "inner" if known_only else "left")


def middle(values: Column) -> Column:
    """The median of an array without nulls; null if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def band_median(columns: Column, u: Column, half: float) -> Column:
    """The median over the columns (array of u, value) within `half` of `u`; null if under a third of them, or under three, have a finite value."""
    band = F.filter(columns, lambda x: F.abs(x["u"] - u) <= half)
    present = F.filter(F.transform(band, lambda x: x["value"]), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.size(present) >= F.greatest(F.lit(3), F.floor(F.size(band) / 3)), middle(present))


def smoothed(values: Column, width: int = 7) -> Column:
    """The running median of an array, its ends repeated outwards; an array shorter than `width` stays as it is."""
    last = F.size(values) - 1
    near = lambda i: F.transform(F.sequence(F.lit(-(width // 2)), F.lit(width // 2)), lambda d: F.get(values, F.greatest(F.lit(0), F.least(i + d, last))))
    return F.when(F.size(values) < width, values).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: middle(near(i))))


def far_sign(matrix: Sequence[Sequence[float]], width: Column, height: Column) -> Column:
    """1 if the ground's y grows away from the camera (upwards in the image), else -1."""
    near, far = (project(width / 2, height * share, matrix)[1] for share in (0.9, 0.6))
    return F.when(far >= near, 1.0).otherwise(-1.0)


def ground_lines(lines: DataFrame, inverse: Sequence[Sequence[float]]) -> DataFrame:
    """`lines` (x_m, y_from, y_to) with the pixels u1, v1, u2, v2 of their ends; lines with an end at infinity go."""
    ends = [project("x_m", y, inverse) for y in ("y_from", "y_to")]
    out = lines.withColumns({f"{c}{k}": at for k, end in enumerate(ends, 1) for c, at in zip("uv", end)})
    pixels = ("u1", "v1", "u2", "v2")
    return out.filter(finite(*pixels)).withColumns({c: F.bround(c, 0).cast("int") for c in pixels})

"""Checks of recording sources: stream properties, frame spacing, key-frame pattern, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles

#: Fixed values of the checks.
WIDTH, HEIGHT, FPS = 1920, 1080, 60.0
MIN_BIT_RATE, MAX_BIT_RATE = 8_000_000, 24_000_000
GOP, GOP_FACTOR, GOP_SPREAD = 60, 1.5, 2
IRREGULAR, IRREGULAR_SHARE = 0.2, 0.02


def _check(name: str, status: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), status.alias("status"), detail.alias("detail"))


def stream_checks(streams: DataFrame, target_fps: float = FPS) -> DataFrame:
    """(source, name, status, detail): five rows a source of (width, height, codec, pix_fmt, fps, bit_rate); null warns."""
    known = lambda c, text: F.coalesce(F.when(F.col(c).isNotNull(), text), F.lit("unknown"))
    passes = lambda ok, other="warn": F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise(other)
    codec = F.lower(F.coalesce("codec", F.lit("?")))
    near = F.abs(F.col("fps") - target_fps) < 0.5
    each = F.array(
        _check("resolution", passes((F.col("width") == WIDTH) & (F.col("height") == HEIGHT)), F.concat_ws("x", "width", "height")),
        _check("codec", passes(codec.isin("h264", "hevc")), codec),
        _check("pixel format", passes(F.col("pix_fmt") == "yuv420p"), F.coalesce("pix_fmt", F.lit("?"))),
        _check("declared fps", F.when(F.col("fps").isNull(), "warn").otherwise(passes(near, "fail")), known("fps", F.format_string("%.2f", "fps"))),
        _check("bitrate", passes(F.col("bit_rate").between(MIN_BIT_RATE, MAX_BIT_RATE)), known("bit_rate", F.format_string("%.1f Mbit/s", F.col("bit_rate") / 1e6))),
    )
    return streams.select("source", F.explode(each).alias("c")).select("source", "c.*")


def frame_checks(frames: DataFrame, target_fps: float = FPS, duration: DataFrame | None = None) -> DataFrame:
    """(source, name, status, detail) of measured rate, spacing and key frames, from frames (source, ordinal, pts, key_frame).

    `duration` (source, duration_s, nb_frames) may state how long a sample is and how many frames its container counts;
    else the last time stands in. Frames without a time count for key frames only.
    """
    by = Window.partitionBy("source").orderBy("ordinal")
    timed = frames.filter("pts is not null").withColumn("gap", F.col("pts") - F.lag("pts").over(by))
    median = quantiles(timed, ["source"], "gap", [0.5]).select("source", F.col("quantiles")[0].alias("median"))
    middle = timed.groupBy("source").agg(F.count("*").alias("frames"), F.max("pts").alias("last")).join(median, "source", "left")
    off = F.abs(F.col("gap") - F.col("median")) > IRREGULAR * F.col("median")
    share = timed.filter("gap is not null").join(middle, "source").groupBy("source").agg(F.avg(off.cast("double")).alias("share"))
    gops = frames.filter("key_frame").withColumn("gop", F.col("ordinal") - F.lag("ordinal").over(by)).groupBy("source").agg(F.min("gop").alias("shortest"), F.max("gop").alias("longest"))
    rows = middle.join(share, "source", "left").join(gops, "source", "left")
    if duration is not None:
        rows = rows.join(duration.select("source", F.nullif("duration_s", F.lit(0.0)).alias("duration_s"), "nb_frames"), "source", "left")
    else:
        rows = rows.withColumn("duration_s", F.lit(None).cast("double")).withColumn("nb_frames", F.lit(None).cast("int"))
    rows = rows.withColumn("seconds", F.coalesce("duration_s", "last"))
    enough = (F.col("frames") >= 2) & (F.col("seconds") > 0)
    measured = F.try_divide("frames", "seconds")
    spread = F.col("longest") - F.col("shortest")
    gop = F.when(F.col("longest").isNull(), "warn").when(spread > GOP_SPREAD, "fail").when(F.col("longest") > GOP * GOP_FACTOR, "warn").otherwise("pass")
    differs = (F.col("nb_frames") != 0) & (F.col("nb_frames") != F.col("frames"))
    each = F.array_compact(F.array(
        _check("measured fps", F.when(enough & (measured >= 0.98 * target_fps), "pass").otherwise("fail"), F.coalesce(F.format_string("%.2f", measured), F.lit("too few frames"))),
        F.when(enough & F.col("share").isNotNull(), _check("frame spacing", F.when(F.col("share") <= IRREGULAR_SHARE, "pass").otherwise("fail"), F.format_string("%.4f", "share"))),
        F.when(enough, _check("GOP", gop, F.concat_ws("-", "shortest", "longest"))),
        F.when(differs, _check("frame count", F.lit("warn"), F.concat_ws(" of ", "frames", "nb_frames"))),
    ))
    return rows.select("source", F.explode(each).alias("c")).select("source", "c.*")


def verdicts(checks: DataFrame) -> DataFrame:
    """(source, checks, failed, warnings, verdict): the worst status of each source."""
    failed, warned = F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "warn")
    worst = F.when(failed > 0, "fail").when(warned > 0, "warn").otherwise("pass")
    return checks.groupBy("source").agg(F.count("*").alias("checks"), failed.alias("failed"), warned.alias("warnings"), worst.alias("verdict"))

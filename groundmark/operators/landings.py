"""From the frames of tracks to landings: wheel, place on the ground, contact, plausibility, anchor.

Every step keeps to the track: frames are dealt and sorted by track for the wheel, many tracks at a time, written once, dealt by track again for the fits,
and what follows joins rows that already lie by track. A frame's profile is an array of columns of the silhouette's lower
edge (u, belly, gap, reach), its tyre candidates another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import finite, project, seconds_later
from ..sources.shared import stored
from .fits import outcomes
from .matching import not_seen
from .tracks import anchors, curves, plausible

PROFILE = (
    "track string, segment string, frame int, t double, clipped boolean, wheel_u double, lowest_u double, "
    "tyres array<struct<u:double,v:double,area:double>>, columns array<struct<u:double,belly:double,gap:double,reach:double>>"
)
#: Fixed values, in pixels: outliers of column and row, how far a tyre and a column may be from the wheel, half a band.
WHEEL_OUTLIER_PX, ROW_OUTLIER_PX, CAPTURE_PX, MISSING_PX, BAND_PX = 40.0, 8.0, 25.0, 25.0, 10.0
#: Fewest frames with a widest candidate, and with a tyre near the column, for which these count.
MIN_WIDEST, MIN_TYRES = 5, 3


def _nearest(values: pa.ListArray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list of structs the flat place of the one whose u is nearest the wanted, the first of equal ones, and how far
    it is; infinitely far where a list is empty."""
    lengths = np.nan_to_num(pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(float)).astype(int)
    u = values.flatten().field("u").to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(lengths)), lengths)
    away = np.abs(u - wanted[row])
    order = np.lexsort((np.arange(len(u)), away, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))] if len(u) else np.empty(0, int)
    place, far = np.zeros(len(lengths), int), np.full(len(lengths), np.inf)
    place[row[first]], far[row[first]] = first, away[first]
    return place, far


def _by_track(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows that are sorted by track as tables of whole tracks, about a batch each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.chunked_array([*(h[key].slice(len(h) - 1) for h in held[-1:]), batch[key]]).combine_chunks()
        code = both.dictionary_encode("encode").indices.to_numpy()
        new = np.flatnonzero(np.diff(code)) + (0 if held else 1)
        if len(new):
            if held or new[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, new[-1])]).combine_chunks()
            held = [batch.slice(new[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def wheel_points(profiles: DataFrame, key: str = "track") -> DataFrame:
    """`profiles` with `u`, `v` and `tyre_seen`: the wheel's point in each frame of a track.

    A curve in time through the widest candidates says where the wheel is; the tyre nearest that column is the wheel, and a
    second curve through the tyres' lower edges fills the frames without one and overrules those off it. A track with
    fewer than three tyres near the column takes the belly there in their place. A task holds a batch of tracks at a time,
    or one that is longer. Frames without a profile have no row.
    """
    schema = profiles.select("*", F.lit(0.0).alias("u"), F.lit(0.0).alias("v"), F.lit(True).alias("tyre_seen")).schema

    def run(group: pa.Table) -> pa.Table:
        only = lambda c: group[c].combine_chunks() if isinstance(group[c], pa.ChunkedArray) else group[c]
        number = lambda c: group[c].to_numpy().astype(float)
        start = np.flatnonzero(np.diff(only(key).dictionary_encode("encode").indices.to_numpy(), prepend=-1))
        track = np.repeat(np.arange(len(start)), np.diff(start, append=len(group)))
        enough = lambda which, least: (np.add.reduceat(which.astype(int), start) >= least)[track]
        t, widest, usable = number("t"), number("wheel_u"), ~group["clipped"].to_numpy().astype(bool)
        raw = np.where(np.isnan(widest), number("lowest_u"), widest)
        good = usable & ~np.isnan(widest)
        fitted, keep = curves(t, raw, np.where(enough(good, MIN_WIDEST), good, usable), WHEEL_OUTLIER_PX, start)
        column = np.where(keep, raw, fitted)
        tyres = only("tyres")
        place, away = _nearest(tyres, column)
        near = away <= CAPTURE_PX
        u, v = column.copy(), np.zeros(len(t))
        flat = tyres.flatten()
        if near.any():
            u[near] = flat.field("u").to_numpy(zero_copy_only=False)[place[near]]
            v[near] = flat.field("v").to_numpy(zero_copy_only=False)[place[near]]
        seen = enough(near, MIN_TYRES)
        bare = np.flatnonzero(~seen)
        if len(bare):
            belly = only("columns").take(pa.array(bare))
            place, _ = _nearest(belly, column[bare])
            v[bare] = belly.flatten().field("belly").to_numpy(zero_copy_only=False).astype(float)[place]
        row, on = curves(t, v, np.where(seen, near & usable, usable), ROW_OUTLIER_PX, start)
        for name, values in (("u", u), ("v", np.where(on, v, row)), ("tyre_seen", seen & on)):
            group = group.append_column(name, pa.array(values))
        return group

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Left out here: a filter would move below the expressions that make `columns`, and compute them several times.
        have = (b.filter(pc.fill_null(pc.greater(pc.list_value_length(b["columns"]), 0), False)) for b in batches)
        return (b for tracks in _by_track(have, key) for b in run(tracks).to_batches())

    rows = profiles.repartition(key).sortWithinPartitions(key, F.col("t").asc_nulls_last(), F.col("frame").asc_nulls_last())
    return rows.mapInArrow(runs, schema)


def _band_medians(row: np.ndarray, band: np.ndarray, value: np.ndarray, rows: int) -> pa.Array:
    """`band_median` of many rows at once: `row` and `value` of all their columns, and which of these are in the band."""
    present = np.flatnonzero(band & np.isfinite(value))
    n = np.bincount(row[present], minlength=rows)
    ranked = np.append(value[present][np.lexsort((value[present], row[present]))], np.nan)
    start = np.cumsum(n) - n
    low, high = (ranked[np.where(n > 0, start + k, -1)] for k in ((n - 1) // 2, n // 2))
    enough = n >= np.maximum(3, np.bincount(row[band], minlength=rows) // 3)
    return pa.array((low + high) / 2, mask=~enough)


def located(frames: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Frames of `wheel_points` as track points: place on the ground, gap and reach of the shadow in a band about the wheel.

    A frame whose profile has no column near the wheel, or whose point leaves the plane, has no row. A series needs a value
    in a third of the band's columns, and in three. The reach is taken from the belly, so it loses what lies between the
    belly and the wheel. The columns are read many frames at a time, as functions on arrays take each value by itself.
    """
    frames = frames.drop("tyres", "wheel_u", "lowest_u")
    none = F.lit(None).cast("double")
    schema = frames.drop("columns").select("*", none.alias("gap_px"), none.alias("_reach"), none.alias("_belly")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("columns")
            lengths = pc.fill_null(pc.list_value_length(columns), 0).to_numpy(zero_copy_only=False)
            row, flat = np.repeat(np.arange(len(lengths)), lengths), columns.flatten()
            number = lambda c: pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(float)  # noqa: E731, B023
            away = np.abs(number("u") - batch.column("u").to_numpy(zero_copy_only=False).astype(float)[row])
            near = np.bincount(row[away <= MISSING_PX], minlength=len(lengths)) > 0
            series = [_band_medians(row, away <= BAND_PX, number(c), len(lengths)) for c in ("gap", "reach", "belly")]
            kept = [c for c in batch.schema.names if c != "columns"]
            out = pa.record_batch([*(batch.column(c) for c in kept), *series], names=[*kept, "gap_px", "_reach", "_belly"])
            yield out.filter(pa.array(near))

    wx, wy = project("u", "v", matrix)
    rows = frames.mapInArrow(run, schema).withColumns({"world_x": wx, "world_y": wy})
    reach = F.when(F.col("_reach").isNotNull(), F.greatest(F.lit(0.0), F.col("_reach") - F.coalesce(F.col("v") - F.col("_belly"), F.lit(0.0))))
    return rows.withColumn("reach_px", reach).filter(finite("world_x", "world_y")).drop("_reach", "_belly")


def track_landings(
    profiles: DataFrame, matrix: Sequence[Sequence[float]], far_sign: float = 1.0, fps: float = 60.0, residual_m: float = 0.0,
    segments: DataFrame | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """One row a track of `profiles` (PROFILE): the landing, departure or pass that it shows.

    Points that touch the image's edge are no samples of the fit, but can be its anchor. `far_sign` is the sign of the ground's y
    away from the camera. `segments` (name, start_utc) gives instants; `known` (as for `not_seen`) leaves out tracks that were
    stored before. A track without a single point has no row; one with null frames or times is fitted from what it has.
    """
    points = stored(located(wheel_points(profiles), matrix), "track-points")
    if known is not None:
        row = lambda f: f(F.struct("segment", "frame"), F.struct("t", "frame"))
        ends = points.groupBy("track").agg(row(F.min_by).alias("a"), row(F.max_by).alias("b"))
        ends = ends.select("track", F.col("a.segment").alias("segment"), F.col("a.frame").alias("first_frame"), F.col("b.segment").alias("last_segment"), F.col("b.frame").alias("last_frame"))
        points = points.join(not_seen(ends, known).select("track"), "track", "left_semi")
    samples = points.filter(~F.col("clipped")).select("track", F.col("frame").alias("index"), "t", "world_x", (far_sign * F.col("world_y")).alias("world_y"), "gap_px", "reach_px")
    says = points.select("track").distinct().join(outcomes(samples, "track", fps, residual_m), "track", "left")
    says = says.withColumns({"outcome": F.coalesce("outcome", F.lit("unknown")), "method": F.coalesce("method", F.lit("none"))})
    anchored = anchors(points.select("track", "segment", "frame", "t", "u", "v", "world_x"), says, "track")
    extent = points.groupBy("track").agg(F.count("*").alias("points"), F.count_if("tyre_seen").alias("tyres"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    found = says.join(anchored, "track").join(extent, "track")
    direction = F.when(F.coalesce("velocity_mps", F.lit(0.0)) >= 0, 1).otherwise(-1)
    found = found.withColumn("direction", direction).withColumn("lateral_m", far_sign * F.col("world_y")).withColumn("longitudinal_m", F.when(F.col("outcome") == "measured", F.col("direction") * F.col("world_x")))
    found = plausible(found, residual_m=residual_m)
    timed = (F.col("outcome") == "measured") & F.col("contact_t").isNotNull()
    subframe = F.when(timed, F.col("anchor.frame") + (F.col("contact_t") - F.col("anchor.t")) * fps)
    out = found.select(
        "track", "kind", "outcome", "method", "longitudinal_m", "lateral_m", F.when(timed, F.col("uncertainty_m")).alias("uncertainty_m"),
        F.when(F.col("outcome").isin("short", "long"), F.col("direction") * F.col("bound_x")).alias("bound_m"), "direction", F.abs("velocity_mps").alias("speed_mps"), "contact_t",
        F.col("anchor.segment").alias("segment"), F.col("anchor.frame").alias("frame"), subframe.alias("subframe"), F.col("anchor.u").alias("image_x"), F.col("anchor.v").alias("image_y"),
        "flags", "points", "tyres", "first_t", "last_t",
    )
    if segments is None:
        return out
    starts = segments.select(F.col("name").alias("segment"), "start_utc")
    at = seconds_later(F.col("start_utc"), F.coalesce("subframe", "frame") / fps)
    return out.join(starts, "segment", "left").withColumn("touchdown_utc", at).drop("start_utc")

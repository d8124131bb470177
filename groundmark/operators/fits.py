"""Contact instants of tracks: two-leg fits over a grid of corners, from running sums, and what they say.

A corner at time c splits a track's samples; the least-squares fit of two legs that meet there needs only sums of t, t², y
and ty before and after c. Between two samples the error of such a fit is a squared line over a positive parabola of c,
plus a constant, so its least value is where the legs' own fits meet, or at an end: of the grid's corners between two
samples only the ends and those beside that point are evaluated, so a track costs a few corners a sample, however long its
pauses are. Depth and both shadow series of a track are fitted in one pass: one shuffle by track, windows, one aggregate.
Times count from a series' first sample and values from their mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import uncertainty_m
from .ordered import quantiles

#: Samples on each side of a corner, corners a sample, and what counts as a corner.
SIDE, SUBSTEPS = 4, 8
MIN_DROP_M, MIN_DROP_SIGMAS, MIN_IMPROVEMENT = 1.0, 4.0, 0.8
SHADOW_CHANGE_PX, SHADOW_FLAT_PX = 5.0, 4.0
AGREE_FRAMES, BRACKET_FRAMES, DRIFT_MAX_MPS = 4, 30, 3.0
#: Samples that one task sorts and fits, about; a sample becomes up to three rows of some fifty columns.
SAMPLES_A_TASK = 50_000
#: Decimals to which sums of squares are compared; the first of equal ones wins.
DIGITS = 9
#: Series of a track that are fitted by a hinge of two free legs; the others by a level and a leg.
DEPTH, SHADOWS = "depth", ("gap", "reach")
TERMS = ("t", "tt", "y", "ty", "yy")


def lines(samples: DataFrame, key: str, t: str = "t", y: str = "y") -> DataFrame:
    """(key, n, slope, intercept, rms): the least-squares line of each track; without spread in t a level."""
    sxx, sxy = F.regr_sxx(y, t), F.regr_sxy(y, t)
    found = samples.groupBy(key).agg(F.count(y).alias("n"), sxx.alias("sxx"), sxy.alias("sxy"), F.regr_syy(y, t).alias("syy"), F.avg(t).alias("mt"), F.avg(y).alias("my"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    found = found.withColumn("slope", slope)
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    return found.select(key, "n", "slope", (F.col("my") - F.col("slope") * F.col("mt")).alias("intercept"), F.sqrt(sse / F.col("n")).alias("rms"))


def spreads(rows: DataFrame, key: str, y: str) -> DataFrame:
    """(key, spread): between the exact 10 % and 90 % quantiles, interpolated; a key of any size is never held whole."""
    return quantiles(rows, [key], y, [0.1, 0.9]).select(key, (F.col("quantiles")[1] - F.col("quantiles")[0]).alias("spread"))


def long(samples: DataFrame, key: str, series: dict[str, str], t: str = "t") -> DataFrame:
    """(key, part, index, t, y): each named series of `samples` as rows of its own, without nulls."""
    each = F.array(*(F.struct(F.lit(part).alias("part"), F.col(y).cast("double").alias("y")) for part, y in series.items()))
    rows = samples.filter(F.col(t).isNotNull()).select(key, "index", F.col(t).alias("t"), F.explode(each).alias("s")).select(key, "s.part", "index", "t", "s.y")
    return rows.filter("y is not null")


def _summed(rows: DataFrame, key: str) -> DataFrame:
    """Centred rows with sums up to each (`b_`), of all (`a_`), and the ends and step of the grid of corners."""
    whole = Window.partitionBy(key, "part")
    at = whole.orderBy("t", "index")
    rows = rows.withColumn("first_t", F.min("t").over(whole)).withColumn("mean_y", F.avg("y").over(whole)).withColumn("n", F.count("*").over(whole))
    rows = rows.withColumn("t0", F.col("t") - F.col("first_t")).withColumn("y0", F.col("y") - F.col("mean_y"))
    terms = {"t": F.col("t0"), "tt": F.col("t0") * F.col("t0"), "y": F.col("y0"), "ty": F.col("t0") * F.col("y0"), "yy": F.col("y0") * F.col("y0")}
    so_far = at.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"place": F.row_number().over(at), "later": F.lead("t0").over(at)} | {f"b_{k}": F.sum(x).over(so_far) for k, x in terms.items()})
    edge = lambda place: F.max(F.when(F.col("place") == place, F.col("t0"))).over(whole)
    rows = rows.withColumns({f"a_{k}": F.sum(x).over(whole) for k, x in terms.items()} | {"last_t0": F.max("t0").over(whole)})
    step = F.median(F.col("later") - F.col("t0")).over(whole) / SUBSTEPS
    spread = F.when(F.col("part") != DEPTH, F.percentile("y", F.lit(0.9)).over(whole) - F.percentile("y", F.lit(0.1)).over(whole))
    return rows.withColumns({"spread": spread, "step": step, "lo": edge(SIDE), "hi": edge(F.col("n") - SIDE + 1)})


def _nodes(x: dict[str, np.ndarray], model: str) -> np.ndarray:
    """The corners k between a row and the next that can have the least error: ends, beside the meeting point, and beside
    where a shadow's leg starts or stops to rise."""
    n, nb, na = x["n"], x["place"], x["n"] - x["place"]
    after = {k: x[f"a_{k}"] - x[f"b_{k}"] for k in TERMS}
    t1, y1, t2, y2 = x["b_t"] / nb, x["b_y"] / nb, after["t"] / na, after["y"] / na
    s1 = (x["b_ty"] - x["b_t"] * y1) / (x["b_tt"] - x["b_t"] * t1)
    s2 = (after["ty"] - after["t"] * y2) / (after["tt"] - after["t"] * t2)
    if model == "hinge":
        points = [((y2 - s2 * t2) - (y1 - s1 * t1)) / (s1 - s2)]
    elif model == "departure":
        points = [t2 + (y1 - y2) / s2, (n * after["ty"] - x["a_y"] * after["t"]) / (n * after["y"] - x["a_y"] * na)]
    else:
        points = [t1 + (y2 - y1) / s1, (n * x["b_ty"] - x["a_y"] * x["b_t"]) / (n * x["b_y"] - x["a_y"] * nb)]
    beside = [np.fmax(x["_begin"], np.fmin(x["_end"], f((c - x["lo"]) / x["step"]))) for c in points for f in (np.floor, np.ceil)]
    return np.stack([x["_begin"], x["_end"], *beside], axis=1)


def _fitted(x: dict[str, np.ndarray], model: str) -> dict[str, np.ndarray]:
    """Parameters and error of the model with its corner at each of the nodes of each row; nan where there is none."""
    k = _nodes(x, model)
    x = {name: v[:, None] for name, v in x.items()}
    after = {c: x[f"a_{c}"] - x[f"b_{c}"] for c in TERMS}
    c, n, nb, na = x["lo"] + k * x["step"], x["n"], x["place"], x["n"] - x["place"]
    e1, e2, ey = x["b_t"] - c * nb, x["b_tt"] - 2 * c * x["b_t"] + c * c * nb, x["b_ty"] - c * x["b_y"]
    d1, d2, dy = after["t"] - c * na, after["tt"] - 2 * c * after["t"] + c * c * na, after["ty"] - c * after["y"]
    none = np.full(k.shape, np.nan)
    if model == "hinge":
        whole = n - e1 * e1 / e2 - d1 * d1 / d2
        k0 = (x["a_y"] - e1 * ey / e2 - d1 * dy / d2) / whole
        k1, k2, slope, good = (ey - e1 * k0) / e2, (dy - d1 * k0) / d2, none, (e2 > 0) & (d2 > 0) & (whole != 0)
        error = x["a_yy"] - k0 * x["a_y"] - k1 * ey - k2 * dy
    else:
        leg1, leg2, legy = (-e1, e2, -ey) if model == "landing" else (d1, d2, dy)
        den = n * leg2 - leg1 * leg1
        slope = (n * legy - leg1 * x["a_y"]) / den
        k0, k1, k2, good = (x["a_y"] - slope * leg1) / n, none, none, (den > 0) & (slope > 0)
        error = x["a_yy"] - k0 * x["a_y"] - slope * legy
    return {"k": k, "c": c, "k0": k0, "k1": k1, "k2": k2, "slope": slope, "sse": error, "good": good}


def _cornered(rows: DataFrame, key: str) -> DataFrame:
    """A row for each corner that may be a series' best, with model, k, place c, parameters and error; a series without has
    a row with a null model.

    Corners of one batch that are worse than another there by more than `DIGITS` bear are not written.
    """
    lo, step = F.col("lo"), F.col("step")
    last = F.ceil((F.col("hi") + step / 2 - lo) / step) - 1
    to = lambda x: F.ceil((x - lo) / step)
    fits = (F.col("n") >= 2 * SIDE) & (step > 0)
    rows = rows.withColumn("_begin", F.when(fits, F.greatest(F.lit(0), to(F.col("t0")))).cast("double"))
    rows = rows.withColumn("_end", F.when(fits, F.least(last, F.coalesce(to(F.col("later")) - 1, last))).cast("double"))
    kept = [key, "part", "n", "place", "first_t", "last_t0", "mean_y", "spread", "t0", "y0", *(f"{x}_{k}" for x in "ab" for k in TERMS)]
    numbers = ("n", "place", "lo", "step", "_begin", "_end", *(f"{x}_{k}" for x in "ab" for k in TERMS))
    added = ("k", "c", "k0", "k1", "k2", "slope", "sse")
    rows = rows.select(*kept, *(c for c in numbers if c not in kept))
    none = lambda kind: F.lit(None).cast(kind)
    schema = rows.select(*kept, none("string").alias("model"), *(none("double").alias(c) for c in added)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = [batch.column(c).dictionary_encode("encode").indices.to_numpy() for c in (key, "part")]
            series = np.cumsum(np.any([np.diff(c, prepend=c[:1]) != 0 for c in code], axis=0))
            x = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in numbers}
            depth, open_ = pc.equal(batch.column("part"), DEPTH).to_numpy(zero_copy_only=False), x["_begin"] <= x["_end"]
            at, models, found = [], [], []
            for model in ("hinge", "landing", "departure"):
                own = np.flatnonzero(open_ & (depth if model == "hinge" else ~depth))
                with np.errstate(all="ignore"):
                    fit = _fitted({c: v[own] for c, v in x.items()}, model)
                error = np.where(fit.pop("good") & ~np.isnan(fit["sse"]), fit["sse"], np.inf)
                least = np.full(series[-1] + 1, np.inf)
                np.minimum.at(least, series[own], error.min(axis=1, initial=np.inf))
                i, j = np.nonzero((error < np.inf) & (error <= least[series[own]][:, None] + 2 * 10.0**-DIGITS))
                at.append(own[i])
                models += [model] * len(i)
                found.append(np.stack([fit[c][i, j] for c in added]))
            bare = np.setdiff1d(series, series[np.concatenate(at)])
            at.append(np.searchsorted(series, bare))
            found.append(np.full((len(added), len(bare)), np.nan))
            values = np.concatenate(found, axis=1)
            columns = [*(batch.column(c).take(pa.array(np.concatenate(at))) for c in kept), pa.array([*models, *[None] * len(bare)], pa.string())]
            yield pa.record_batch([*columns, *(pa.array(v, mask=np.isnan(v)) for v in values)], names=[*kept, "model", *added])

    return rows.mapInArrow(run, schema)


def series_fits(rows: DataFrame, key: str) -> DataFrame:
    """One row a series (key, part) of `long`: extent, level, line, spread, and its best hinge, landing and departure corner.

    The first corner with the least error wins. A corner is a struct of tc, value there, slopes, rms and samples before it
    (`n_before`) and up to it (`n_upto`); a hinge also has the rms of its ground leg, the one closer to level.
    """
    rows = _cornered(_summed(rows, key), key)
    on = (F.col("t0") == F.col("c")).cast("int")  # a sample on the corner is not before it
    own = {"n": on, "t": on * F.col("t0"), "tt": on * F.col("t0") * F.col("t0"), "y": on * F.col("y0"), "ty": on * F.col("t0") * F.col("y0"), "yy": on * F.col("y0") * F.col("y0")}
    before = {"n": F.col("place") - on} | {k: F.col(f"b_{k}") - own[k] for k in TERMS}
    behind = {"n": F.col("n") - before["n"]} | {k: F.col(f"a_{k}") - before[k] for k in TERMS}

    def leg_error(s: dict[str, Column], slope: Column) -> Column:
        c, k0 = F.col("c"), F.col("k0")
        return s["yy"] - 2 * k0 * s["y"] + s["n"] * k0 * k0 - 2 * slope * (s["ty"] - c * s["y"]) + 2 * k0 * slope * (s["t"] - c * s["n"]) + slope * slope * (s["tt"] - 2 * c * s["t"] + c * c * s["n"])

    after_is_ground = F.abs("k2") <= F.abs("k1")
    ground = F.when(after_is_ground, leg_error(behind, F.col("k2")) / F.nullif(behind["n"], F.lit(0))).otherwise(leg_error(before, F.col("k1")) / F.nullif(before["n"], F.lit(0)))
    rms = F.sqrt(F.greatest("sse", F.lit(0.0)) / F.col("n"))
    corner = F.struct(
        (F.col("c") + F.col("first_t")).alias("tc"), (F.col("k0") + F.col("mean_y")).alias("y_at"), F.col("k1").alias("slope_before"), F.col("k2").alias("slope_after"), "slope",
        rms.alias("rms"), "sse", before["n"].alias("n_before"), F.col("place").alias("n_upto"), F.sqrt(F.greatest(ground, F.lit(0.0))).alias("rms_ground"),
    )
    order = F.struct(F.round("sse", DIGITS).alias("e"), "k")
    best = lambda m: F.min_by(corner, F.when((F.col("model") == m) & F.col("sse").isNotNull(), order)).alias(m)
    same = lambda c: F.first(c).alias(c)
    found = rows.groupBy(key, "part").agg(*(same(c) for c in ("n", "first_t", "last_t0", "mean_y", "spread", *(f"a_{k}" for k in TERMS))), best("hinge"), best("landing"), best("departure"))
    sxx, sxy = F.col("a_tt") - F.col("a_t") * F.col("a_t") / F.col("n"), F.col("a_ty") - F.col("a_t") * F.col("a_y") / F.col("n")
    syy = F.col("a_yy") - F.col("a_y") * F.col("a_y") / F.col("n")
    slope = F.when(sxx > 0, sxy / sxx).otherwise(0.0)
    return found.select(
        key, "part", "n", F.col("first_t").alias("t_first"), (F.col("first_t") + F.col("last_t0")).alias("t_last"), F.col("mean_y").alias("level"),
        F.sqrt(F.greatest(syy, F.lit(0.0)) / F.col("n")).alias("rms_level"), slope.alias("slope"), (F.col("mean_y") + (F.col("a_y") - slope * F.col("a_t")) / F.col("n")).alias("y_first"),
        F.sqrt(F.greatest(syy - slope * sxy, F.lit(0.0)) / F.col("n")).alias("rms_line"), "spread", "hinge", "landing", "departure",
    )


def hinges(samples: DataFrame, key: str, t: str = "t", y: str = "world_y") -> DataFrame:
    """The best hinge of each track with 8 samples or more: corner `tc`, value there, slopes before and after, rms.

    `samples` has key, index, t and y; `index` orders equal times. The first corner with the least error wins.
    """
    found = series_fits(long(samples, key, {DEPTH: y}, t), key).filter("hinge is not null")
    return found.select(key, "hinge.tc", "hinge.y_at", "hinge.slope_before", "hinge.slope_after", "n", F.col("t_first").alias("first_t"), "hinge.rms")


def _depth_verdict() -> Column:
    """What the apparent depth of a track says, from its row of `series_fits`: a hinge, a line, or a level.

    A hinge stands if its airborne leg departs from the ground leg by enough metres and residuals, and it explains the
    track better than one line. The ground leg is the one closer to level.
    """
    h = lambda c: F.col(f"hinge.{c}")
    after_is_ground = F.abs(h("slope_after")) <= F.abs(h("slope_before"))
    drop = F.abs(h("slope_before") - h("slope_after")) * F.when(after_is_ground, h("tc") - F.col("t_first")).otherwise(F.col("t_last") - h("tc"))
    sharp = ~((h("rms_ground") > 0) & (drop < MIN_DROP_SIGMAS * h("rms_ground")))
    hinge = F.coalesce((drop >= MIN_DROP_M) & F.coalesce(sharp, F.lit(True)) & (h("rms") <= MIN_IMPROVEMENT * F.col("rms_line")), F.lit(False))
    straight = (F.col("rms_line") < MIN_IMPROVEMENT * F.col("rms_level")) & (F.abs("slope") * (F.col("t_last") - F.col("t_first")) >= MIN_DROP_M)
    pick = lambda a, b, c: F.when(hinge, a).when(straight, b).otherwise(c)
    return F.struct(
        F.when(F.col("n") < 2, "none").when(hinge, "hinge").when(straight, "line").otherwise("level").alias("model"), F.when(hinge, h("tc")).alias("tc"),
        pick(h("y_at"), F.col("y_first"), F.col("level")).alias("y0"), pick(h("slope_before"), F.col("slope"), F.lit(0.0)).alias("slope_before"),
        pick(h("slope_after"), F.col("slope"), F.lit(0.0)).alias("slope_after"), pick(h("rms"), F.col("rms_line"), F.col("rms_level")).alias("rms"),
        F.when(hinge, h("n_before")).otherwise(F.col("n")).cast("long").alias("n_before"),
    )


def _shadow_verdict() -> Column:
    """What one shadow series says, from its row of `series_fits`: landing, departure, descending, climbing or flat; null
    with fewer than 8 samples."""
    spans = {"landing": F.col("landing.tc") - F.col("t_first"), "departure": F.col("t_last") - F.col("departure.tc")}
    stands = {m: F.coalesce(F.col(f"{m}.slope") * span >= SHADOW_CHANGE_PX, F.lit(False)) for m, span in spans.items()}
    first = stands["landing"] & (~stands["departure"] | (F.round("landing.sse", DIGITS) <= F.round("departure.sse", DIGITS)))
    best = F.when(first, F.col("landing")).when(stands["departure"], F.col("departure"))
    change = F.col("slope") * (F.col("t_last") - F.col("t_first"))
    flat = F.col("spread") < SHADOW_FLAT_PX
    cornered = F.coalesce(best["rms"] <= MIN_IMPROVEMENT * F.col("rms_line"), F.lit(False)) & ~flat
    trend = F.col("rms_line") < 0.5 * F.abs(change)
    model = F.when(flat, "flat").when(cornered, F.when(first, "landing").otherwise("departure")).when(trend & (change <= -SHADOW_CHANGE_PX), "descending").when(trend & (change >= SHADOW_CHANGE_PX), "climbing").otherwise("flat")
    air = F.when(first, best["n_before"]).otherwise(F.col("n") - best["n_upto"])
    slope = F.when(cornered, F.when(first, -best["slope"]).otherwise(best["slope"])).when(model == "flat", 0.0).otherwise(F.col("slope"))
    return F.when(F.col("n") >= 2 * SIDE, F.struct(
        F.col("part").alias("series"), model.alias("model"), F.when(cornered, best["tc"]).alias("tc"), slope.alias("slope_px_s"),
        F.when(cornered, best["rms"]).when(flat, F.col("rms_level")).otherwise(F.col("rms_line")).alias("rms_px"), F.when(cornered, air).when(model == "flat", 0).otherwise(F.col("n")).cast("long").alias("n_air"),
    ))


def _median3(rows: DataFrame, key: str) -> DataFrame:
    """`rows` of `long` with each shadow value as the median of three neighbours; ends, and series of fewer than 3, unchanged."""
    at = Window.partitionBy(key, "part").orderBy("t", "index")
    rows = rows.withColumn("_a", F.lag("y").over(at)).withColumn("_b", F.lead("y").over(at))
    middle = F.greatest(F.least("_a", "y"), F.least(F.greatest("_a", "y"), F.col("_b")))
    return rows.withColumn("y", F.when((F.col("part") != DEPTH) & F.col("_a").isNotNull() & F.col("_b").isNotNull(), middle).otherwise(F.col("y"))).drop("_a", "_b")


def verdicts(samples: DataFrame, key: str) -> DataFrame:
    """(key, hinge, gap): what the depth says, and what the shadows do: the tyre gap where it is a corner, else the reach
    where that says anything, else the gap again."""
    rows = _median3(long(samples, key, {DEPTH: "world_y", "gap": "gap_px", "reach": "reach_px"}), key)
    each = series_fits(rows, key)
    each = each.select(key, "part", F.when(F.col("part") == DEPTH, _depth_verdict()).alias("d"), F.when(F.col("part") != DEPTH, _shadow_verdict()).alias("s"))
    of = lambda part, c: F.first(F.when(F.col("part") == part, F.col(c)), ignorenulls=True)
    wide = each.groupBy(key).agg(of(DEPTH, "d").alias("hinge"), of("gap", "s").alias("fine"), of("reach", "s").alias("coarse"))
    cornered = F.coalesce(F.col("fine.model").isin("landing", "departure"), F.lit(False))
    says = F.coalesce(F.col("coarse.model") != "flat", F.lit(False))
    return wide.select(key, "hinge", F.when(cornered, F.col("fine")).when(says, F.col("coarse")).otherwise(F.coalesce("fine", "coarse")).alias("gap"))


def _line(x: Column, d: Column, name: str) -> Column:
    """Aggregates of the line of x over d as a struct: place at 0, slope, rms and count."""
    sxx, sxy = F.regr_sxx(x, d), F.regr_sxy(x, d)
    slope = F.coalesce(sxy / F.nullif(sxx, F.lit(0.0)), F.lit(0.0))
    return F.struct((F.regr_avgy(x, d) - slope * F.regr_avgx(x, d)).alias("x"), slope.alias("v"), F.sqrt(F.greatest(F.lit(0.0), F.regr_syy(x, d) - slope * sxy) / F.nullif(F.regr_count(x, d), F.lit(0))).alias("rms"), F.regr_count(x, d).alias("n")).alias(name)


def positions(samples: DataFrame, instants: DataFrame, key: str, t: str = "t", x: str = "world_x", after: bool = True) -> DataFrame:
    """(key, x, v, rms_x, n_x): place and speed at `tc` from the line through the samples after it (or before it).

    With fewer than three samples there, from all of the track. Both lines come from one aggregate, combined before the shuffle.
    """
    rows = samples.join(instants.select(key, "tc"), key)
    d = F.col(t) - F.col("tc")
    leg = d >= 0 if after else d <= 0
    found = rows.groupBy(key).agg(_line(F.when(leg, F.col(x)), d, "leg"), _line(F.col(x), d, "all"))
    return found.select(key, F.when(F.col("leg.n") < 3, F.col("all")).otherwise(F.col("leg")).alias("l")).select(key, "l.x", "l.v", F.col("l.rms").alias("rms_x"), F.col("l.n").alias("n_x"))


def outcomes(samples: DataFrame, key: str, fps: float = 60.0, residual_m: float = 0.0) -> DataFrame:
    """One row a track: outcome, contact instant, position, speed, uncertainty, bound, method and flags.

    `samples` has key, index, t, world_x, world_y, gap_px and reach_px. A shadow corner decides; a depth hinge that agrees
    within `BRACKET_FRAMES` is averaged with it; a shadow trend says long or departure; else the depth decides alone, and
    without a descent the contact is unseen. Tracks of fewer than 8 samples are unknown. The samples are dealt by track
    once; fits and position read them from that one shuffle, of so many parts that none grows with the number of tracks.
    """
    samples = samples.select(key, "index", "t", "world_x", "world_y", "gap_px", "reach_px")
    parts = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-samples.count() // SAMPLES_A_TASK))
    samples = samples.repartition(parts, key)
    says = verdicts(samples, key)
    h, g = lambda c: F.col(f"hinge.{c}"), lambda c: F.col(f"gap.{c}")
    gm = F.coalesce(g("model"), F.lit("none"))
    corner = gm.isin("landing", "departure")
    is_hinge = F.coalesce(h("model") == "hinge", F.lit(False))
    convex = is_hinge & (h("slope_after") > h("slope_before"))
    ground_after = F.abs(h("slope_after")) <= F.abs(h("slope_before"))
    off = F.abs(h("tc") - g("tc")) * fps
    agrees = corner & convex & (ground_after == (gm == "landing"))
    joined = agrees & (off <= BRACKET_FRAMES)
    trend = gm.isin("descending", "climbing")
    steep = (h("model") == "line") & (F.abs(h("slope_before")) > DRIFT_MAX_MPS)
    outcome = (
        F.when(gm == "landing", "measured").when(corner, "departure").when(gm == "descending", "long").when(trend, "departure")
        .when(convex, F.when(ground_after, "measured").otherwise("departure")).when(steep, F.when(h("slope_before") < 0, "long").otherwise("departure"))
        .when(h("model").isin("level", "line", "hinge"), "unseen").otherwise("unknown")
    )
    tc = F.when(joined, (h("tc") + g("tc")) / 2).when(corner, g("tc")).when(~trend & convex, h("tc"))
    says = says.withColumn("tc", F.when(outcome.isin("measured", "departure"), tc))

    row, order = F.struct("t", "world_x"), F.struct("t", "index")
    d, leg = F.col("t") - F.coalesce("tc", "t"), F.col("t") >= F.col("tc")
    same = lambda c: F.first(c).alias(c)
    rows = samples.join(says, key, "left").groupBy(key).agg(
        F.count("*").alias("n"), F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"), _line(F.col("world_x"), F.col("t"), "whole"),
        _line(F.when(leg, F.col("world_x")), d, "ground"), _line(F.col("world_x"), d, "all"), same("hinge"), same("gap"), same("tc"),
    )
    short = F.col("n") < 2 * SIDE
    rows = rows.withColumn("outcome", F.when(short, "unknown").otherwise(outcome)).withColumn("tc", F.when(~short, F.col("tc")))
    method = F.when(short, "none").when(joined, "shadow+depth").when(corner | trend, "shadow").when(h("model") != "none", "depth").otherwise("none")
    rows = rows.withColumn("method", method).withColumn("at", F.when(F.col("ground.n") < 3, F.col("all")).otherwise(F.col("ground")))
    measured = (F.col("outcome") == "measured") & F.col("tc").isNotNull()
    x, v = F.when(measured, F.col("at.x")), F.when(measured, F.col("at.v")).otherwise(F.col("whole.v"))
    fall = F.abs(h("slope_before") - h("slope_after"))
    many = lambda c: F.sqrt(F.greatest(c, F.lit(1)))
    by_shadow = F.when(g("slope_px_s") != 0, g("rms_px") / F.abs(g("slope_px_s")) / many(g("n_air"))).otherwise(1 / fps)
    by_depth = F.when(fall != 0, h("rms") / fall / many(h("n_before"))).otherwise(1 / fps)
    sigma_t = F.greatest(F.when(F.col("method") == "shadow", by_shadow).otherwise(by_depth), F.when(joined, F.abs(h("tc") - g("tc")) / 2).otherwise(0.0))
    sigma = uncertainty_m(F.col("at.v"), sigma_t, F.col("at.rms"), F.col("at.n"), residual_m, F.lit(fps))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    flags = [
        ("track too short", short),
        ("shadow and depth cues apart; taken between", is_(joined) & (off > AGREE_FRAMES)),
        ("depth fit contradicts the shadow", is_(agrees) & ~is_(joined)),
        ("still descending when it left the window", F.col("outcome") == "long"),
        ("climbing for the whole track", (F.col("outcome") == "departure") & F.col("tc").isNull()),
        ("no shadow: decided from the depth trend alone", (F.col("method") == "depth") & is_(convex)),
        ("no descent seen", F.col("outcome") == "unseen"),
        ("touched down almost as it came into view", is_(measured & (F.col("tc") - F.col("first.t") < 6 / fps))),
        ("left the window right after touching down", is_(measured & (F.col("last.t") - F.col("tc") < 4 / fps))),
    ]
    y = F.when(F.col("outcome").isin("measured", "departure", "unseen") & (is_hinge | (F.col("method") == "depth")), h("y0"))
    return rows.select(
        key, "outcome", F.col("tc").alias("contact_t"), x.alias("world_x"), y.alias("world_y"), v.alias("velocity_mps"), F.when(measured, sigma).otherwise(0.0).alias("uncertainty_m"),
        F.when(F.col("outcome") == "long", F.col("last.world_x")).when(F.col("outcome") == "unseen", F.col("first.world_x")).alias("bound_x"), "method",
        F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in flags))).alias("flags"),
    )

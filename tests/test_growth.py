"""Work that must not grow faster than the input: texts read once, ranges dealt to few buckets, parts by the number of rows."""

import numpy as np
import pandas as pd
import pytest

from groundmark.operators import fits, timeline, tracks
from groundmark.sources import decode


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_blobs_are_chosen_as_by_arrays(monkeypatch):
    rng = np.random.default_rng(5)
    frames = np.sort(rng.integers(0, 120, 400))
    centres = np.round(rng.uniform(0, 900, (400, 2)))
    few = tracks.assigned(pd.Series(frames), centres, np.ones(400, bool), 220.0, 5)
    monkeypatch.setattr(tracks, "FEW", 0)
    many = tracks.assigned(pd.Series(frames), centres, np.ones(400, bool), 220.0, 5)
    assert few.tolist() == many.tolist() and few.max() > 5


def test_parts_follow_the_number_of_samples(spark, monkeypatch):
    monkeypatch.setattr(fits, "SAMPLES_A_TASK", 10)
    samples = spark.sql("select id % 20 as track, id as index, id / 60d as t, id * 1d as world_x, id * 1d as world_y, 1d as gap_px, 1d as reach_px from range(400)")
    assert "RepartitionByExpression [track" in _plan(fits.outcomes(samples, "track")) and ", 40" in _plan(fits.outcomes(samples, "track"))


@pytest.mark.parametrize("how", [{"points": True}, {"short": True}])
def test_beside_short_ranges_others_are_dealt_to_one_level(spark, how):
    left = spark.sql("select 1 as k, id as il, timestamp_seconds(id * 50) as al, timestamp_seconds(id * 50 + 8) as bl from range(200)")
    right = spark.sql("select 1 as k, id as ir, timestamp_seconds(id * 77) as ar, timestamp_seconds(id * 77 + id * id) as br from range(100)")
    ends = ("al", "al") if "points" in how else ("al", "bl")
    found = timeline.overlap_join(left, right, ["k"], ends, ("ar", "br"), 60.0, **how)
    assert _plan(found).count("Generate explode") == 3
    size = 0 if "points" in how else 8
    want = {(i, j) for i in range(200) for j in range(100) if i * 50 < j * 77 + j * j and (i * 50 + size > j * 77 or (not size and i * 50 == j * 77))}
    assert {(r["il"], r["ir"]) for r in found.select("il", "ir").collect()} == want


def test_landings_are_judged_with_one_reading_of_a_text(spark):
    rows = spark.createDataFrame([("a", "{}"), ("b", "x")], "k string, text string")
    judged = decode.judged_landings(rows)
    plan = _plan(judged.groupBy("reason").count())
    assert plan.count("json_object_keys") <= 3 and plan.count("from_json") + plan.count("from_json(".upper()) <= 3
    assert {r["k"]: r["reason"] for r in judged.collect()} == {"a": "misses created_utc, id, kind, outcome, session", "b": "no object"}


def test_of_a_track_only_corners_that_can_be_best_are_written(spark):
    """Not every node of every sample becomes a row, and bands are not read by functions on arrays."""
    from groundmark.operators import landings

    rows = [("a", i, i / 60, abs(i - 90) / 30 + (i * 37 % 11) / 1000, 5.0 + max(0, 90 - i)) for i in range(200)]
    samples = spark.createDataFrame(rows, "track string, index int, t double, world_y double, gap_px double")
    summed = fits._summed(fits.long(samples, "track", {fits.DEPTH: "world_y", "gap": "gap_px"}), "track")
    found = fits._cornered(summed, "track").collect()
    assert {r["model"] for r in found} == {"hinge", "landing"} and len(found) <= 20
    frames = landings.wheel_points(spark.createDataFrame([], landings.PROFILE))
    plan = _plan(landings.located(frames, ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))))
    assert "transform(" not in plan and "filter(" not in plan

import numpy as np
import pytest

from groundmark.operators import landings
from groundmark.plans.flights import PLANE


def frame(track, i, u=100.0, v=300.0, tyres=None, gap=5.0, clipped=False, wheel=True, columns=True, t=None):
    u, v = float(u), float(v)
    cols = [(u + 4.0 * k, v - 6.0, gap, None) for k in range(-6, 7)] if columns else []
    return (track, "s", i, i / 60 if t is None else t, clipped, u if wheel else None, u, [(u, v, 40.0)] if tyres is None else tyres, cols)


def table(spark, rows):
    return spark.createDataFrame(rows, landings.PROFILE)


def by_hand(rows):
    """The wheel's points of one track, frame by frame."""
    rows = sorted(rows, key=lambda r: (r[3], r[2]))
    t = np.array([r[3] for r in rows])
    usable = np.array([not r[4] for r in rows])

    def curve(raw, good, limit):
        if good.sum() < 3:
            return raw, good
        keep = good
        for _ in range(3):
            fit = np.polyfit(t[keep] - t[0], raw[keep], 2 if keep.sum() >= 8 else 1)
            error = np.abs(raw - np.polyval(fit, t - t[0]))
            again = good & (error <= max(limit, 3 * 1.4826 * np.median(error[keep])))
            if again.sum() < 3 or (again == keep).all():
                break
            keep = again
        at = np.polyval(fit, t - t[0])
        return at, keep & (np.abs(raw - at) <= limit)

    raw = np.array([r[5] if r[5] is not None else r[6] for r in rows])
    good = usable & np.array([r[5] is not None for r in rows])
    at, keep = curve(raw, good if good.sum() >= 5 else usable, 40)
    column = np.where(keep, raw, at)
    u, v, seen = column.copy(), np.zeros(len(rows)), np.zeros(len(rows), bool)
    for i, r in enumerate(rows):
        near = [x for x in r[7] or [] if abs(x[0] - column[i]) <= 25]
        if near:
            u[i], v[i], _ = min(near, key=lambda x: abs(x[0] - column[i]))
            seen[i] = True
    if seen.sum() >= 3:
        at, on = curve(v, seen & usable, 8)
        return [(r[2], a, b, bool(c)) for r, a, b, c in zip(rows, u, np.where(on, v, at), on)]
    belly = np.array([min(r[8], key=lambda x: abs(x[0] - c))[1] for r, c in zip(rows, column)])
    at, on = curve(belly, usable, 8)
    return [(r[2], a, b, False) for r, a, b in zip(rows, u, np.where(on, belly, at))]


@pytest.mark.parametrize("kind", ["tyres", "few tyres", "no widest", "short"])
def test_wheel_follows_the_tyre_as_by_hand(spark, kind):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(4 if kind == "short" else 50):
        u, v = 100 + 9 * i + rng.normal(0, 1), 300 + 0.05 * i * i + rng.normal(0, 1)
        tyres = [(u + 60, v - 9, 40.0), (u, v + (30 if i % 13 == 5 else 0), 40.0), (u - 3, v - 1, 5.0)]
        if i % 4 == 1 or (kind == "few tyres" and i > 1):
            tyres = [] if i % 8 == 1 else None
        row = list(frame("a", i, u, v, tyres, clipped=i < 3))
        row[5] = None if i % 5 == 2 or kind == "no widest" else u + (200 if i % 9 == 4 else 0)
        row[7] = tyres
        rows.append(tuple(row))
    found = landings.wheel_points(table(spark, rows[::-1]).repartition(3)).collect()
    got = sorted((r["frame"], r["u"], r["v"], r["tyre_seen"]) for r in found)
    want = sorted(by_hand(rows))
    assert [(f, s) for f, _, _, s in got] == [(f, s) for f, _, _, s in want]
    assert np.allclose([x[1:3] for x in got], [x[1:3] for x in want], atol=1e-6)


def test_band_needs_values_and_reach_is_from_the_belly(spark):
    rows = [frame("a", i) for i in range(5)]
    for i, reach in enumerate(([9.0] * 13, [None] * 13, [9.0, 9.0] + [None] * 11, [1.0] * 13, [float("nan")] * 13)):
        rows[i] = (*rows[i][:8], [(u, belly, gap, r) for (u, belly, gap, _), r in zip(rows[i][8], reach)])
    found = {r["frame"]: r for r in landings.located(landings.wheel_points(table(spark, rows)), PLANE).collect()}
    assert [found[i]["reach_px"] for i in range(5)] == [3.0, None, None, 0.0, None]
    assert all(found[i]["gap_px"] == 5.0 for i in range(5))
    assert found[0]["world_x"] == pytest.approx(-18.0) and found[0]["world_y"] == pytest.approx(11.0)


def test_landings_of_odd_tracks(spark):
    assert landings.track_landings(table(spark, []), PLANE).collect() == []
    rows = [frame("empty", i, columns=False) for i in range(20)]
    rows += [frame("clipped", i, u=100 + i, clipped=True) for i in range(20)]
    rows += [frame("short", i, u=100 + i) for i in range(5)]
    rows += [frame("still", i) for i in range(20)] + [frame("still", 7)]
    rows += [frame("at once", i, t=1.0) for i in range(20)]
    rows += [(*frame("no tyres", i, u=100 + 10 * i)[:7], None, frame("no tyres", i, u=100 + 10 * i)[8]) for i in range(20)]
    found = {r["track"]: r for r in landings.track_landings(table(spark, rows), PLANE).collect()}
    assert set(found) == {"clipped", "short", "still", "at once", "no tyres"}
    assert {k: (r["outcome"], r["kind"], r["points"]) for k, r in found.items()} == {
        "clipped": ("unknown", "pass", 20), "short": ("unknown", "pass", 5), "still": ("unseen", "landing", 21), "at once": ("unseen", "landing", 20), "no tyres": ("unseen", "landing", 20),
    }
    assert found["no tyres"]["tyres"] == 0 and found["clipped"]["frame"] == 10


def test_known_tracks_are_left_out_and_instants_come_from_the_segment(spark):
    import datetime as dt

    rows = [frame(k, i + 100 * n, u=100 + 10 * i) for n, k in enumerate("abc") for i in range(20)]
    known = spark.createDataFrame([("s", 2, "s", 900), ("s", 900, "s", 217)], "first_segment string, first_frame int, last_segment string, last_frame int")
    starts = spark.createDataFrame([("s", dt.datetime(2026, 9, 13, 12))], "name string, start_utc timestamp")
    found = landings.track_landings(table(spark, rows), PLANE, segments=starts, known=known).collect()
    assert [r["track"] for r in found] == ["b"]
    assert found[0]["touchdown_utc"] == dt.datetime(2026, 9, 13, 12) + dt.timedelta(seconds=round(found[0]["frame"] / 60, 6))


def test_curves_of_many_tracks_equal_one_by_one():
    from groundmark.operators.tracks import curve, curves

    rng = np.random.default_rng(3)
    sizes = [1, 2, 5, 9, 40, 60, 60]
    t = [np.arange(n) / 60 + k if n != 40 else np.full(n, 2.0) for k, n in enumerate(sizes)]
    raw = [100 + 500 * (x - x[0]) + rng.normal(0, 1, len(x)) + np.where(rng.random(len(x)) < 0.1, 200, 0) for x in t]
    good = [rng.random(n) < 0.8 for n in sizes]
    fitted, kept = curves(*map(np.concatenate, (t, raw, good)), 40.0, np.cumsum([0, *sizes[:-1]]))
    want = [curve(*x, 40.0) for x in zip(t, raw, good)]
    assert np.allclose(fitted, np.concatenate([x[0] for x in want]), atol=1e-6)
    assert (kept == np.concatenate([x[1] for x in want])).all()


def test_tracks_stay_whole_over_batches():
    import pyarrow as pa

    names = [None, None, *"aaabbcccccd"]
    for cut in range(1, 6):
        batches = pa.table({"track": names, "i": list(range(len(names)))}).to_batches(max_chunksize=cut)
        found = [x.to_pydict() for x in landings._by_track(iter(batches), "track")]
        assert [i for x in found for i in x["i"]] == list(range(len(names)))
        assert len({k for x in found for k in set(x["track"])}) == sum(len(set(x["track"])) for x in found)


def test_wheel_takes_many_tracks_at_a_time(spark):
    plan = landings.wheel_points(table(spark, [frame("a", 0)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "Filter" not in plan

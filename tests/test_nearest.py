import datetime as dt
import random

from groundmark.operators import matching
from groundmark.plans import records
from groundmark.schemas import Field, MatchLimits

BASE = dt.datetime(2026, 7, 18, 12, 0, 0, tzinfo=dt.timezone.utc)
FIELD, LIMITS = Field(airfield="X", lat=47.0, lon=7.0, elevation_m=0.0), MatchLimits(fix_window_s=20.0, logbook_window_s=20.0, close_s=2.0)


def at(s):
    return BASE + dt.timedelta(seconds=s)


def tables(spark, seed, n=150, span=90):
    """Whole seconds, few places and few aircraft, so that equal scores are frequent."""
    rng = random.Random(seed)
    touch = [(i, rng.randrange(span)) for i in range(n)]
    fixes = [(i, rng.randrange(span), rng.choice("ABCDEF"), rng.randrange(4) / 400) for i in rng.sample(range(10 * n), n)]
    events = [(i, rng.randrange(span), rng.randrange(span) if rng.random() < 0.5 else None) for i in rng.sample(range(10 * n), n)]
    t = spark.createDataFrame([(i, at(s)) for i, s in touch], "id int, touchdown_utc timestamp")
    f = spark.createDataFrame([(i, at(s), w, "", "", 47.0 + y, 7.0, 1.0) for i, s, w, y in fixes], "ordinal int, utc timestamp, flarm_id string, registration string, competition_number string, lat double, lon double, alt_m double")
    b = spark.createDataFrame([(i, str(i), "", "", at(off) if off is not None else None, at(s), "", {"flarm_id": ""}) for i, s, off in events], "ordinal int, registration string, competition_number string, aircraft_type string, takeoff_utc timestamp, landing_utc timestamp, landing_place string, raw map<string,string>")
    return touch, fixes, events, t, f, b


def test_fixes_and_logbook_equal_all_pairs_on_many_ties(spark):
    for seed in range(3):
        touch, _, events, t, f, b = tables(spark, seed, span=90 if seed else 900)
        away = {r["ordinal"]: r["d"] for r in f.select("ordinal", matching.haversine_m(f.lat, f.lon, matching.F.lit(47.0), matching.F.lit(7.0)).alias("d")).collect()}
        places = [(r["ordinal"], (r["utc"].astimezone(dt.timezone.utc) - BASE).total_seconds(), r["flarm_id"]) for r in f.collect()]
        got = {r["id"]: r["match"] for r in matching.match_fixes(t, f, FIELD, LIMITS).collect()}
        book = {r["id"]: r["match"] for r in matching.match_logbook(t, b, FIELD, LIMITS).collect()}
        seen = [(o, 0, s) for o, s, _ in events] + [(o, 1, s) for o, _, s in events if s is not None]
        for i, s in touch:
            near = [(abs(u - s) / 20.0 + away[o] / LIMITS.radius_m, o, w, u - s) for o, u, w in places if abs(u - s) <= 20 and away[o] <= LIMITS.radius_m]
            owners = {w: (min(x for x in near if x[2] == w)[0], min(x[1] for x in near if x[2] == w)) for _, _, w, _ in near}
            assert (i in got) == bool(near)
            if near:
                ranked = sorted(owners, key=owners.get)
                best = min(x for x in near if x[2] == ranked[0])
                assert (got[i]["flarm_id"], got[i]["dt_s"], got[i]["candidates"]) == (ranked[0], best[3], len(owners)), (seed, i)
                r = owners[ranked[1]][0] if len(ranked) > 1 else None
                sure = max(0.05, 1 - best[0] / 2) * (1.0 if r is None else min(1.0, (r - best[0]) / max(r, 1e-6) + 0.5))
                assert abs(got[i]["probability"] - sure) < 0.00501
            pairs = sorted((abs(u - s), o, p, u - s) for o, p, u in seen if abs(u - s) <= 20)
            assert (i in book) == bool(pairs)
            if pairs:
                sure = max(0.05, 1 - pairs[0][0] / 20) * (1.0 if len(pairs) == 1 else 0.5 if pairs[1][0] - pairs[0][0] < 2 else 0.8)
                assert (book[i]["registration"], book[i]["dt_s"], book[i]["candidates"]) == (str(pairs[0][1]), pairs[0][3], len(pairs))
                assert abs(book[i]["probability"] - sure) < 0.00501


def test_matching_joins_no_pairs(spark):
    """The rows of a window are not paired with its instants."""
    *_, t, f, b = tables(spark, 0)
    for found in (matching.match_fixes(t, f, FIELD, LIMITS), matching.match_logbook(t, b, FIELD, LIMITS)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan, plan


def test_wanted_frame_on_an_edge_is_the_same_in_any_order(spark, tmp_path):
    values = {1: [0.1] * 10, 2: [0.1] * 9 + [-0.2], 3: [1e8] + [0.1] * 9 + [-1e8]}
    rows = [(100 * u + i, BASE.replace(tzinfo=None), u, "view", v, "") for u, vs in values.items() for i, v in enumerate(vs)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        found = {r["id"]: r["wanted"] for r in records.nearest_track_point(spark, str(tmp_path)).collect()}
        assert found == {1: 1, 2: 0, 3: 0}

import datetime as dt
from pathlib import Path

import oracle
import pytest
from pyspark.sql import functions as F

from groundmark.functions import values
from groundmark.operators import calibration, checks, fits, matching, ordered, results, timeline, tracks
from groundmark.plans import catalogue, judging, records  # noqa: F401
from groundmark.schemas import Field, Rules
from groundmark.sources import files

TINY = "/root/testdata/sf0.001"
BASE = dt.datetime(2026, 7, 18, 12, 0, 0, tzinfo=dt.timezone.utc)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


@pytest.mark.skipif(not Path(TINY).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert oracle.differences(spark, TINY, catalogue.QUERIES[name], catalogue.ORACLES[name]) == []


def score_of(spark, x, outcome, rules=Rules()):
    return spark.createDataFrame([(x, outcome)], "x double, o string").select(values.score("x", "o", rules)).first()[0]


def test_scores(spark):
    want = [(0.0, "measured", 100), (-4.0, "measured", 80), (4.0, "measured", 92), (-30.0, "measured", 0), (None, "short", 0), (None, "long", 0), (1.0, "departure", None), (None, "unseen", None)]
    assert [score_of(spark, x, o) for x, o, _ in want] == [w for *_, w in want]
    assert score_of(spark, -1.25, "measured", Rules(decimals=1)) == 93.8
    assert score_of(spark, -1.9, "measured") == 90
    assert score_of(spark, -1.9, "measured", Rules(1000, 50, 20)) == 905
    with pytest.raises(ValueError):
        Rules(max_points=0)


def test_labels(spark):
    rows = [("measured", -1.9, None, "-1.9 m"), ("short", None, -17.4, "< -17 m"), ("long", None, 18.2, "> +18 m"), ("on_ground", None, None, "rolling"), ("measured", None, None, "?"), ("measured", -0.04, None, "-0.0 m")]
    df = spark.createDataFrame(rows, "o string, x double, b double, want string").withColumn("got", values.label("o", "x", "b"))
    assert [r["got"] for r in df.collect()] == [r[3] for r in rows]


def ranking_rows(spark):
    rows = [
        ("L0001", "landing", "confirmed", "anna", "HB-3213", 90.0, at(0)), ("L0002", "landing", "confirmed", "Beat", "", 100.0, at(600)),
        ("L0003", "landing", "confirmed", "Anna ", "HB-1234", 95.0, at(1200)), ("L0004", "landing", "confirmed", "", "D-KXYZ", 100.0, at(1800)),
        ("L0005", "landing", "pending", "", "HB-9999", None, at(0)), ("L0006", "landing", "rejected", "Nobody", "", 90.0, at(0)),
        ("L0007", "pass", "confirmed", "", "", None, at(0)),
    ]
    df = spark.createDataFrame(rows, "id string, kind string, status string, pilot string, registration string, score double, touchdown_utc timestamp")
    none = F.lit(None).cast("string")
    return df.withColumn("first_utc", F.col("touchdown_utc")).withColumn("competition_number", none).withColumn("aircraft_type", none)


def test_ranking(spark):
    df = ranking_rows(spark)
    found = [(r["name"], r["total"], r["n"], r["aircraft"]) for r in sorted(results.rank(df).collect(), key=lambda r: r["position"])]
    assert found == [("Anna", 185.0, 2, ["HB-3213", "HB-1234"]), ("Beat", 100.0, 1, []), ("D-KXYZ", 100.0, 1, ["D-KXYZ"])]
    assert [r["id"] for r in results.pending(df).collect()] == ["L0005"]
    assert results.next_id(df).first()[0] == "L0008"
    assert results.rank(df.limit(0)).collect() == []


def segments(spark, rows):
    return spark.createDataFrame([("s", n, at(a), float(d), f) for n, a, d, f in rows], "session string, name string, start_utc timestamp, duration_s double, fps double")


def test_report_and_resolve(spark):
    s = segments(spark, [("a", 0, 10, 60.0), ("b", 10, 10, 60.0), ("c", 40, 10, 50.0)])
    r = timeline.report(s, ["session"], 60.0).first()
    assert (r["gaps"], r["gap_s"], r["fps_outliers"], r["coverage"]) == (1, 20.0, 1, 0.6)
    empty = timeline.report(s.limit(0), []).first()
    assert (empty["segments"], empty["recorded_s"], empty["coverage"]) == (0, 0.0, 0.0)
    late = segments(spark, [("a", 0, 4, 60.0), ("b", 2, 10, 60.0)])
    r = timeline.report(late, ["session"]).first()
    assert r["overlaps"] == 1 and r["gaps"] == 0 and r["coverage"] <= 1
    points = spark.createDataFrame([("s", at(12.5)), ("s", at(25)), ("s", at(0))], "session string, when_utc timestamp")
    found = {r["segment"]: (r["offset_s"], r["frame_index"]) for r in timeline.resolve(points, s, ["session"]).collect()}
    assert found == {"b": (2.5, 150), "a": (0.0, 0)}
    point = spark.createDataFrame([("s", at(3))], "session string, when_utc timestamp")
    assert [(r["segment"], r["offset_s"]) for r in timeline.resolve(point, late, ["session"]).collect()] == [("b", 1.0)]


def test_ordered_helpers_do_not_depend_on_buckets(spark):
    rows = [(i % 2, i, (i * 7) % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    for width in (1, 7, 1000):
        got = {(r["k"], r["t"]): r["s"] for r in ordered.running_sum(df, ["k"], [F.col("t")], F.floor(F.col("t") / width), F.col("v"), "s").collect()}
        assert all(got[k, t] == sum(v for a, b, v in rows if a == k and b <= t) for k, t, _ in rows)
        near = {(r["k"], r["t"]): r["next"] and r["next"]["t"] for r in ordered.neighbours(df, ["k"], F.struct("t"), F.floor(F.col("t") / width)).collect()}
        assert all(near[k, t] == (t + 2 if t + 2 < 60 else None) for k, t, _ in rows)
    places = {r["t"]: r["position"] for r in ordered.numbered(df, F.col("v"), [F.col("v"), F.col("t")], buckets=4).collect()}
    assert [places[t] for _, t, _ in sorted(rows, key=lambda r: (r[2], r[1]))] == list(range(1, 61))


def test_fix_and_logbook_match(spark):
    field = Field(airfield="LSZX", lat=46.9769, lon=7.1269, elevation_m=434.0)
    touch = spark.createDataFrame([("L1", at(0.5))], "id string, touchdown_utc timestamp")
    fixes = spark.createDataFrame(
        [(0, at(0), "DD1", "HB-3380", "80", 46.9769, 7.1269, 440.0), (1, at(60), "DD2", "HB-1", "1", 47.2, 7.1269, 440.0)],
        "ordinal int, utc timestamp, flarm_id string, registration string, competition_number string, lat double, lon double, alt_m double",
    )
    sorties = spark.createDataFrame(
        [(0, "HB-3213", "", "", at(-400), at(60), "", {"flarm_id": ""}), (1, "HB-ORW", "", "", at(120), None, "lszx", {"flarm_id": ""}), (2, "HB-X", "", "", None, at(1), "OTHER", {"flarm_id": ""})],
        "ordinal int, registration string, competition_number string, aircraft_type string, takeoff_utc timestamp, landing_utc timestamp, landing_place string, raw map<string,string>",
    )
    m = matching.match_fixes(touch, fixes, field).first()["match"]
    assert (m["registration"], m["dt_s"], m["candidates"], m["probability"]) == ("HB-3380", -0.5, 1, 1.0)
    b = matching.match_logbook(touch, sorties, field).first()["match"]
    assert (b["registration"], b["event"], b["candidates"]) == ("HB-3213", "landing", 2)
    both = matching.identify(touch, fixes.limit(0), sorties, field).first()["match"]
    assert both["source"] == "logbook"


def track_rows(n=90, contact=0.8, sink=3.0, seed=1):
    import numpy as np

    rng = np.random.default_rng(seed)
    t = np.arange(n) / 60
    y = 3 + np.maximum(contact - t, 0) * sink + rng.normal(0, 0.05, n)
    x = -20 + 24 * t + rng.normal(0, 0.1, n)
    return [("a", i, float(t[i]), float(x[i]), float(y[i]), None, None) for i in range(n)]


SAMPLES = "track_id string, index int, t double, world_x double, world_y double, gap_px double, reach_px double"


def test_depth_hinge_against_least_squares(spark):
    import numpy as np

    rows = track_rows()
    found = fits.hinges(spark.createDataFrame(rows, SAMPLES), "track_id").first()
    t, y = np.array([r[2] for r in rows]), np.array([r[4] for r in rows])
    best = None
    for k in range(8 * (len(t) - 7) + 1):
        c = t[3] + k / 480
        if c > t[-4] + 1 / 960:
            break
        a = np.column_stack((np.ones(len(t)), np.minimum(t - c, 0), np.maximum(t - c, 0)))
        coef = np.linalg.lstsq(a, y, rcond=None)[0]
        sse = ((y - a @ coef) ** 2).sum()
        if best is None or sse < best[0] - 1e-9:
            best = (sse, c, coef)
    assert abs(found["tc"] - best[1]) < 1e-3 and abs(found["rms"] - np.sqrt(best[0] / len(t))) < 1e-6
    assert np.allclose([found["y_at"], found["slope_before"], found["slope_after"]], best[2], atol=1e-4)


def test_outcomes(spark):
    landed = fits.outcomes(spark.createDataFrame(track_rows(), SAMPLES), "track_id").first()
    assert landed["outcome"] == "measured" and abs(landed["contact_t"] - 0.8) < 0.05 and landed["method"] == "depth"
    rolled = fits.outcomes(spark.createDataFrame(track_rows(contact=0.0), SAMPLES), "track_id").first()
    assert rolled["outcome"] == "unseen"
    assert fits.outcomes(spark.createDataFrame(track_rows(5), SAMPLES), "track_id").first()["outcome"] == "unknown"
    assert fits.outcomes(spark.createDataFrame([], SAMPLES), "track_id").collect() == []


def test_tracker_keeps_two_aircraft_apart(spark):
    rows = [("s", i, i / 60, 100.0 + 10 * i, 50.0, 5000.0, 0) for i in range(20)] + [("s", i, i / 60, 1500.0 - 10 * i, 600.0, 5000.0, 1) for i in range(20)]
    rows += [("s", i, i / 60, 300.0, 50.0, 5000.0, 0) for i in range(200, 210)]
    df = spark.createDataFrame(rows, "session string, frame long, t double, cx double, cy double, area double, ordinal int")
    out = tracks.assign_tracks(df)
    sizes = sorted(r["count"] for r in out.groupBy("track").count().collect())
    assert sizes == [10, 20, 20]


def test_calibration_recovers_a_plane(spark):
    import numpy as np

    m = np.array([[0.02, 0.001, -15], [0.0005, 0.03, -10], [1e-5, 2e-4, 1]])
    rows = []
    for x, y in ((100, 100), (1800, 150), (900, 500), (200, 900), (1700, 950), (1000, 200)):
        a, b, c = m @ (x, y, 1)
        rows.append(("k", float(x), float(y), float(a / c), float(b / c)))
    df = spark.createDataFrame(rows, "k string, image_x double, image_y double, world_x double, world_y double")
    solved = calibration.solve(df, "k")
    assert np.allclose(solved.first()["matrix"], m.ravel(), atol=1e-6)
    assert calibration.residuals(df, solved, "k").first()["residual_m"] < 1e-6
    flat = df.withColumn("world_y", F.lit(0.0))
    assert calibration.geometry(flat, ["k"]).first()["problem"] == "ground_line"


def test_probe_checks(spark):
    frames = [("ok", i, i / 60, i % 60 == 0) for i in range(1800)] + [("slow", i, i / 30, i % 60 == 0) for i in range(900)]
    df = spark.createDataFrame(frames, "source string, ordinal int, pts double, key_frame boolean")
    got = {(r["source"], r["name"]): r["status"] for r in checks.frame_checks(df).collect()}
    assert got["ok", "measured fps"] == "pass" and got["slow", "measured fps"] == "fail"
    assert got["ok", "frame spacing"] == "pass" and got["ok", "GOP"] == "pass"
    assert {r["source"]: r["verdict"] for r in checks.verdicts(checks.frame_checks(df)).collect()} == {"ok": "pass", "slow": "fail"}


def test_log_folds(spark):
    log = [("L1", 1, "edit", " hb-1 ", "Anna", None), ("L1", 2, "confirm", "", "", "n"), ("L1", 3, "reopen", None, None, None), ("L2", 1, "reject", None, None, None)]
    df = spark.createDataFrame(log, "id string, seq int, action string, registration string, pilot string, note string").withColumn("at_utc", F.lit(at(0)))
    got = {r["id"]: r for r in judging.folded(judging.changes(df)).collect()}
    assert (got["L1"]["registration"], got["L1"]["pilot"], got["L1"]["status"], got["L1"]["confirmed_utc"]) == ("HB-1", "Anna", "pending", None)
    assert got["L1"]["history"] == ["edit", "confirm", "reopen"] and got["L2"]["status"] == "rejected"


def test_feeds(spark):
    page = '<m a="46.9,7.1,_80,HB-3380,440,12:00:00,3,90,100,-1.5,1,LSZX,0,DD1"/><m a="1,2"/><m a="x,7,a,b,1,2,3,4,5,6,7,8,9,10"/>'
    pages = spark.createDataFrame([(page, at(0.7))], "text string, now_utc timestamp")
    found = files.live_fixes(pages).collect()
    assert [(r["flarm_id"], r["competition_number"], r["alt_m"]) for r in found] == [("DD1", "80", 440.0)]
    assert found[0]["utc"].replace(tzinfo=dt.timezone.utc) == at(-3)
    book = '{"code": "LSZX", "devices": [{"registration": "HB-1", "address": "a"}, {"registration": "HB-2"}], "flights": [{"device": 0, "start_tsp": 10, "stop_tsp": 0}, {"start_tsp": 0, "towing": true}]}'
    got = files.flightbook(spark.createDataFrame([(book,)], "text string")).orderBy("ordinal").collect()
    assert [(r["registration"], r["aircraft_type"], r["landing_utc"]) for r in got] == [("HB-1", "", None), ("HB-2", " (tug)", None)]


def test_texts_and_names(spark):
    row = spark.range(1).select(
        values.redacted(F.lit("rtsp://user:pw@10.0.0.1/x")).alias("url"), values.rate(F.lit("60/1")).alias("fps"), values.rate(F.lit("0/0")).alias("none"),
        values.clip_name(F.lit(" hb-1/2 "), F.lit(3)).alias("clip"), values.clip_name(F.lit(""), F.lit(7)).alias("blank"), values.elapsed_text(F.lit(3725)).alias("t"),
        values.segment_start(F.lit("/x/2026-07-18_14-32-07.mp4"), 2.0).alias("start"),
    ).first()
    assert row["url"] == "rtsp://***@10.0.0.1/x" and row["fps"] == 60.0 and row["none"] is None
    assert (row["clip"], row["blank"], row["t"]) == ("HB-12", "UNKNOWN-007", "01:02:05")
    assert row["start"] == dt.datetime(2026, 7, 18, 12, 32, 7)


def test_ranges_of_any_length_against_brute_force(spark):
    import random

    rng = random.Random(1)
    start = lambda: rng.randrange(-(10**6), 10**8)
    sides = [[(rng.randrange(2), i, a, a + int(10 ** rng.uniform(0, 9))) for i in range(150) for a in [start()]] for _ in range(2)]
    left, right = (
        spark.createDataFrame(rows, f"k int, i{t} int, a{t} long, b{t} long").withColumns({c + t: F.timestamp_seconds(c + t) for c in "ab"})
        for rows, t in zip(sides, "lr")
    )
    found = timeline.overlap_join(left, right, ["k"], ("al", "bl"), ("ar", "br"), 60.0).select("il", "ir").collect()
    want = sorted((x[1], y[1]) for x in sides[0] for y in sides[1] if x[0] == y[0] and x[3] > y[2] and x[2] < y[3])
    assert sorted(map(tuple, found)) == want and want


def test_calibrations_logbooks_and_manifests_round_trip(spark, tmp_path):
    (tmp_path / "cal").mkdir()
    (tmp_path / "cal" / "a.json").write_text('{"matrix": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "markers": [{"image_x": 1, "image_y": 2, "world_x": 3, "world_y": 4, "label": "m"}],\n "residual_m": 0.05, "image_size": [1920, 1080], "acceptable": true, "target_residual_m": 0.1}')
    (tmp_path / "cal" / "b.json").write_text("no json")
    found = files.calibrations(spark, f"{tmp_path}/cal")
    assert [(r["markers"][0]["world_y"], r["image_size"], r["matrix"][2]) for r in found.collect()] == [(4.0, [1920, 1080], [0.0, 0.0, 1.0])]
    files.write_calibrations(found, f"{tmp_path}/again")
    assert spark.read.json(f"{tmp_path}/again").select("acceptable", "target_residual_m").first() == (True, 0.1)
    assert files.calibrations(spark, f"{tmp_path}/again").collect() == found.collect()

    assert files.saved_sorties(spark, f"{tmp_path}/none").collect() == []
    at = dt.datetime(2026, 9, 13, 10, 0)
    rows = [("D-1", "X", "", at, None, "HOME", {"flarm_id": "a"})]
    sorties = spark.createDataFrame(rows, files.SORTIE)
    files.save_sorties(sorties, f"{tmp_path}/book", at)
    assert [tuple(r) for r in files.saved_sorties(spark, f"{tmp_path}/book").collect()] == rows

    sessions = spark.createDataFrame([("s1", "rtsp://me:secret@cam/1", None, "tcp"), ("s2", "clip.mp4", 7200, "tcp")], "session string, source string, utc_offset_seconds int, rtsp_transport string")
    files.write_manifests(sessions, f"{tmp_path}/manifests")
    got = {r["session"]: r for r in spark.read.json(f"{tmp_path}/manifests").collect()}
    assert got["s1"]["source"] == "rtsp://***@cam/1" and got["s1"]["utc_offset_seconds"] == 0 and got["s1"]["rtsp_transport"] == "tcp"
    assert got["s2"]["rtsp_transport"] is None and got["s2"]["utc_offset_seconds"] == 7200


def test_frames_without_blobs_end_tracks_and_take_no_numbers(spark):
    rows = [(1, f, f / 60.0, None if 5 <= f < 5 + n else 100.0 + f, None if 5 <= f < 5 + n else 50.0, 9.0, f) for n in (3,) for f in range(12)]
    rows += [(2, f, f / 60.0, None if 5 <= f < 12 else 100.0 + f, None if 5 <= f < 12 else 50.0, 9.0, f) for f in range(16)]
    blobs = spark.createDataFrame(rows, "session int, frame int, t double, cx double, cy double, area double, ordinal int")
    found = {}
    for r in tracks.assign_tracks(blobs).collect():
        found.setdefault(r["session"], {}).setdefault(r["track"].split("-")[1], []).append(r["frame"])
    assert {k: sorted(v) for k, v in found[1].items()} == {"1": [0, 1, 2, 3, 4, 8, 9, 10, 11]}
    assert {k: sorted(v) for k, v in found[2].items()} == {"1": [0, 1, 2, 3, 4], "2": [12, 13, 14, 15]}

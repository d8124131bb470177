import datetime as dt
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from groundmark.plans import judging
from groundmark.schemas import FIX, LANDING, Field, Rules
from groundmark.sources import decode, files, store
from groundmark.streaming import keys

NOW = dt.datetime(2026, 9, 13, 12)
FIXED = {"utc": "2026-09-13T12:00:00Z", "flarm_id": "DD1", "registration": "HB-1", "competition_number": "1", "lat": 47.0, "lon": 7.1, "alt_m": 440.0, "track_deg": 1.0, "speed_kmh": 90.0, "climb_ms": 0.0, "aircraft_type": 1, "receiver": "R"}
BASE = {"id": "L1", "session": "s", "created_utc": "2026-09-13T12:00:00Z", "kind": "landing", "outcome": "measured"}
POINT = {"segment": "a", "frame": 1, "t": 0.1, "u": 1.0, "v": 2.0, "world_x": 3.0, "world_y": 4.0, "clipped": False}


def texts(spark, *records):
    return spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)], "n int, text string")


def test_landings_take_defaults_and_drop_what_they_do_not_know(spark):
    records = texts(spark, BASE, BASE | {"label": "x", "scored_longitudinal_m": 3.0, "later_key": [1]}, BASE | {"fps": None, "flags": ["f"], "direction": -1, "track": [POINT, POINT | {"gap_px": 2.0, "tyre_seen": True}]})
    good, rescued = decode.landing_records(records)
    a, b, c = sorted(good.collect(), key=lambda r: r["n"])
    assert rescued.collect() == []
    assert (a["status"], a["fps"], a["direction"], a["flags"], a["track"], a["registration"], a["note"], a["touchdown_utc"], a["pilot"]) == ("pending", 60.0, 1, [], [], "", "", None, "")
    assert {k: v for k, v in b.asDict().items() if k != "n"} == {k: v for k, v in a.asDict().items() if k != "n"}
    assert (c["fps"], c["flags"], c["direction"]) == (None, ["f"], -1)
    assert [(p["gap_px"], p["tyre_seen"]) for p in c["track"]] == [(None, False), (2.0, True)]


def test_records_that_do_not_decode_are_rescued_with_the_reason(spark):
    no_kind = {k: v for k, v in BASE.items() if k != "kind"}
    records = texts(spark, "{not json", "[1, 2]", None, no_kind, BASE | {"frame": "many"}, BASE | {"track": [POINT | {"odd": 1}]}, BASE | {"track": [{"segment": "a"}]}, BASE)
    good, rescued = decode.landing_records(records)
    assert [r["n"] for r in good.collect()] == [7]
    found = {r["n"]: r["reason"] for r in rescued.collect()}
    assert found == {
        0: "no object", 1: "no object", 2: "no object", 3: "misses kind", 4: "does not fit frame", 5: "has points off in odd", 6: "has points off in clipped, frame, t, u, v, world_x, world_y",
    }
    assert all(r["record"] == t for r, t in zip(sorted(rescued.collect(), key=lambda r: r["n"]), [r["text"] for r in records.orderBy("n").collect()]))


def test_fixes_with_other_keys_are_refused(spark, tmp_path):
    lines = [FIXED, FIXED | {"extra": 1}, {k: v for k, v in FIXED.items() if k != "lat"}, FIXED | {"lat": "north"}, FIXED | {"receiver": None}]
    (tmp_path / "fixes.jsonl").write_text("\n".join([json.dumps(x) for x in lines] + ["", "  ", "{broken"]))
    good, rescued = files.fix_lanes(spark, str(tmp_path / "fixes.jsonl"))
    assert sorted((r["lat"], r["receiver"] or "") for r in good.collect()) == [(47.0, ""), (47.0, "R")]
    assert sorted(r["reason"] for r in rescued.collect()) == ["does not fit lat", "knows no extra", "misses lat", "no object"]
    assert files.fixes(spark, str(tmp_path / "fixes.jsonl")).schema.simpleString() == spark.createDataFrame([], FIX).schema.simpleString()


def test_store_document_of_landings(spark, tmp_path):
    (tmp_path / "landings.json").write_text(json.dumps({"schema_version": 1, "landings": [BASE, {"id": "L2"}]}))
    (tmp_path / "broken.json").write_text("{")
    good, rescued = files.landing_lanes(spark, str(tmp_path))
    assert [r["id"] for r in good.collect()] == ["L1"] and [r["reason"] for r in rescued.collect()] == ["misses created_utc, kind, outcome, session"]


def test_settings_keep_defaults_for_what_cannot_be_read(spark, tmp_path):
    path = str(tmp_path / "field")
    assert files.settings(spark, path, Field) == Field()
    files.save_settings(spark, Field(airfield="LSZX", lat=46.9, enabled=True), path)
    assert files.settings(spark, path, Field) == Field(airfield="LSZX", lat=46.9, enabled=True)
    for text, want in (('﻿{"max_points": 1000, "decimals": 1, "other": 2}', Rules(max_points=1000.0, decimals=1)), ("{", Rules()), ('{"max_points": "many"}', Rules()), ('{"max_points": -1}', Rules()), ("", Rules())):
        (tmp_path / "rules.json").write_text(text)
        assert files.settings(spark, str(tmp_path / "rules.json"), Rules) == want


def landings(spark, n=4):
    kind = ", ".join(x for x in LANDING.split(", ") if x.split()[0] in ("id", "status", "outcome", "kind", "registration", "pilot", "note", "longitudinal_m", "confirmed_longitudinal_m", "confirmed_utc", "confirmed_frame"))
    rows = spark.createDataFrame([(f"L{i}",) for i in range(n)], "id string")
    have = {"id": F.col("id"), "status": F.lit("pending"), "outcome": F.lit("unseen"), "kind": F.lit("landing")}
    return rows.select(*(have.get(c, F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in kind.split(", "))))


def changes(spark, *rows):
    return judging.changes(spark.createDataFrame(rows, "id string, seq long, at_utc timestamp, action string, registration string, pilot string, note string, outcome string, frame int, offset_m double"))


def change(id, seq, action, **more):
    return (id, seq, NOW, action, *(more.get(c) for c in ("registration", "pilot", "note", "outcome", "frame", "offset_m")))


def test_versions_and_changes_before_and_after_compaction(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no version"):
        store.read(spark, path)
    assert store.write(landings(spark), path) == 1
    store.append(changes(spark, change("L0", 1, "confirm", pilot="Anna"), change("L1", 2, "reject", note="no")), path)
    store.append(changes(spark, change("L2", 3, "edit", frame=7, offset_m=1.5)), path)
    show = lambda df: sorted((r["id"], r["status"], r["pilot"], r["outcome"], r["confirmed_frame"], r["history"]) for r in df.collect())
    want = [("L0", "confirmed", "Anna", "unseen", None, ["confirm"]), ("L1", "rejected", None, "unseen", None, ["reject"]), ("L2", "pending", None, "measured", 7, ["edit"]), ("L3", "pending", None, "unseen", None, [])]
    assert show(store.current(spark, path)) == want
    assert store.compact(spark, path) == 2
    assert show(store.read(spark, path)) == want == show(store.current(spark, path))
    assert {r["status"] for r in store.read(spark, path, 1).collect()} == {"pending"}
    store.append(changes(spark, change("L0", 4, "reopen"), change("L2", 5, "reset")), path)
    now = show(store.current(spark, path))
    assert now[0] == ("L0", "pending", "Anna", "unseen", None, ["confirm", "reopen"]) and now[2][4:] == (None, ["edit", "reset"])
    assert store.compact(spark, path) == 3 and show(store.current(spark, path)) == now
    assert store.landing(spark, path, "L0")["pilot"] == "Anna"
    with pytest.raises(KeyError):
        store.landing(spark, path, "L9")


def test_a_reader_sees_the_old_version_or_the_new_one(spark, tmp_path):
    """Versions of one value each are written while others are read: every read has one value, and all of its rows."""
    path = str(tmp_path / "store")
    version = lambda k: spark.range(500).select(F.col("id").cast("string"), F.lit(k).alias("k")).repartition(5)
    store.write(version(0), path)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(sorted((r["k"], r["n"]) for r in store.read(spark, path).groupBy("k").agg(F.count("*").alias("n")).collect()))

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 5):
        store.write(version(k), path)
    stop.set()
    reader.join()
    assert seen and all(len(x) == 1 and x[0][1] == 500 for x in seen)
    assert [x[0][0] for x in seen] == sorted(x[0][0] for x in seen)


def test_what_a_killed_writer_left_is_not_read(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write(landings(spark, 2), path)
    landings(spark, 9).write.parquet(f"{path}/landings/left")  # never named
    changes(spark, change("L0", 1, "reject")).write.parquet(f"{path}/log/left")
    assert store.current(spark, path).count() == 2 and {r["status"] for r in store.current(spark, path).collect()} == {"pending"}
    assert store.write(landings(spark, 3), path) == 2 and store.read(spark, path).count() == 3


def test_changes_that_come_during_compaction_are_not_lost(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.write(landings(spark), path)
    store.append(changes(spark, change("L0", 1, "confirm")), path)
    write = store.write

    def late(*args):
        store.append(changes(spark, change("L1", 2, "reject")), path)
        return write(*args)

    monkeypatch.setattr(store, "write", late)
    store.compact(spark, path)
    monkeypatch.undo()
    assert {r["id"]: r["status"] for r in store.read(spark, path).collect()}["L1"] == "pending"
    assert {r["id"]: r["status"] for r in store.current(spark, path).collect()} == {"L0": "confirmed", "L1": "rejected", "L2": "pending", "L3": "pending"}


def test_keys_are_never_forgotten_and_a_repeated_batch_adds_nothing(spark, tmp_path):
    kept, kind = str(tmp_path / "kept"), "flarm_id string, utc timestamp, lat double"
    day = lambda d, i=0: dt.datetime(2026, 9, 1) + dt.timedelta(days=d, seconds=i)
    one = spark.createDataFrame([("A", day(0), 1.0), ("A", day(0), 1.0), ("B", day(0, 1), 2.0), (None, day(1), 3.0), ("A", None, 4.0)], kind)
    two = spark.createDataFrame([("A", day(0), 9.0), ("B", day(0, 2), 5.0), (None, day(1), 3.0), ("A", None, 4.0), ("C", day(400), 6.0)], kind)
    show = lambda: sorted(((r["flarm_id"], r["utc"], r["lat"], r["batch"]) for r in keys.kept(spark, kept, kind).collect()), key=repr)
    assert show() == []
    keys.keep_new(one, 0, kept, ["flarm_id", "utc"], "utc")
    keys.keep_new(two, 1, kept, ["flarm_id", "utc"], "utc")
    want = sorted([("A", day(0), 1.0, 0), ("B", day(0, 1), 2.0, 0), (None, day(1), 3.0, 0), ("A", None, 4.0, 0), ("B", day(0, 2), 5.0, 1), ("C", day(400), 6.0, 1)], key=repr)
    assert show() == want
    keys.keep_new(two, 1, kept, ["flarm_id", "utc"], "utc")  # repeated after a failure
    assert show() == want


def test_stream_without_repeats_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rng = random.Random(2)
    rows = [(rng.choice("ABC"), (NOW + dt.timedelta(days=rng.randrange(900), seconds=rng.randrange(3))).isoformat()) for _ in range(300)]
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"flarm_id": f, "utc": u}) for f, u in rows[k * 100 : k * 100 + 150]))
        stream = spark.readStream.schema("flarm_id string, utc timestamp").json(str(tmp_path / "in"))
        keys.without_repeats_ever(stream, ["flarm_id", "utc"], "utc", str(tmp_path / "kept"), str(tmp_path / "state")).awaitTermination()
    found = keys.kept(spark, str(tmp_path / "kept"), "flarm_id string, utc timestamp").collect()
    assert sorted((r["flarm_id"], r["utc"].isoformat()) for r in found) == sorted(set(rows))

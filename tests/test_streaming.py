import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from groundmark.operators import tracks
from groundmark.streaming import tracking

START = dt.datetime(2026, 9, 13, 12)


def flights(seed=3, frames=500):
    """Blobs (session, frame, at, ordinal, cx, cy, area) of two sessions: crossing tracks, missed frames, empty frames, pauses."""
    rng = random.Random(seed)
    rows, ordinal = [], 0
    for session in ("a", "b"):
        at = START
        paths = [(rng.uniform(0, 400), rng.uniform(-6, 9), rng.uniform(0, 300), rng.uniform(-3, 3), rng.randrange(frames)) for _ in range(8)]
        for frame in range(frames):
            at += dt.timedelta(seconds=1 / 60 if frame not in (180, 330) else 2.0)
            blobs = [(x + vx * (frame - f) + rng.gauss(0, 2), y + vy * (frame - f)) for x, vx, y, vy, f in paths if 0 <= frame - f < 150 and rng.random() > 0.15 and not 40 <= frame - f < 48]
            for x, y in blobs or [(None, None)]:
                ordinal += 1
                rows.append((session, frame, at, ordinal, x, y, 100.0 if x is not None else None))
    return rows


def batch_tracks(spark, rows):
    df = spark.createDataFrame([(s, f, (at - dt.datetime(1970, 1, 1)) / dt.timedelta(seconds=1), x, y, a, o) for s, f, at, o, x, y, a in rows], "session string, frame long, t double, cx double, cy double, area double, ordinal long")
    return sorted((r["session"], r["ordinal"], r["track"]) for r in tracks.assign_tracks(df).collect())


def dump(path, rows):
    path.write_text("\n".join(json.dumps(dict(zip(("session", "frame", "at", "ordinal", "cx", "cy", "area"), (s, f, at.isoformat() + "Z", o, x, y, a)))) for s, f, at, o, x, y, a in rows))


def parts(rows, n):
    """Rows cut at instants into n files, each in no order."""
    times = sorted({r[2] for r in rows})
    cuts = [times[len(times) * k // n] for k in range(n)] + [times[-1] + dt.timedelta(1)]
    out = [[r for r in rows if a <= r[2] < b] for a, b in zip(cuts, cuts[1:])]
    for k, part in enumerate(out):
        random.Random(k).shuffle(part)
    return out


def seen(events):
    return sorted((r["session"], r["ordinal"], r["track"]) for r in events.filter("event = 'seen'").collect())


def run(spark, folder, each=None):
    query = tracking.follow(tracking.tracked(tracking.detections(spark, str(folder / "in"))), str(folder / "out"), str(folder / "state"), each)
    query.awaitTermination()
    return tracking.followed(spark, str(folder / "out"))


def test_stream_over_files_gives_the_tracks_of_the_batch(spark, tmp_path):
    rows = flights()
    (tmp_path / "in").mkdir()
    for k, part in enumerate(parts(rows, 2)):
        dump(tmp_path / "in" / f"{k}.json", part)
    events = run(spark, tmp_path)
    want = batch_tracks(spark, rows)
    assert seen(events) == want
    ended = {(r["session"], r["track"]) for r in events.filter("event = 'ended'").collect()}
    last = max(r[2] for r in rows)
    assert ended <= {(s, t) for s, _, t in want}
    assert {(s, t) for s, _, t in want if t.split("-")[0] != "2"} <= ended  # all tracks before the last pause
    assert last < START + dt.timedelta(1)


def test_restart_from_the_checkpoint_with_a_file_that_fails(spark, tmp_path):
    rows = flights(seed=4)
    first, second, third = parts(rows, 3)
    (tmp_path / "in").mkdir()
    dump(tmp_path / "in" / "0.json", first)
    run(spark, tmp_path)
    (tmp_path / "in" / "1.json").write_text('{"session": "a", "frame": 3\nnot json')
    run(spark, tmp_path)
    dump(tmp_path / "in" / "2.json", second)
    dump(tmp_path / "in" / "3.json", third)
    events = run(spark, tmp_path)
    assert seen(events) == batch_tracks(spark, rows)
    failed = events.filter("event = 'failed'").collect()
    assert [(r["session"], r["note"]) for r in failed] == [("1.json", "1.json cannot be read")]
    assert seen(run(spark, tmp_path)) == seen(events)  # nothing new: nothing changes


def test_killed_between_write_and_commit_nothing_is_lost_or_doubled(spark, tmp_path):
    rows = flights(seed=5)
    (tmp_path / "in").mkdir()
    for k, part in enumerate(parts(rows, 3)):
        dump(tmp_path / "in" / f"{k}.json", part)
    calls = []

    def dies(batch, number):
        calls.append(number)
        if number == 1 and calls.count(1) == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, dies)
    events = run(spark, tmp_path, dies)
    assert calls.count(1) == 2
    assert seen(events) == batch_tracks(spark, rows)


def test_a_session_that_stops_is_flushed_when_others_go_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = lambda s: START + dt.timedelta(seconds=s)
    dump(tmp_path / "in" / "0.json", [("a", 0, at(0), 1, 5.0, 5.0, 9.0), ("b", 0, at(0.1), 2, 5.0, 5.0, 9.0)])
    run(spark, tmp_path)
    dump(tmp_path / "in" / "1.json", [("b", 600, at(10), 3, 5.0, 5.0, 9.0)])
    events = run(spark, tmp_path)
    assert {("a", "0-1"), ("b", "0-1")} == {(r["session"], r["track"]) for r in events.filter("event = 'ended'").collect()}
    assert seen(events) == [("a", 1, "0-1"), ("b", 2, "0-1"), ("b", 3, "1-1")]


def board_rows(spark, folder, name, batches, refresh_s=60.0, wait_s=40.0, with_key=None):
    """What a board shows in its next batches that have rows, in order. With timers of processing time a query goes on until it is stopped."""
    import time

    from groundmark.streaming import board

    shown = []
    stream = spark.readStream.schema("board string, session string, landing string, key string, score double, bad boolean").json(str(folder / "in"))
    query = tracking.follow(board.board(stream, refresh_s), str(folder / name), str(folder / "state"), lambda b, n: shown.append(sorted(map(tuple, b.collect()))), mode="update", processingTime="300 milliseconds")
    until = time.time() + wait_s
    enough = lambda: len([x for x in shown if x]) >= batches and (with_key is None or any(r[2] == with_key for x in shown for r in x))
    while not enough() and time.time() < until and query.isActive:
        time.sleep(0.1)
    query.stop()
    return [rows for rows in shown if rows]


def test_board_follows_the_newest_session_and_keeps_the_last_good_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("board", "session", "landing", "key", "score", "bad"), r))) for r in rows))

    put("0.json", ("b", "2026-09-12", "L1", "anna", 90.0, False), ("b", "2026-09-12", "L2", "beat", 80.0, False), ("other", "2026-09-01", "L1", "carl", None, False))
    first = board_rows(spark, tmp_path, "o0", 1)
    assert first == [[("b", "2026-09-12", "anna", 90.0, 1, False), ("b", "2026-09-12", "beat", 80.0, 1, False), ("other", "2026-09-01", "carl", 0.0, 1, False)]]
    put("1.json", ("b", "2026-09-12", "L3", "anna", 5.0, False), ("b", "2026-09-12", "L2", "beat", 70.0, False), ("b", "2026-09-11", "L9", "anna", 99.0, False))
    assert board_rows(spark, tmp_path, "o1", 1) == [[("b", "2026-09-12", "anna", 95.0, 2, False), ("b", "2026-09-12", "beat", 70.0, 1, False)]]
    put("2.json", ("b", "2026-09-13", "L1", "dora", 60.0, False), ("b", "2026-09-13", "L2", "anna", 1.0, True))
    assert board_rows(spark, tmp_path, "o2", 1) == [[("b", "2026-09-13", "dora", 60.0, 1, False)]]


def test_board_is_stale_after_three_refreshes_without_news(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(json.dumps({"board": "b", "session": "s", "landing": "L1", "key": "anna", "score": 9.0}))
    shown = board_rows(spark, tmp_path, "out", 2, refresh_s=0.4)
    assert shown == [[("b", "s", "anna", 9.0, 1, False)], [("b", "s", "anna", 9.0, 1, True)]]
    (tmp_path / "in" / "1.json").write_text(json.dumps({"board": "b", "session": "s", "landing": "L2", "key": "beat", "score": 1.0}))
    again = board_rows(spark, tmp_path, "out2", 1, with_key="beat")
    assert [("b", "s", "anna", 9.0, 1, False), ("b", "s", "beat", 1.0, 1, False)] in again

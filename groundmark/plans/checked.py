"""Queries of the parts that stand behind others: sheets, checks, geometry, positions, records that do not decode, stores, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import calibration, checks, matching, results, timeline, tracks, viewing
from ..schemas import Rules
from ..sources import decode, files, store
from ..sources.shared import shared_folder
from . import judging
from .catalogue import BOOK_MATCH, DAY, FIELD, SPANS, WIDE, _fixes, _naive, _orders, _samples, _segments, _sorties, _table, _touchdowns, query


@query("""with x as (select 'p:' || lower(trim(c_name)) as k, c_name as name, o_orderkey as id, o_orderdate as seen, c_mktsegment as registration, o_totalprice, case o_orderkey % 3 when 0 then 'measured' when 1 then 'short' else 'unseen' end as outcome, (o_orderkey % 1000 - 500) / 50.0 as m from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F'),
 s as (select *, case outcome when 'short' then 0.0 when 'measured' then round_even(greatest(0.0, 100 - (case when m < 0 then 5 else 2 end) * abs(m)), 0) end as score from x),
 r as (select k, row_number() over (order by sum(coalesce(score, 0)) desc, count(*) desc, lower(arg_max(name, (seen, id))), k) as position from s group by 1)
 select position, id, row_number() over (partition by k order by seen, id) as ordinal, case when outcome = 'measured' then round(m, 2) end as offset_m, score from s join r using (k)""")
def results_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).drop("score")
    k = F.col("id") % 3
    m = (F.col("id") % 1000 - 500) / 50.0
    rows = o.withColumns({"outcome": F.when(k == 0, "measured").when(k == 1, "short").otherwise("unseen"), "longitudinal_m": m, "confirmed_longitudinal_m": F.lit(None).cast("double"), "bound_m": F.lit(None).cast("double")})
    return results.sheet(rows).select(F.col("position").cast("long").alias("position"), "id", F.col("ordinal").cast("long").alias("ordinal"), "offset_m", "score")


@query("""select o_orderkey as id, case o_orderkey % 3 when 0 then greatest(10.0, 1000 - (case when x < 0 then 50 else 20 end) * abs(x)) when 1 then 7.0 end as live from (select o_orderkey, (o_orderkey % 400 - 200) / 8.0 as x from orders)""")
def live_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    outcome = F.when(k % 3 == 0, "measured").when(k % 3 == 1, "long").otherwise("unseen")
    rows = _table(spark, sf_dir, "orders").select(k.alias("id"), outcome.alias("outcome"), ((k % 400 - 200) / 8.0).alias("scored_longitudinal_m"), F.lit("pending").alias("status"))
    return results.live_order(rows, Rules(max_points=1000, short_per_m=50, long_per_m=20, min_points=10, out_of_range_points=7)).select("id", F.col("live_score").alias("live"))


@query("""with g as (select c_custkey as id, 50.0 + c_custkey % 50 as d, 4.0 + c_custkey % 8 as mast, 25.0 + c_custkey % 36 as fps, 20.0 + c_custkey % 30 as fov from customer),
 w as (select *, 2 * d * tan(radians(fov) / 2) as w, degrees(atan(mast / d)) as e from g), p as (select *, radians(17.0) / 1080 * d / sin(radians(e)) as z from w)
 select id, round(w, 6) as covered_m, round(1920 / w, 6) as px_per_m, round(e, 6) as elevation_deg, round(z, 6) as depth_m_per_px, round(z * (w / 2) / d, 6) as edge_error_m, round(25.0 / fps, 6) as travel_m_per_frame from p""")
def site_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(k.alias("id"), (F.lit(50.0) + k % 50).alias("d"), (F.lit(4.0) + k % 8).alias("mast"), (F.lit(25.0) + k % 36).alias("fps"), (F.lit(20.0) + k % 30).alias("fov"))
    found = values.site_geometry(F.col("d"), F.col("mast"), F.col("fps"), F.col("fov"))
    return rows.select("id", *(F.round(c, 6).alias(n) for n, c in found.items()))


@query("""with s as (select l_orderkey * 8 + l_linenumber as source, case when l_orderkey % 5 > 0 then 1920 when l_orderkey % 10 > 0 then 1280 end as w, case when l_partkey % 4 > 0 then 'H264' when l_partkey % 8 > 0 then 'mjpeg' end as codec, case when l_suppkey % 3 > 0 then 'yuv420p' end as pix,
 case when l_linenumber % 4 > 0 then 59.4 + l_linenumber / 10.0 end as fps, case when l_orderkey % 7 > 0 then l_orderkey % 30 * 1000000 end as bits from lineitem),
 c as (select source, case when w = 1920 then 'pass' else 'warn' end as a, case when codec = 'H264' then 'pass' else 'warn' end as b, case when pix is not null then 'pass' else 'warn' end as c, case when fps is null then 'warn' when abs(fps - 60) < 0.5 then 'pass' else 'fail' end as d, case when bits between 8000000 and 24000000 then 'pass' else 'warn' end as e from s),
 n as (select source, (d = 'fail')::int as failed, (a = 'warn')::int + (b = 'warn')::int + (c = 'warn')::int + (d = 'warn')::int + (e = 'warn')::int as warnings from c)
 select source, (5 * count(*))::int as checks, sum(failed)::int as failed, sum(warnings)::int as warnings, case when sum(failed) > 0 then 'fail' when sum(warnings) > 0 then 'warn' else 'pass' end as verdict from n group by 1""")
def stream_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's stream: five checks, how many failed or warned, and the worst."""
    li = _table(spark, sf_dir, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = li.select(
        (k * 8 + n).alias("source"), F.when(k % 5 > 0, 1920).when(k % 10 > 0, 1280).alias("width"), F.lit(1080).alias("height"), F.when(F.col("l_partkey") % 4 > 0, "H264").when(F.col("l_partkey") % 8 > 0, "mjpeg").alias("codec"),
        F.when(F.col("l_suppkey") % 3 > 0, "yuv420p").alias("pix_fmt"), F.when(n % 4 > 0, F.lit(59.4) + n / 10.0).alias("fps"), F.when(k % 7 > 0, k % 30 * 1_000_000).alias("bit_rate"),
    )
    out = checks.verdicts(checks.stream_checks(rows))
    return out.select("source", *(F.col(c).cast("int").alias(c) for c in ("checks", "failed", "warnings")), "verdict")


@query("""with s as (select user_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 as t, value as x from events), k as (select user_id, avg(t) as tc from s group by 1), d as (select s.user_id, t - tc as d, x, t >= tc as leg from s join k using (user_id)),
 n as (select user_id, count(*) filter (where leg) as legs from d group by 1), u as (select d.* from d join n using (user_id) where leg or legs < 3)
 select user_id, count(*) as n_x, round(regr_intercept(x, d), 5) as x, round(regr_slope(x, d), 6) as v, round(sqrt(greatest(0, regr_syy(x, d) - regr_slope(x, d) * regr_sxy(x, d)) / count(*)), 5) as rms_x from u group by 1 having count(*) > 2""")
def positions_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and speed at each track's mean instant, from the line through the samples after it."""
    from ..operators import fits

    s = _samples(spark, sf_dir)
    instants = s.groupBy("user_id").agg(F.avg("t").alias("tc"))
    out = fits.positions(s, instants, "user_id", x="y").filter("n_x > 2")
    return out.select("user_id", "n_x", F.round("x", 5).alias("x"), F.round("v", 6).alias("v"), F.round("rms_x", 5).alias("rms_x"))


@query("""with m as (select o_custkey as id, o_orderkey % 40 as u, o_orderkey % 7 as w, o_orderkey % 31 as x, o_orderkey % 5 as y from orders),
 m2 as (select id, case id % 4 when 0 then x else u * 10 end as a, case id % 4 when 0 then x * 2 else w * 25 end as b, x as p, case id % 4 when 1 then x * 3 else y * 10 end as q from m),
 g as (select id, count(*) as n, count(distinct (p, q)) as places, count(distinct (a, b)) as clicks, var_pop(p) as vp, var_pop(q) as vq, covar_pop(p, q) as cpq, var_pop(a) as va, var_pop(b) as vb, covar_pop(a, b) as cab from m2 group by 1),
 s as (select *, sqrt(greatest(0, (vp + vq) / 2 - sqrt(((vp - vq) / 2) ** 2 + cpq * cpq))) as world, sqrt(greatest(0, (va + vb) / 2 - sqrt(((va - vb) / 2) ** 2 + cab * cab))) as image from g)
 select id, n as markers, case when n < 4 then 'few' when places < n then 'same_ground' when clicks < n then 'same_click' when world < 1 then 'ground_line' when image < 5 then 'click_line' else '' end as problem from s""")
def marker_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as markers: sets with repeated places or clicks, and sets on a line."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, kind = (k % 31).cast("double"), c % 4
    m = _table(spark, sf_dir, "orders").select(
        c.alias("id"), F.when(kind == 0, x).otherwise(k % 40 * 10.0).alias("image_x"), F.when(kind == 0, x * 2).otherwise(k % 7 * 25.0).alias("image_y"), x.alias("world_x"), F.when(kind == 1, x * 3).otherwise(k % 5 * 10.0).alias("world_y"),
    )
    return calibration.geometry(m, ["id"]).select("id", "markers", "problem")


@query("""with t as (select o_orderkey as id, o_orderkey % 9 as m, case when o_orderkey % 2 = 0 then 'R1' else '' end as own, case o_orderkey % 5 when 0 then 'confirmed' when 1 then 'rejected' else 'pending' end as status, case when o_orderkey % 7 = 0 then 'judge' else '' end as by_, case when o_orderkey % 3 = 0 then 'departure' else 'landing' end as kind,
 case when o_orderkey % 4 = 0 then 'measured' else 'unseen' end as outcome, case when o_orderkey % 9 > 2 then 'M' || o_custkey else '' end as mr, case when o_orderkey % 9 between 1 and 5 then 'takeoff' else 'landing' end as ev from orders),
 f as (select *, status <> 'confirmed' and by_ <> 'judge' and m > 0 as free from t), g as (select *, free and own = '' and mr <> '' as takes, free and ev = 'takeoff' and kind <> 'departure' as off from f)
 select id, case when takes then mr else own end as registration, case when takes then 'ogn' else by_ end as identified_by, case when off and status = 'pending' and outcome <> 'measured' then 'departure' else outcome end as outcome,
 case when off and status = 'pending' and outcome <> 'measured' then 'departure' else kind end as kind, (off or (free and ev = 'landing' and kind = 'departure'))::int as notes from g""")
def applied_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = F.struct(F.when(k % 9 > 2, F.concat(F.lit("M"), F.col("o_custkey").cast("string"))).otherwise("").alias("registration"), F.lit("").alias("competition_number"), F.lit("").alias("aircraft_type"), F.lit("D").alias("flarm_id"), F.when((k % 9).between(1, 5), "takeoff").otherwise("landing").alias("event"))
    rows = _table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 9 > 0, pick).alias("match"), F.when(k % 2 == 0, "R1").otherwise("").alias("registration"), F.lit("").alias("competition_number"), F.lit("").alias("aircraft_type"),
        F.when(k % 5 == 0, "confirmed").when(k % 5 == 1, "rejected").otherwise("pending").alias("status"), F.when(k % 7 == 0, "judge").otherwise("").alias("identified_by"),
        F.when(k % 3 == 0, "departure").otherwise("landing").alias("kind"), F.when(k % 4 == 0, "measured").otherwise("unseen").alias("outcome"), F.array().cast("array<string>").alias("flags"),
    )
    return matching.applied(rows).select("id", "registration", "identified_by", "outcome", "kind", F.size("flags").alias("notes"))


@query("""select case event_id % 6 when 0 then '' when 1 then 'misses kind' when 2 then 'does not fit frame' when 3 then 'has points off in odd' when 4 then 'no object' else '' end as reason, event_type, count(*) as n, count(*) filter (where event_id % 6 = 5) as started from events group by 1, 2""")
def decoded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a landing's record: whole, without a key, with a word for a number, with an odd point, cut off, or with keys to spare."""
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id") % 6
    base = F.concat(F.lit('{"id": "L'), F.col("event_id").cast("string"), F.lit('", "session": "s", "created_utc": "2026-09-13T12:00:00Z", "outcome": "measured"'))
    tail = F.when(k == 0, ', "kind": "landing"}').when(k == 1, "}").when(k == 2, ', "kind": "landing", "frame": "many"}').when(k == 3, ', "kind": "landing", "track": [{"segment": "a", "frame": 1, "t": 0.1, "u": 1, "v": 2, "world_x": 3, "world_y": 4, "clipped": false, "odd": 1}]}').when(k == 4, "").otherwise(', "kind": "landing", "label": "x", "status": "confirmed", "newer": {"a": 1}}')
    judged = decode.judged_landings(e.select("event_type", F.concat(base, tail).alias("text")))
    started = F.col("reason").isNull() & (F.col("value.status") == "confirmed")
    lanes = judged.select("event_type", F.coalesce("reason", F.lit("")).alias("reason"), started.alias("started"))
    return lanes.groupBy("reason", "event_type").agg(F.count("*").alias("n"), F.count_if("started").alias("started"))


@query("""with c as (select 'U' || user_id as id, event_id as seq, case event_type when 'purchase' then 'confirm' when 'click' then 'reject' when 'view' then 'edit' else 'reopen' end as action, case when event_type in ('purchase', 'view') then 'N' || event_id end as note from events)
 select id, coalesce(arg_max(case action when 'confirm' then 'confirmed' when 'reject' then 'rejected' else 'pending' end, seq) filter (where action <> 'edit'), 'pending') as status, arg_max(note, seq) filter (where note is not null) as note, count(*) as changes from c group by 1""")
def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of one landing a user: half of the changes are appended and folded into a version, the others wait in the log."""
    e = _table(spark, sf_dir, "events")
    path = shared_folder(spark, "store")
    id_ = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    none = {c: F.lit(None).cast(t) for c, t in judging.FIELDS.items()}
    store.write(e.select(id_.alias("id")).distinct().select("id", *(c.alias(n) for n, c in (none | {"status": F.lit("pending")}).items())), path)
    action = F.create_map(*(F.lit(x) for p in (("purchase", "confirm"), ("click", "reject"), ("view", "edit")) for x in p))[F.col("event_type")]
    note = F.when(F.col("event_type").isin("purchase", "view"), F.concat(F.lit("N"), F.col("event_id").cast("string")))
    log = judging.changes(e.select(id_.alias("id"), F.col("event_id").alias("seq"), F.col("ts").alias("at_utc"), F.coalesce(action, F.lit("reopen")).alias("action"), note.alias("note")))
    half = e.agg(F.avg("event_id")).first()[0] or 0
    store.append(log.filter(F.col("seq") <= half), path)
    store.compact(spark, path)
    store.append(log.filter(F.col("seq") > half), path)
    return store.current(spark, path).select("id", "status", "note", F.size("history").cast("long").alias("changes"))


@query("""with t as (select event_id as id, value - 50 as x, 12.0 + value / 10 as lat, case event_id % 4 when 0 then 'measured' when 1 then 'unseen' when 2 then 'short' else 'departure' end as outcome, case when event_id % 3 = 0 then 'shadow' else 'depth' end as method from events)
 select id, case when lat > 15 and outcome in ('short', 'unseen') and method = 'depth' then 'airborne' else outcome end as outcome, case when lat > 15 and outcome in ('short', 'unseen') and method = 'depth' then 'pass' when outcome = 'departure' then 'departure' else 'landing' end as kind,
 (lat > 15)::int + (outcome = 'measured' and abs(x) > 19.4)::int + 1 as flags from t""")
def plausible_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id")
    rows = e.select(k.alias("id"), (F.col("value") - 50).alias("longitudinal_m"), (F.lit(12.0) + F.col("value") / 10).alias("lateral_m"), F.when(k % 4 == 0, "measured").when(k % 4 == 1, "unseen").when(k % 4 == 2, "short").otherwise("departure").alias("outcome"), F.when(k % 3 == 0, "shadow").otherwise("depth").alias("method"), F.lit(None).cast("array<string>").alias("flags"))
    return tracks.plausible(rows, residual_m=0.2).select("id", "outcome", "kind", F.size("flags").alias("flags"))


@query("""select event_id as id, make_timestamp(epoch_us(ts) + cast(round(event_id % 600 / (25.0 + event_id % 3 * 17.5) * 1e6) as bigint)) as at_utc, event_id % 3 = 1 as odd_rate from events""")
def frame_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of a frame of a segment, and segments whose rate is off the target by over 1."""
    k = F.col("event_id")
    e = _table(spark, sf_dir, "events").withColumn("fps", F.lit(25.0) + k % 3 * 17.5)
    odd = timeline.fps_outliers(e.filter(k % 3 != 2).withColumn("name", k), 25.0).select("event_id", F.lit(True).alias("odd_rate"))
    out = e.join(odd, "event_id", "left").select(k.alias("id"), values.frame_instant("ts", k % 600, "fps").alias("at_utc"), F.coalesce("odd_rate", F.lit(False)).alias("odd_rate"))
    return _naive(out, "at_utc")


@query("""with t as (select l_orderkey as id, l_linenumber as i, l_extendedprice as area from lineitem), r as (select *, row_number() over (partition by id order by area desc, i) as r from t) select id, count(*) as n, max(area) as top, min(area) as sixth from r where r <= 6 group by 1""")
def largest_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    blobs = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("area"), F.col("l_linenumber").alias("i"))).alias("tyres"))
    out = tracks.largest(blobs, "tyres").withColumn("a", F.transform("tyres", lambda x: x["area"]))
    return out.select("id", F.size("a").cast("long").alias("n"), F.get("a", 0).alias("top"), F.get("a", F.size("a") - 1).alias("sixth"))


@query()
def tracker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks of `tracker`, from a stream with state by session."""
    from ..streaming import tracking

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    read = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).cast("long")
    blobs = read.select(F.col("user_id").cast("string").alias("session"), hour.alias("frame"), F.timestamp_micros((hour * 1_000_000 / 60).cast("long")).alias("at"), F.col("event_id").alias("ordinal"), F.col("value").alias("cx"), (F.col("value") * 2).alias("cy"), F.col("value").alias("area"))
    out, state = shared_folder(spark, "tracker"), shared_folder(spark, "tracker-state")
    tracking.follow(tracking.tracked(blobs), out, state).awaitTermination()
    return tracking.followed(spark, out).filter("event = 'seen'").select(F.col("session").cast("long").alias("session"), "frame", "ordinal", "track")


@query(f"""with {SPANS}, d as (select *, (epoch_us(next_start) - epoch_us(end_utc)) / 1e6 as delta from spans), g as (select user_id, name as after, end_utc, abs(delta) as seconds from d where delta > 1.5),
 r as (select *, row_number() over (partition by user_id order by end_utc, after) as place, count(*) over (partition by user_id) as n from g) select user_id, after, place, round(seconds, 6) as seconds, greatest(n - 10, 0) as more from r where place <= 10""")
def report_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.gaps(_segments(spark, sf_dir), ["user_id"], bucket_s=30 * DAY).filter("kind = 'gap'")
    return timeline.report_head(found, ["user_id"]).select("user_id", "after", F.col("place").cast("long").alias("place"), F.round("seconds", 6).alias("seconds"), "more")


@query("""with p as (select user_id as session, event_type, cast(arg_max(event_id, (ts, event_id)) as double) as v from events where user_id % 3 > 0 group by 1, 2), l as (select session, max(v) filter (where event_type = 'view') as f, max(v) filter (where event_type = 'click') as d from p group by 1),
 g as (select user_id as session, count(*) as gaps, sum(value) as s from events where event_type = 'error' group by 1), w as (select user_id as session, count(*) as files, sum(event_id * 1000) as bytes from events where user_id % 2 = 0 group by 1)
 select s.session, coalesce(f, 0) as frames, coalesce(d, 0) as dropped, coalesce(gaps, 0) as gaps, round(coalesce(g.s, 0), 4) as gap_seconds, coalesce(files, 0) as segments, round(coalesce(bytes, 0) / 1e9, 9) as written_gb from (select distinct user_id as session from events) s left join l using (session) left join g using (session) left join w using (session)""")
def recorder_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a recording's progress lines, gaps and files; some have none."""
    e = _table(spark, sf_dir, "events").withColumn("session", F.col("user_id"))
    key = F.when(F.col("event_type") == "view", "frame").when(F.col("event_type") == "click", "drop_frames").otherwise("other")
    lines = e.filter("user_id % 3 > 0").select("session", F.struct("ts", "event_id").alias("ordinal"), F.concat(key, F.lit("="), F.col("event_id").cast("string")).alias("value"))
    written = e.filter("user_id % 2 = 0").groupBy("session").agg(F.count("*").alias("files"), F.sum(F.col("event_id") * 1000).alias("bytes"))
    out = viewing.recorder_status(e, files.progress(lines, ["session"]), e.filter("event_type = 'error'").select("session", F.col("value").alias("seconds")), written)
    return out.select("session", F.col("frame").alias("frames"), F.col("drop_frames").alias("dropped"), "gaps", F.round("gap_seconds", 4).alias("gap_seconds"), "segments", F.round("written_gb", 9).alias("written_gb"))


@query(f"""with {BOOK_MATCH}, t as (select event_id as id, case when event_id % 4 = 0 then 'confirmed' else 'pending' end as status, case when event_id % 3 = 0 then 'R0' else '' end as own from events where event_type = 'error')
 select t.id, case when status <> 'confirmed' and own = '' and book.id is not null then book.registration else own end as registration, 'saved' as used from t left join book on book.id = t.id""")
def logbook_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is fetched, so the saved logbook identifies the landings that are free."""
    k = F.col("id")
    rows = _touchdowns(spark, sf_dir).select(
        "id", "touchdown_utc", F.when(k % 4 == 0, "confirmed").otherwise("pending").alias("status"), F.when(k % 3 == 0, "R0").otherwise("").alias("registration"), F.lit("").alias("competition_number"), F.lit("").alias("aircraft_type"),
        F.lit("").alias("identified_by"), F.lit("landing").alias("kind"), F.lit("unseen").alias("outcome"), F.array().cast("array<string>").alias("flags"),
    )
    saved = _sorties(spark, sf_dir)
    out = matching.logbook_pass(rows, _fixes(spark, sf_dir).filter("false"), saved.filter("false"), saved, FIELD, WIDE)
    return out.select("id", "registration", "used")

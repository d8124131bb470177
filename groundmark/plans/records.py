"""More queries: the readers of feeds and documents, lists and geometry of landings, over whole tables.

Feeds and documents are written out as texts from the tables' rows, then read by the operators; the SQL reads the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import matching, results, tracks, viewing
from ..sources import files
from .catalogue import MATRIX, _landings, _naive, _orders, _table, query


def _text(template: str, *columns: Column) -> Column:
    """The template with each `%s` replaced by a column."""
    return F.format_string(template, *columns)


def _string(c: str) -> Column:
    return F.col(c).cast("string")


@query("""select event_id as page_id, make_timestamp(cast(floor(epoch_us(ts) / 1e6 - event_id % 60) as bigint) * 1000000) as utc, 'F' || user_id as flarm_id, 'R' || user_id as registration, event_type as competition_number,
 event_id % 90 + 0.5 as lat, event_id % 180 + 0.25 as lon, cast(event_id % 1000 as double) as alt_m, case when event_id % 7 = 0 then 0.0 else cast(user_id % 360 as double) end as track_deg, cast(event_id % 5 as integer) as aircraft_type from events""")
def text_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a page with a whole marker, one with too few fields and one with a bad number."""
    e = _table(spark, sf_dir, "events")
    n = F.col("event_id")
    course = F.when(n % 7 == 0, F.lit(" ")).otherwise((F.col("user_id") % 360).cast("string"))
    marker = _text('<m a="%s.5,%s.25,__%s, R%s,%s,x,%s,%s,20,0.5,%s,rcv,x,F%s "/>', n % 90, n % 180, F.col("event_type"), _string("user_id"), n % 1000, n % 60, course, n % 5, _string("user_id"))
    pages = e.select(F.col("event_id").alias("page_id"), F.concat(F.lit('<m a="1,2,3"/>'), marker, F.lit('<m a="north,2,c,r,1,x,0,0,0,0,1,r,x,id"/>')).alias("text"), F.col("ts").alias("now_utc"))
    out = files.live_fixes(pages).select("page_id", "utc", "flarm_id", "registration", "competition_number", "lat", "lon", "alt_m", "track_deg", "aircraft_type")
    return _naive(out, "utc")


@query("""with o as (select o_orderkey, o_custkey, o_orderpriority, cast(o_orderdate as date) as day, o_orderkey % 24 as h, o_orderkey % 60 as m from orders)
 select 'R' || o_custkey as registration, cast(o_orderkey as varchar) as competition_number, o_orderpriority as aircraft_type, case when o_orderkey % 5 <> 0 then day + to_hours(cast(h as integer)) + to_minutes(cast(m as integer)) - interval 2 hour end as takeoff_utc,
 case when o_orderkey % 11 <> 0 then day + interval 1 day + to_hours(cast(h as integer)) - interval 2 hour end as landing_utc, case when o_orderkey % 3 = 0 then '' else 'P' || o_orderkey % 3 end as landing_place from o""")
def json_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a nested logbook document of one sortie; some times are masked or blank."""
    o = _table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    hour = F.lpad((k % 24).cast("string"), 2, "0")
    start = F.when(k % 5 == 0, F.lit("xx:xx")).otherwise(F.concat(hour, F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0")))
    end = F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(hour, F.lit(":00")))
    sortie = F.struct(
        F.concat(F.lit(" R"), _string("o_custkey")).alias("cs"), F.concat(F.lit("--"), k.cast("string"), F.lit("-")).alias("cn"), F.col("o_orderpriority").alias("actype"),
        day.cast("string").alias("date"), F.date_add(day, 1).cast("string").alias("date_ldg"), F.struct(start.alias("time")).alias("tkof"),
        F.struct(end.alias("time"), F.when(k % 3 != 0, F.concat(F.lit("P"), (k % 3).cast("string"))).alias("loc")).alias("ldg"),
    )
    documents = o.select(F.to_json(F.struct(F.array(sortie).alias("sorties"))).alias("text"))
    out = files.logbook(documents, 2.0).select("registration", "competition_number", "aircraft_type", "takeoff_utc", "landing_utc", "landing_place")
    return _naive(out, "takeoff_utc", "landing_utc")


@query("""with e as (select *, case when event_id % 6 = 5 then 2 else event_id % 6 end as d from events) select nullif(event_id, 0) as start_s, case when d < 3 then 'R' || d when d = 4 then '' else 'R' || 2 end as registration,
 case when d < 3 then 'A' || user_id when d = 4 then '' else 'A' || user_id end || (case when event_id % 2 = 0 then ' (tug)' else '' end) as aircraft_type, nullif(user_id, 0) as stop_s, 'PLACE' as landing_place from e""")
def device_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a flight-book document with three devices: the flight's position is in the list, missing, negative or past the end."""
    e = _table(spark, sf_dir, "events")
    n = F.col("event_id") % 6
    devices = F.array(*(F.struct(F.lit(f"R{i} ").alias("registration"), F.concat(F.lit("A"), _string("user_id")).alias("aircraft")) for i in range(3)))
    position = F.when(n < 3, n).when(n == 3, F.lit(None)).when(n == 4, F.lit(9)).otherwise(F.lit(-1))
    flight = F.struct(position.alias("device"), F.col("event_id").alias("start_tsp"), F.col("user_id").alias("stop_tsp"), (F.col("event_id") % 2 == 0).alias("towing"))
    documents = e.select(F.to_json(F.struct(F.lit("PLACE").alias("code"), devices.alias("devices"), F.array(flight).alias("flights"))).alias("text"))
    out = files.flightbook(documents)
    return out.select(F.unix_seconds("takeoff_utc").alias("start_s"), "registration", "aircraft_type", F.unix_seconds("landing_utc").alias("stop_s"), "landing_place")


@query("""select upper('f' || c_custkey) as airfield, c_name as name, c_custkey % 90 + 0.5 as lat, c_custkey % 180 + 0.25 as lon, case when c_custkey % 4 = 0 then 0.0 else cast(c_custkey % 4 as double) end as elevation_m,
 case when c_custkey % 2 = 0 then 2.5 else -1.0 end as timezone_offset_h from customer where c_custkey % 5 <> 0""")
def airfield_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    zone = F.when(k % 2 == 0, F.lit("+0230")).otherwise(F.lit("-0100"))
    code = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("f"), k.cast("string")))
    field = F.struct(code.alias("code"), F.col("c_name").alias("name"), F.array(k % 90 + 0.5, k % 180 + 0.25).alias("latlng"), F.when(k % 4 != 0, k % 4).alias("elevation"), F.struct(zone.alias("tz_offset")).alias("time_info"))
    documents = _table(spark, sf_dir, "customer").select(F.to_json(F.struct(field.alias("airfield"))).alias("text"))
    return files.airfields(documents).select("airfield", "name", "lat", "lon", "elevation_m", "timezone_offset_h")


@query("""select l_orderkey * 8 + l_linenumber as source, cast(l_orderkey % 4000 as integer) as width, case when l_orderkey % 3 = 0 then cast(l_linenumber as double) when l_orderkey % 3 = 1 then 60.0 else 25.0 end as fps,
 coalesce(case when l_partkey % 2 = 0 then nullif(l_partkey, 0) end, nullif(l_suppkey, 0)) as bit_rate, cast(nullif(l_suppkey, 0) as integer) as nb_frames from lineitem""")
def probe_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a probe document: an audio stream before the video stream, rates and lengths that fall back."""
    li = _table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    first = F.when(k % 3 == 0, F.concat(_string("l_linenumber"), F.lit("/1"))).when(k % 3 == 1, F.lit("0/0")).otherwise(F.lit("25"))
    own = F.when(F.col("l_partkey") % 2 == 0, _string("l_partkey")).otherwise(F.lit("0"))
    video = F.struct(F.lit("video").alias("codec_type"), (k % 4000).alias("width"), first.alias("r_frame_rate"), F.lit("120/2").alias("avg_frame_rate"), own.alias("bit_rate"), _string("l_suppkey").alias("nb_frames"))
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit(1).cast("long").alias("width"), F.lit("1/1").alias("r_frame_rate"), F.lit("1/1").alias("avg_frame_rate"), F.lit("5").alias("bit_rate"), F.lit("5").alias("nb_frames"))
    text = F.to_json(F.struct(F.array(audio, video).alias("streams"), F.struct(_string("l_suppkey").alias("bit_rate")).alias("format")))
    return files.probes(li.select((k * 8 + F.col("l_linenumber")).alias("source"), text.alias("text"))).select("source", "width", "fps", "bit_rate", "nb_frames")


@query("""select event_id as source, cast(i as integer) as ordinal, case i when 0 then cast(event_id % 100 as double) when 1 then event_id % 100 + 0.5 end as pts, i = 0 and event_id % 4 = 0 as key_frame from events, (values (0), (1), (2)) n(i)""")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a probe document of three frames: a time, one that falls back, and one that is unreadable."""
    n = F.col("event_id")
    text = _text('{"frames":[{"pts_time":"%s","key_frame":%s},{"best_effort_timestamp_time":"%s.5"},{"pts_time":"N/A","key_frame":0}]}', n % 100, F.when(n % 4 == 0, 1).otherwise(0), n % 100)
    return files.frame_times(_table(spark, sf_dir, "events").select(n.alias("source"), text.alias("text"))).select("source", "ordinal", "pts", "key_frame")


@query("select user_id, event_type as key, cast(arg_max(event_id, (ts, event_id)) as varchar) as value from events group by 1, 2")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    lines = e.select("user_id", F.struct("ts", "event_id").alias("ordinal"), F.concat(F.col("event_type"), F.lit("="), _string("event_id")).alias("value"))
    noise = e.select("user_id", F.struct("ts", "event_id").alias("ordinal"), F.lit("no pair here").alias("value"))
    return files.progress(lines.unionByName(noise), ["user_id"]).select("user_id", "key", "value")


@query("select o_orderkey as id from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O'")
def pending_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.pending(_orders(spark, sf_dir)).select("id")


@query("select o_orderpriority as session, count(*) as landings from orders join customer on o_custkey = c_custkey group by 1")
def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.sessions(_orders(spark, sf_dir))


@query("select 'L' || lpad(cast(count(*) + 1 as varchar), cast(greatest(4, length(cast(count(*) + 1 as varchar))) as integer), '0') as next_id from events")
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.next_id(_landings(spark, sf_dir))


@query("select event_id as id from events where event_type is distinct from 'view'")
def without_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("segment"))
    return results.without_segment(rows, "view").select("id")


@query("""select o_orderkey as id, '20' || lpad(cast(o_orderkey % 100 as varchar), 2, '0') || '-03-04 05:06:07' as stem, case when o_orderkey % 2 = 0 then 'R' || o_custkey else 'UNKNOWN-' || lpad(cast(o_orderkey % 1000 as varchar), 3, '0') end as clip,
 'rtsp://***@host/' || o_custkey as url, o_orderkey % 2 = 0 as network, lpad(cast(o_orderkey // 3600 as varchar), cast(greatest(2, length(cast(o_orderkey // 3600 as varchar))) as integer), '0') || ':' || lpad(cast(o_orderkey // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') as elapsed from orders""")
def texts_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment's start from its name, a clip's name, a URL without its password, a length as text, for each order."""
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name = F.concat(F.lit("/a/20"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("-03-04_06-06-07.mp4"))
    who = F.when(k % 2 == 0, F.concat(F.lit(" r"), _string("o_custkey"), F.lit("!"))).otherwise(F.lit(" "))
    source = F.concat(F.when(k % 2 == 0, "rtsp").otherwise("file"), F.lit("://x"))
    return o.select(
        k.alias("id"), F.date_format(values.segment_start(name, 1.0), "yyyy-MM-dd HH:mm:ss").alias("stem"), values.clip_name(who, (k % 1000).cast("int")).alias("clip"),
        values.redacted(F.concat(F.lit("rtsp://user:secret@host/"), _string("o_custkey"))).alias("url"), values.is_network_source(source).alias("network"), values.elapsed_text(k.cast("double") + 0.7).alias("elapsed"),
    )


@query("select event_id from events where event_id % 1919 > 2 and user_id % 1079 > 2 and event_id % 1919 + 30 < 1918 and user_id % 1079 + 20 < 1078")
def inside_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1919).alias("x"), (F.col("user_id") % 1079).alias("y"), F.lit(30).alias("w"), F.lit(20).alias("h"))
    return tracks.inside_frame(e).select("event_id")


@query("""with p as (select user_id, event_id as ordinal, event_type as segment, cast(floor(value * 10) as integer) as frame from events), w as (select user_id, 'view' as segment, cast(floor(avg(value) * 10) as integer) as frame from events group by 1)
 select user_id as id, w.frame as wanted, arg_min(ordinal, ((p.segment is distinct from w.segment)::int, abs(p.frame - w.frame), ordinal)) as ordinal from p join w using (user_id) group by 1, 2""")
def nearest_track_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean is exact: sums of doubles depend on their order, and a mean on a frame's edge would fall to either side."""
    e = _table(spark, sf_dir, "events")
    points = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("segment"), F.floor(F.col("value") * 10).cast("int").alias("frame"))
    tenths = F.sum(F.col("value").cast("decimal(30,12)") * 10)
    frames = e.groupBy(F.col("user_id").alias("id")).agg(F.lit("view").alias("segment"), tenths.alias("s"), F.count("value").alias("n"))
    frames = frames.select("id", "segment", F.floor((F.col("s") - F.pmod("s", "n")) / F.col("n")).cast("int").alias("frame"))
    return matching.nearest_point(frames, points).select("id", "wanted", "ordinal")


@query("""with p as (select user_id, event_id, ts, value - 50 as world_x, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) - 1 as place, count(*) over (partition by user_id) as n from events),
 k as (select user_id, case user_id % 4 when 0 then 'short' when 1 then 'long' when 2 then 'unseen' else 'on_ground' end as outcome from events group by 1)
 select user_id, arg_min(event_id, (case outcome when 'short' then cast(place as double) when 'long' then -cast(place as double) when 'unseen' then abs(world_x) else (place <> n // 2)::int::double end, place)) as event_id from p join k using (user_id) group by 1""")
def landing_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    points = e.select("user_id", F.col("event_id").alias("frame"), (F.unix_micros("ts") / 1e6).alias("t"), (F.col("value") - 50).alias("world_x"))
    k = F.col("user_id") % 4
    outcome = F.when(k == 0, "short").when(k == 1, "long").when(k == 2, "unseen").otherwise("on_ground")
    estimates = e.select("user_id").distinct().select("user_id", outcome.alias("outcome"), F.lit(None).cast("double").alias("contact_t"))
    return tracks.anchors(points, estimates, "user_id").select("user_id", F.col("anchor.frame").alias("event_id"))


@query("""with t as (select o_orderkey, o_totalprice % 100 as col, l_linenumber as i, l_quantity + l_linenumber as u, l_extendedprice as v from orders join lineitem on o_orderkey = l_orderkey)
 select o_orderkey as id, (arg_min(u, (abs(u - col), u, v)) filter (where abs(u - col) <= 25)) as u, (arg_min(v, (abs(u - col), u, v)) filter (where abs(u - col) <= 25)) as v from t group by 1""")
def tyre_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the tyre candidates of their orders' columns."""
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    tyre = F.struct((F.col("l_quantity") + F.col("l_linenumber")).alias("u"), F.col("l_extendedprice").alias("v"), F.lit(1.0).alias("area"))
    frames = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 100).alias("column")).agg(F.collect_list(tyre).alias("tyres"))
    return tracks.nearest_tyre(frames).select("id", "tyre.u", "tyre.v")


@query("select ts as utc, count(*) as n from events where event_type = 'view' group by 1")
def fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second source of a feed stands in, since the first has no rows."""
    e = _table(spark, sf_dir, "events")
    out = files.first_with_rows(e.filter("event_type = 'no such type'"), e.filter("event_type = 'view'"))
    return _naive(out.groupBy(F.col("ts").alias("utc")).agg(F.count("*").alias("n")), "utc")


@query("""with r as (select event_id, greatest(0, least(event_id % 1200 - 100, 899)) as frame, user_id % 10 * 90 as c from events), i as (select *, frame between c + 5 and c + 115 as reused from r)
 select event_id, frame, case when reused then c else greatest(0, frame - 60) end as first_frame, reused, round(frame / 50.0, 6) as offset_s from i""")
def viewer_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    rows = e.select("event_id", (F.col("event_id") % 1200 - 100).alias("frame"), F.lit(900).alias("total"), (F.col("user_id") % 10 * 90).alias("cached_first"), F.lit(121).alias("cached_count"), F.lit(50.0).alias("fps"))
    return viewing.frame_window(rows).select("event_id", "frame", "first_frame", "reused", F.round("offset_s", 6).alias("offset_s"))


@query("""select event_id, strftime(ts + interval 2 hour, '%H:%M:%S') as clock, case when event_id % 3 = 0 then 'club day' else strftime(ts, '%A, %d %B %Y') end as title,
 case when event_id % 5 between 1 and 3 then 'p' || (event_id % 5 - 1) end as path, case when user_id % 2 = 0 then 0.0 else round(event_id / 25.0, 6) end as at_s from events""")
def local_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    session = F.when(F.col("event_id") % 3 == 0, F.lit("club day")).otherwise(F.date_format("ts", "yyyy-MM-dd_'final'"))
    fps = F.when(F.col("user_id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(25.0))
    path = viewing.place_in_window(F.col("event_id") % 5, F.lit(1), F.array(*(F.lit(f"p{i}") for i in range(3))))
    return e.select("event_id", viewing.local_time("ts", "+02:00").alias("clock"), viewing.session_title(session).alias("title"), path.alias("path"), F.round(viewing.frame_time(F.col("event_id"), fps), 6).alias("at_s"))


@query("select event_id from events where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def segment_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return viewing.indexed_only(_table(spark, sf_dir, "events"), index, ["user_id"]).select("event_id")


@query("select o_orderkey as id from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    done = _table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return viewing.waiting(known, done, ["id"])


@query("select user_id, count(*) as gaps, round(sum(value), 4) as gap_s from events where event_type = 'error' group by 1")
def recorder_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = viewing.gap_totals(_table(spark, sf_dir, "events").filter("event_type = 'error'"), ["user_id"], "value")
    return out.select("user_id", "gaps", F.round("gap_s", 4).alias("gap_s"))


@query("""select count(*) filter (where o_orderstatus <> 'F' and o_orderpriority <> '1-URGENT' and o_orderkey % 3 = 0) as matched, count(*) as landings from orders""")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    before = o.select(F.col("o_orderkey").alias("id"), F.lit(" ").alias("registration"))
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("pending")
    after = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("R"), _string("o_custkey"))).otherwise(F.lit("")).alias("registration"),
        status.alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "judge").alias("identified_by"),
    )
    return viewing.match_counters(before, after)


@query("select l_orderkey as id, l_linenumber as line, c_name as name from lineitem left join customer on c_custkey = l_suppkey * 7")
def frame_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") * 7).alias("segment"))
    meta = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("segment"), F.col("c_name").alias("name"))
    return viewing.frame_meta(frames, meta, ["segment"]).select("id", "line", "name")


@query("""with b as (select l_orderkey as id, count(*) as n, count(v) as k, median(v) as m from (select *, case when l_partkey % 3 <> 0 then l_quantity + 0.5 end as v from lineitem) where abs(l_linenumber - 3) <= 2 group by 1)
 select o_orderkey as id, case when k >= greatest(3, n // 3) then m end as middle from orders left join b on id = o_orderkey where o_orderkey in (select l_orderkey from lineitem)""")
def band_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the columns of their order's profile; every third has no value."""
    li = _table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity") + 0.5)
    profile = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("u"), value.cast("double").alias("value"))).alias("columns"))
    return profile.select("id", viewing.band_median(F.col("columns"), F.lit(3), 2).alias("middle"))


@query("""with l as (select l_orderkey as id, list(cast(l_quantity as double) order by l_linenumber, l_quantity) as v, count(*) as n from lineitem group by 1),
 s as (select id, i, case when n < 7 then v[i] else list_median([v[greatest(1, least(n, i + d))] for d in range(-3, 4)]) end as smooth from (select *, unnest(range(1, n + 1)) as i from l)) select id, cast(i as integer) as line, smooth from s""")
def median_of_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))), lambda x: x["q"])
    rows = li.groupBy(F.col("l_orderkey").alias("id")).agg(ordered.alias("v"))
    out = rows.select("id", F.posexplode(viewing.smoothed(F.col("v"))).alias("i", "smooth"))
    return out.select("id", (F.col("i") + 1).alias("line"), "smooth")


@query("""with p as (select n_nationkey as id, (1000 + n_nationkey * 40) / 2.0 as u, 700 + n_nationkey * 10 as h from nation) select id, case when (0.0005 * u + 0.03 * h * 0.6 - 10) / (0.00001 * u + 0.0002 * h * 0.6 + 1) >= (0.0005 * u + 0.03 * h * 0.9 - 10) / (0.00001 * u + 0.0002 * h * 0.9 + 1) then 1.0 else -1.0 end as sign from p""")
def far_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), viewing.far_sign(MATRIX, 1000 + F.col("n_nationkey") * 40, 700 + F.col("n_nationkey") * 10).alias("sign"))


def _pixel(row: str, y: str) -> str:
    a, b, c = MATRIX["uvw".index(row)]
    return f"({a} * x + {b} * {y} + {c})"


@query(f"""with g as (select c_custkey as id, c_custkey % 40 * 5.0 as x, -10.0 as y1, 10.0 + c_custkey % 7 as y2 from customer) select id, {', '.join(f"cast(round_even({_pixel(c, 'y' + k)} / {_pixel('w', 'y' + k)}, 0) as integer) as {c}{k}" for k in '12' for c in 'uv')} from g""")
def ground_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lines = _table(spark, sf_dir, "customer").select(k.alias("id"), (k % 40 * 5.0).alias("x_m"), F.lit(-10.0).alias("y_from"), (k % 7 + 10.0).alias("y_to"))
    return viewing.ground_lines(lines, MATRIX).select("id", "u1", "v1", "u2", "v2")

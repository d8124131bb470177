"""Every operator as a query on the benchmark tables, which play the parts of landings, fixes, sorties and tracks.

Most queries only rename columns and call an operator; some need a few expressions around it, and `dedup_pairs` and
`ordered_distinct` are plain DataFrame code. `ORACLES` has the SQL that gives the same rows. `records` adds to both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import calibration, checks, fits, matching, ordered, results, timeline, tracks
from ..schemas import Field, MatchLimits
from . import judging

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: A projection of the plane, as a calibration has it.
MATRIX = ((0.02, 0.001, -15.0), (0.0005, 0.03, -10.0), (0.00001, 0.0002, 1.0))
DAY = 86_400.0


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its instants as timestamps of the session's zone, which is UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def _day(at: str):
    return F.floor(F.unix_micros(F.col(at)) / (DAY * 1e6)).cast("long")


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    """Instants without a zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


OUTCOME = "case event_type when 'purchase' then 'measured' when 'view' then 'short' when 'click' then 'long' else 'unseen' end"
LABEL_SQL = """case when outcome = 'measured' and x is not null then (case when x < 0 then '-' else '+' end) || printf('%.1f', abs(round_even(x, 1))) || ' m'
 when outcome = 'short' then '< ' || (case when x < 0 then '-' else '+' end) || printf('%.0f', abs(round_even(x, 0))) || ' m'
 when outcome = 'long' then '> ' || (case when x < 0 then '-' else '+' end) || printf('%.0f', abs(round_even(x, 0))) || ' m' else 'pick frame' end"""


def _landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landings: the value in tenths, less 100, is the offset."""
    e = _table(spark, sf_dir, "events")
    x = (F.round(F.col("value") * 10) - 1000) / 10
    return e.select(
        F.col("event_id").alias("id"), F.expr(OUTCOME).alias("outcome"), x.alias("longitudinal_m"), F.lit(None).cast("double").alias("confirmed_longitudinal_m"),
        x.alias("bound_m"), F.lit("confirmed").alias("status"), "ts", "user_id",
    )


@query(f"""select id, outcome, round(x, 6) as x, case when outcome in ('short', 'long') then 0.0 when outcome = 'measured' then round_even(greatest(0.0, 100 - (case when x < 0 then 5 else 2 end) * abs(x)), 0) end as score,
 {LABEL_SQL} as label from (select event_id as id, {OUTCOME} as outcome, (round(value * 10) - 1000) / 10 as x from events)""")
def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = results.scored(_landings(spark, sf_dir))
    return out.select("id", "outcome", F.round("scored_longitudinal_m", 6).alias("x"), "score", "label")


@query(f"select id, case when outcome in ('measured', 'short', 'long', 'unseen') then 'landing' else 'pass' end as kind from (select event_id as id, {OUTCOME} as outcome from events)")
def kind_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landings(spark, sf_dir).select("id", values.kind("outcome").alias("kind"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as landings of their customers."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.lit("landing").alias("kind"), status.alias("status"), F.col("c_name").alias("pilot"), F.col("c_mktsegment").alias("registration"),
        F.lit(None).cast("string").alias("competition_number"), F.lit(None).cast("string").alias("aircraft_type"), F.round("o_totalprice").alias("score"),
        F.col("o_orderdate").alias("touchdown_utc"), F.col("o_orderdate").alias("first_utc"), F.col("o_orderpriority").alias("session"),
    )


@query("""with x as (select lower(trim(c_name)) as k, max(c_name) as name, sum(round(o_totalprice)) as total, count(*) as n, max(c_mktsegment) as a from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' group by 1)
 select row_number() over (order by total desc, n desc, lower(name), k) as position, name, total, n, a as aircraft from x""")
def rank_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.rank(_orders(spark, sf_dir)).select("position", "name", "total", "n", F.array_join("aircraft", ",").alias("aircraft"))


@query("""select session, count(*) as "count", count(*) filter (where s = 'O') as pending, count(*) filter (where s = 'F') as confirmed, count(*) filter (where s not in ('O', 'F')) as rejected
 from (select o_orderpriority as session, o_orderstatus as s from orders join customer on o_custkey = c_custkey) group by 1""")
def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.counters(_orders(spark, sf_dir), ["session"])


@query("""with x as (select 'p:' || lower(trim(c_name)) as key, o_orderkey as id, row_number() over (partition by c_name order by o_orderdate desc, o_orderkey desc) as r, count(*) over (partition by c_name) as n
 from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F') select key, id, n - r + 1 as ordinal, greatest(n - r + 1 - 4, 0) as earlier from x where r <= 4""")
def last_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = results.last_landings(_orders(spark, sf_dir)).select("key", "id", "ordinal", "earlier")
    return out.withColumns({"ordinal": F.col("ordinal").cast("long"), "earlier": F.col("earlier").cast("long")})


@query("select o_custkey as custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as latest from orders group by 1")
def latest_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.latest(_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority", "latest").withColumnRenamed("o_custkey", "custkey")


@query("select o_orderkey as id, last_value(p ignore nulls) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding) as suggested from (select *, nullif(o_orderpriority, '5-LOW') as p from orders)")
def previous_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return timeline.previous_known(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "p", "suggested").select(F.col("o_orderkey").alias("id"), "suggested")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments of their users: value thousand seconds long."""
    e = _table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_id").alias("name"), F.col("ts").alias("start_utc"), F.round(F.col("value") * 1000).alias("duration_s"), F.lit(60.0).alias("fps"))


SPANS = """segs as (select user_id, event_id as name, ts as start_utc, ts + to_microseconds(cast(round(value * 1000) as bigint) * 1000000) as end_utc from events),
 nexts as (select *, lead(start_utc) over w as next_start, lead(name) over w as next_name from segs window w as (partition by user_id order by start_utc, name)),
 spans as (select *, greatest(start_utc, least(end_utc, coalesce(next_start, end_utc))) as until_utc from nexts)"""


@query(f"with {SPANS} select name, start_utc, until_utc from spans")
def extent_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(timeline.extents(_segments(spark, sf_dir), ["user_id"], 30 * DAY).select("name", "start_utc", "until_utc"), "start_utc", "until_utc")


@query(f"with {SPANS}, d as (select *, (epoch_us(next_start) - epoch_us(end_utc)) / 1e6 as delta from spans) select user_id, name as after, next_name as before, case when delta > 0 then 'gap' else 'overlap' end as kind, round(abs(delta), 6) as seconds from d where abs(delta) > 1.5")
def gap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.gaps(_segments(spark, sf_dir), ["user_id"], bucket_s=30 * DAY).select("user_id", "after", "before", "kind", F.round("seconds", 6).alias("seconds"))


@query(f"""with {SPANS}, d as (select *, (epoch_us(next_start) - epoch_us(end_utc)) / 1e6 as delta from spans) select user_id, count(*) as segments, round(sum(epoch_us(until_utc) - epoch_us(start_utc)) / 1e6, 3) as recorded_s,
 round((max(epoch_us(until_utc)) - min(epoch_us(start_utc))) / 1e6, 3) as span_s, count(*) filter (where delta > 1.5) as gaps, count(*) filter (where delta < -1.5) as overlaps,
 round(coalesce(case when max(epoch_us(until_utc)) > min(epoch_us(start_utc)) then sum(epoch_us(until_utc) - epoch_us(start_utc)) / (max(epoch_us(until_utc)) - min(epoch_us(start_utc))) end, 0), 6) as coverage from d group by 1""")  # fmt: skip
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.report(_segments(spark, sf_dir), ["user_id"], bucket_s=30 * DAY)
    return out.select("user_id", "segments", F.round("recorded_s", 3).alias("recorded_s"), F.round("span_s", 3).alias("span_s"), "gaps", "overlaps", F.round("coverage", 6).alias("coverage"))


@query("""with d as (select user_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6 as g from events), m as (select user_id, median(g) as med from d where g is not null group by 1)
 select d.user_id, count(*) as n, round(any_value(med), 7) as median_s, round(avg(case when abs(g - med) > med * 0.2 then 1.0 else 0.0 end), 9) as irregular_share from d join m using (user_id) where g is not null group by 1""")
def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = timeline.first_differences(_table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 30 * DAY)
    out = timeline.spacing(d, ["user_id"])
    return out.select("user_id", "n", F.round("median_s", 7).alias("median_s"), F.round("irregular_share", 9).alias("irregular_share"))


@query("""with w as (select event_id, value, lag(value) over a as p, lead(value) over a as q from events window a as (partition by user_id order by ts, event_id))
 select event_id, case when p is null or q is null then value else greatest(least(p, value), least(greatest(p, value), q)) end as smooth from w""")
def median3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.median3(_table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "value", F.floor(F.unix_micros("ts") / (30 * DAY * 1e6)).cast("long")).select("event_id", "smooth")


@query("""with w as (select *, case when lag(event_type) over a = event_type then 0 else 1 end as c from events window a as (partition by user_id order by ts, event_id)),
 r as (select *, sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from w) select user_id, cast(run as bigint) as run, any_value(event_type) as event_type, min(ts) as "first", max(ts) as "last", count(*) as n from r group by user_id, run""")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.runs(_table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type", _day("ts"))
    return _naive(out.withColumn("run", F.col("run").cast("long")), "first", "last")


@query(f"""with {SPANS} select e.event_id, s.name as segment, round((epoch_us(e.ts) - epoch_us(s.start_utc)) / 1e6, 3) as offset_s, cast(floor((epoch_us(e.ts) - epoch_us(s.start_utc)) / 1e6 * 60) as integer) as frame_index
 from events e join spans s on e.user_id = s.user_id and s.start_utc <= e.ts and e.ts < s.until_utc where e.event_type = 'purchase'""")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("when_utc"))
    out = timeline.resolve(points, _segments(spark, sf_dir), ["user_id"], width_s=DAY)
    return out.select("event_id", "segment", F.round("offset_s", 3).alias("offset_s"), "frame_index")


@query(f"""with {SPANS}, l as (select event_id as id, user_id, ts - interval 3 second as a, ts + interval 5 second as b from events where event_type = 'error')
 select id, name, round(greatest(epoch_us(a) - epoch_us(start_utc), 0) / 1e6, 3) as offset_s, round((least(epoch_us(b), epoch_us(end_utc)) - greatest(epoch_us(a), epoch_us(start_utc))) / 1e6, 3) as duration_s
 from l join segs s on l.user_id = s.user_id and end_utc > a and start_utc < b""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("touchdown_utc"))
    out = timeline.cut_plan(wanted, _segments(spark, sf_dir), ["user_id"])
    return out.select("id", "name", F.round("offset_s", 3).alias("offset_s"), F.round("duration_s", 3).alias("duration_s"))


FIELD = Field(airfield="AUTO", lat=47.0, lon=7.0, elevation_m=100.0)
WIDE = MatchLimits(fix_window_s=900.0, logbook_window_s=3600.0, close_s=600.0)
DISTANCE = "2 * 6371000.0 * asin(sqrt(power(sin((radians(47.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(47.0)) * power(sin((radians(7.0) - radians(lon)) / 2), 2)))"
FIXES = "fixes as (select event_id as ordinal, ts as utc, 'F' || user_id as flarm_id, 47.0 + (event_id % 200) / 10000.0 as lat, 7.0 + (event_id % 170) / 10000.0 as lon, value as alt_m from events where event_type = 'view')"


def _touchdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("touchdown_utc"))


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").filter("event_type = 'view'")
    return e.select(
        F.col("event_id").alias("ordinal"), F.col("ts").alias("utc"), F.concat(F.lit("F"), F.col("user_id").cast("string")).alias("flarm_id"), F.lit("").alias("registration"),
        F.lit("").alias("competition_number"), (F.lit(47.0) + F.col("event_id") % 200 / 10000.0).alias("lat"), (F.lit(7.0) + F.col("event_id") % 170 / 10000.0).alias("lon"), F.col("value").alias("alt_m"),
    )


FIX_MATCH = f"""{FIXES}, near as (select *, {DISTANCE} as dist from fixes), at_field as (select * from near where dist <= 1500 and alt_m - 100 <= 150),
 pairs as (select t.event_id as id, f.*, (epoch_us(f.utc) - epoch_us(t.ts)) / 1e6 as dt from events t join at_field f on f.utc between t.ts - interval 900 second and t.ts + interval 900 second where t.event_type = 'error'),
 scored as (select *, abs(dt) / 900 + dist / 1500 as s from pairs), best as (select *, row_number() over (partition by id, flarm_id order by s, ordinal) as r, min(ordinal) over (partition by id, flarm_id) as seen from scored),
 ranked as (select *, row_number() over w as k, lead(s) over w as runner, count(*) over (partition by id) as n from best where r = 1 window w as (partition by id order by s, seen)),
 live as (select id, flarm_id, dt, dist, n, greatest(0.05, 1 - s / 2) * (case when runner is null then 1.0 else least(1.0, (runner - s) / greatest(runner, 1e-6) + 0.5) end) as p from ranked where k = 1)"""


@query(f"with {FIX_MATCH} select id, flarm_id, round(dt, 3) as dt_s, round(dist, 3) as distance_m, n as candidates, round_even(p, 2) as probability from live")
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching.match_fixes(_touchdowns(spark, sf_dir), _fixes(spark, sf_dir), FIELD, WIDE).select("id", "match.*")
    return m.select("id", "flarm_id", F.round("dt_s", 3).alias("dt_s"), F.round("distance_m", 3).alias("distance_m"), "candidates", "probability")


def _sorties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").filter("event_type in ('purchase', 'signup')")
    off = values.seconds_later(F.col("ts"), F.lit(1800.0))
    return e.select(
        F.col("event_id").alias("ordinal"), F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("registration"), F.lit("").alias("competition_number"), F.lit("").alias("aircraft_type"),
        F.col("ts").alias("landing_utc"), F.when(F.col("event_type") == "purchase", off).alias("takeoff_utc"), F.when(F.col("event_id") % 3 != 0, "auto").alias("landing_place"),
        F.create_map(F.lit("flarm_id"), F.lit("")).alias("raw"),
    )


BOOK_MATCH = """sorties as (select event_id as ordinal, 'R' || user_id as registration, ts as l, case when event_type = 'purchase' then ts + interval 1800 second end as o from events where event_type in ('purchase', 'signup')),
 ev as (select ordinal, 0 as part, 'landing' as event, l as seen_at, registration from sorties union all select ordinal, 1, 'takeoff', o, registration from sorties where o is not null),
 bp as (select t.event_id as id, ev.*, (epoch_us(seen_at) - epoch_us(t.ts)) / 1e6 as dt from events t join ev on seen_at between t.ts - interval 3600 second and t.ts + interval 3600 second where t.event_type = 'error'),
 br as (select *, row_number() over w as k, lead(abs(dt)) over w as runner, count(*) over (partition by id) as n from bp window w as (partition by id order by abs(dt), ordinal, part)),
 book as (select id, registration, event, dt, n, greatest(0.05, 1 - abs(dt) / 3600) * (case when runner is null then 1.0 when runner - abs(dt) < 600 then 0.5 else 0.8 end) as p from br where k = 1)"""


@query(f"with {BOOK_MATCH} select id, registration, event, round(dt, 3) as dt_s, n as candidates, round_even(p, 2) as probability from book")
def unpivot_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching.match_logbook(_touchdowns(spark, sf_dir), _sorties(spark, sf_dir), FIELD, WIDE).select("id", "match.*")
    return m.select("id", "registration", "event", F.round("dt_s", 3).alias("dt_s"), "candidates", "probability")


@query(f"""with {FIX_MATCH}, {BOOK_MATCH} select t.event_id as id, case when live.id is not null then 'live' when book.id is not null then 'logbook' end as source,
 case when live.id is not null then 'fix' else book.event end as event, round(coalesce(live.dt, book.dt), 3) as dt_s from events t left join live on live.id = t.event_id left join book on book.id = t.event_id where t.event_type = 'error'""")
def fallback_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching.identify(_touchdowns(spark, sf_dir), _fixes(spark, sf_dir), _sorties(spark, sf_dir), FIELD, WIDE)
    return m.select("id", "match.source", "match.event", F.round("match.dt_s", 3).alias("dt_s"))


@query("""with t as (select event_id, user_id as segment, cast(floor(value * 10) as integer) as f, cast(floor(value * 10) as integer) + 40 as l, event_id % 2 as odd from events)
 select event_id from t where odd = 0 and not exists (select 1 from t s where s.odd = 1 and s.segment = t.segment and (abs(s.f - t.f) <= 3 or abs(s.l - t.l) <= 3))""")
def anti_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.floor(F.col("value") * 10).cast("int")
    t = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("segment"), first.alias("first_frame"), (first + 40).alias("last_frame"))
    stored = t.filter("event_id % 2 = 1").select(F.col("segment").alias("first_segment"), "first_frame", F.col("segment").alias("last_segment"), "last_frame")
    return matching.not_seen(t.filter("event_id % 2 = 0"), stored).select("event_id")


@query("select user_id, count(*) as n, max(value) as peak_area, max(value * 3) - min(value * 3) as span_px from events group by 1 having count(*) >= 12 and max(value) >= 90 and max(value * 3) - min(value * 3) >= 250")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("user_id", F.col("value").alias("area"), (F.col("value") * 3).alias("cx"))
    return tracks.admitted(e, ["user_id"], area=90)


M_SQL = ["({0} * l_quantity + {1} * l_extendedprice / 100 + {2})".format(*r) for r in MATRIX]


@query(f"select l_orderkey, l_linenumber, round({M_SQL[0]} / {M_SQL[2]}, 6) as world_x, round({M_SQL[1]} / {M_SQL[2]}, 6) as world_y, abs({M_SQL[0]} / {M_SQL[2]}) <= 19.4 as in_range from lineitem")
def project_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice") / 100)
    out = tracks.on_ground_plane(rows, MATRIX, "l_quantity", "v")
    return out.select("l_orderkey", "l_linenumber", F.round("world_x", 6).alias("world_x"), F.round("world_y", 6).alias("world_y"), values.in_window("world_x").alias("in_range"))


@query(f"with {FIXES} select ordinal, round({DISTANCE}, 3) as distance_m from fixes")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    away = values.haversine_m(F.col("lat"), F.col("lon"), F.lit(47.0), F.lit(7.0))
    return _fixes(spark, sf_dir).select("ordinal", F.round(away, 3).alias("distance_m"))


@query("""with m as (select user_id, avg(value) as m from events group by 1) select e.user_id, round(sqrt(avg((value - m) * (value - m))), 6) as rms, round(max(abs(value - m)), 6) as worst from events e join m on m.user_id = e.user_id group by 1""")
def residual_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    off = e.join(e.groupBy("user_id").agg(F.avg("value").alias("m")), "user_id").withColumn("d", F.col("value") - F.col("m"))
    return calibration.rms(off, ["user_id"], "d").select("user_id", F.round("rms", 6).alias("rms"), F.round("worst", 6).alias("worst"))


@query("select user_id, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) as spread from events group by 1")
def percentile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.spreads(_table(spark, sf_dir, "events"), "user_id", "value").select("user_id", F.round("spread", 6).alias("spread"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of their users' tracks, an hour a second."""
    e = _table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_id").alias("index"), ((F.unix_micros("ts") - 1_704_067_200_000_000) / 3.6e9).alias("t"), F.col("value").alias("y"))


@query("""with s as (select user_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 as t, value as y from events) select user_id, count(*) as n, round(regr_slope(y, t), 6) as slope, round(regr_intercept(y, t), 5) as intercept,
 round(sqrt(greatest(0, regr_syy(y, t) - regr_slope(y, t) * regr_sxy(y, t)) / count(*)), 5) as rms from s group by 1 having count(*) > 2""")
def line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fits.lines(_samples(spark, sf_dir), "user_id").filter("n > 2")
    return out.select("user_id", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("rms", 5).alias("rms"))


@query("""with s as (select user_id, event_id as i, (epoch_us(ts) - 1704067200000000) / 3.6e9 as t, value as y from events),
 o as (select *, row_number() over w as place, count(*) over (partition by user_id) as n, lead(t) over w - t as gap, min(t) over (partition by user_id) as t_first from s window w as (partition by user_id order by t, i)),
 g as (select user_id, any_value(n) as n, any_value(t_first) as t_first, avg(y) as my, median(gap) / 8 as step, max(t - t_first) filter (where place = 4) as lo, max(t - t_first) filter (where place = n - 3) as hi from o group by 1),
 k as (select *, unnest(range(cast(ceil((hi + step / 2 - lo) / step) as bigint))) as k from g where n >= 8 and step > 0),
 d as (select k.*, lo + k * step as c, least(o.t - k.t_first - lo - k * step, 0) as l, greatest(o.t - k.t_first - lo - k * step, 0) as r, o.y - my as y from k join o on o.user_id = k.user_id),
 m as (select user_id, k, any_value(n) as n, any_value(c) + any_value(t_first) as tc, any_value(my) as my, sum(l) as l, sum(r) as r, sum(l * l) as ll, sum(r * r) as rr, sum(y) as y, sum(l * y) as ly, sum(r * y) as ry, sum(y * y) as yy from d group by 1, 2),
 f as (select *, (y - l * ly / ll - r * ry / rr) / (n - l * l / ll - r * r / rr) as a from m where ll > 0 and rr > 0), h as (select *, (ly - l * a) / ll as p, (ry - r * a) / rr as q from f), e as (select *, yy - a * y - p * ly - q * ry as sse from h),
 b as (select user_id, arg_min({'n': n, 'tc': tc, 'y': a + my, 'p': p, 'q': q, 'sse': sse}, (round(sse, 9), k)) as b from e group by 1)
 select user_id, b.n as n, round(b.tc, 6) as tc, round(b.y, 6) as y_at, round(b.p, 6) as slope_before, round(b.q, 6) as slope_after, round(sqrt(greatest(b.sse, 0) / b.n), 6) as rms from b""")
def hinge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fits.hinges(_samples(spark, sf_dir), "user_id", "t", "y")
    return out.select("user_id", "n", *(F.round(c, 6).alias(c) for c in ("tc", "y_at", "slope_before", "slope_after", "rms")))


#: The fits of `fits.outcomes` as a grid in SQL: every corner of every series over all of its samples.
OUTCOMES = """with s as (select user_id, event_id as i, (epoch_us(ts) - 1704067200000000) / 3.6e9 as t, (epoch_us(ts) - 1704067200000000) / 3.6e9 * 0.5 as x, value as y from events),
 p0 as (select user_id, i, t, 'depth' as part, y as v from s union all select user_id, i, t, 'gap', y from s where i % 2 = 0 union all select user_id, i, t, 'reach', y from s),
 p1 as (select *, lag(v) over w as a, lead(v) over w as b from p0 window w as (partition by user_id, part order by t, i)),
 p as (select user_id, i, t, part, case when part = 'depth' or a is null or b is null then v else greatest(least(a, v), least(greatest(a, v), b)) end as y from p1),
 o as (select *, row_number() over w as place, count(*) over q as n, lead(t) over w - t as gap, min(t) over q as t_first, max(t) over q as t_last from p window w as (partition by user_id, part order by t, i), q as (partition by user_id, part)),
 g0 as (select user_id, part, any_value(n) as n, any_value(t_first) as t_first, any_value(t_last) as t_last, avg(y) as my, median(gap) / 8 as step, max(t - t_first) filter (where place = 4) as lo, max(t - t_first) filter (where place = n - 3) as hi,
 quantile_cont(y, 0.9) - quantile_cont(y, 0.1) as spread, stddev_pop(y) as rms_level, coalesce(regr_slope(y, t), 0) as slope, regr_syy(y, t) as syy, regr_sxy(y, t) as sxy, avg(t) as mt from o group by 1, 2),
 g as (select *, my + slope * (t_first - mt) as y_first, sqrt(greatest(0, syy - slope * sxy) / n) as rms_line from g0),
 k as (select *, unnest(range(cast(ceil((hi + step / 2 - lo) / step) as bigint))) as k from g where n >= 8 and step > 0),
 d as (select k.user_id, k.part, k, k.n, k.t_first, my, lo + k * step as c, o.t - k.t_first as tt, o.y - my as y from k join o on o.user_id = k.user_id and o.part = k.part),
 m as (select user_id, part, k, any_value(n) as n, any_value(c) as c, any_value(t_first) as t_first, any_value(my) as my, sum(least(tt - c, 0)) as l, sum(greatest(tt - c, 0)) as r, sum(least(tt - c, 0) ** 2) as ll, sum(greatest(tt - c, 0) ** 2) as rr, sum(y) as y, sum(least(tt - c, 0) * y) as ly, sum(greatest(tt - c, 0) * y) as ry,
 sum(y * y) as yy, count(*) filter (where tt < c) as nb, count(*) filter (where tt <= c) as nu, coalesce(sum(y) filter (where tt < c), 0) as yb, coalesce(sum(y * y) filter (where tt < c), 0) as yyb from d group by 1, 2, 3),
 h0 as (select *, (y - l * ly / ll - r * ry / rr) / (n - l * l / ll - r * r / rr) as a from m where part = 'depth' and ll > 0 and rr > 0), h1 as (select *, (ly - l * a) / ll as sb, (ry - r * a) / rr as sa from h0),
 h2 as (select *, yy - a * y - sb * ly - sa * ry as sse, case when abs(sa) <= abs(sb) then (yy - yyb - 2 * a * (y - yb) + (n - nb) * a * a - 2 * sa * ry + 2 * a * sa * r + sa * sa * rr) / nullif(n - nb, 0) else (yyb - 2 * a * yb + nb * a * a - 2 * sb * ly + 2 * a * sb * l + sb * sb * ll) / nullif(nb, 0) end as ground from h1),
 hb as (select user_id, arg_min({'tc': c + t_first, 'y': a + my, 'sb': sb, 'sa': sa, 'rms': sqrt(greatest(sse, 0) / n), 'nb': nb, 'rg': sqrt(greatest(ground, 0))}, (round(sse, 9), k)) as h from h2 group by 1),
 f0 as (select *, 'landing' as model, -l as l1, ll as l2, -ly as lg from m where part <> 'depth' union all select *, 'departure', r, rr, ry from m where part <> 'depth'), f1 as (select *, (n * lg - l1 * y) / (n * l2 - l1 * l1) as sl from f0 where n * l2 - l1 * l1 > 0),
 f2 as (select *, yy - (y - sl * l1) / n * y - sl * lg as sse from f1 where sl > 0), fb as (select user_id, part, model, arg_min({'tc': c + t_first, 'sl': sl, 'sse': sse, 'rms': sqrt(greatest(sse, 0) / n), 'nb': nb, 'nu': nu}, (round(sse, 9), k)) as f from f2 group by 1, 2, 3),
 hv0 as (select g.*, h, abs(h.sa) <= abs(h.sb) as after_, abs(h.sb - h.sa) * case when abs(h.sa) <= abs(h.sb) then h.tc - t_first else t_last - h.tc end as fall from g left join hb using (user_id) where part = 'depth'),
 hv1 as (select *, coalesce(fall >= 1 and not (coalesce(h.rg > 0, false) and fall < 4 * h.rg) and h.rms <= 0.8 * rms_line, false) as hinge, rms_line < 0.8 * rms_level and abs(slope) * (t_last - t_first) >= 1 as straight from hv0),
 hv as (select user_id, case when n < 2 then 'none' when hinge then 'hinge' when straight then 'line' else 'level' end as hm, case when hinge then h.tc end as htc, case when hinge then h.y when straight then y_first else my end as y0, case when hinge then h.sb when straight then slope else 0 end as sb,
 case when hinge then h.sa when straight then slope else 0 end as sa, case when hinge then h.rms when straight then rms_line else rms_level end as hrms, case when hinge then h.nb else n end as hnb from hv1),
 sv0 as (select g.*, a.f as a, b.f as b, coalesce(a.f.sl * (a.f.tc - t_first) >= 5, false) as oka, coalesce(b.f.sl * (t_last - b.f.tc) >= 5, false) as okb, g.slope * (t_last - t_first) as change from g left join fb a on a.user_id = g.user_id and a.part = g.part and a.model = 'landing' left join fb b on b.user_id = g.user_id and b.part = g.part and b.model = 'departure' where g.part <> 'depth' and g.n >= 8),
 sv1 as (select *, oka and (not okb or round(a.sse, 9) <= round(b.sse, 9)) as first_ from sv0), sv2 as (select *, coalesce(case when first_ then a.rms when okb then b.rms end <= 0.8 * rms_line, false) and spread >= 4 as cornered from sv1),
 sv3 as (select *, case when spread < 4 then 'flat' when cornered then case when first_ then 'landing' else 'departure' end when rms_line < 0.5 * abs(change) and change <= -5 then 'descending' when rms_line < 0.5 * abs(change) and change >= 5 then 'climbing' else 'flat' end as gm from sv2),
 sv as (select user_id, part, gm, case when cornered then case when first_ then a.tc else b.tc end end as gtc, case when cornered then case when first_ then -a.sl else b.sl end when gm = 'flat' then 0 else slope end as gs, case when cornered then case when first_ then a.rms else b.rms end when spread < 4 then rms_level else rms_line end as grms,
 case when cornered then case when first_ then a.nb else n - b.nu end when gm = 'flat' then 0 else n end as air from sv3),
 gs as (select u.user_id, case when coalesce(a.gm in ('landing', 'departure'), false) or not coalesce(b.gm <> 'flat', false) and a.gm is not null then a else b end as g from (select distinct user_id from s) u left join sv a on a.user_id = u.user_id and a.part = 'gap' left join sv b on b.user_id = u.user_id and b.part = 'reach'),
 v0 as (select hv.*, coalesce(g.gm, 'none') as gm, g.gtc as gtc, g.gs as gs, g.grms as grms, g.air as air from hv left join gs using (user_id)),
 v1 as (select *, gm in ('landing', 'departure') as corner, coalesce(hm = 'hinge', false) and sa > sb as convex, abs(sa) <= abs(sb) as after_, gm in ('descending', 'climbing') as trend from v0),
 v2 as (select *, corner and convex and after_ = (gm = 'landing') as agrees, abs(htc - gtc) * 60 as off from v1), v3 as (select *, coalesce(agrees and off <= 30, false) as joined from v2),
 v4 as (select *, case when gm = 'landing' then 'measured' when corner then 'departure' when gm = 'descending' then 'long' when trend then 'departure' when convex then case when after_ then 'measured' else 'departure' end when hm = 'line' and abs(sb) > 3 then case when sb < 0 then 'long' else 'departure' end when hm in ('level', 'line', 'hinge') then 'unseen' else 'unknown' end as oc,
 case when joined then (htc + gtc) / 2 when corner then gtc when not trend and convex then htc end as tc0 from v3), v5 as (select *, case when oc in ('measured', 'departure') then tc0 end as tc1 from v4),
 w as (select s.user_id, count(*) as n, min(t) as ft, max(t) as lt, arg_min(x, (t, i)) as fx, arg_max(x, (t, i)) as lx, coalesce(regr_slope(x, t), 0) as wv, count(*) filter (where t >= tc1) as gn, regr_intercept(x, t - tc1) filter (where t >= tc1) as gx, coalesce(regr_slope(x, t - tc1) filter (where t >= tc1), 0) as gv, regr_syy(x, t - tc1) filter (where t >= tc1) as gyy, regr_sxy(x, t - tc1) filter (where t >= tc1) as gxy,
 regr_intercept(x, t - tc1) as ax, coalesce(regr_slope(x, t - tc1), 0) as av, regr_syy(x, t - tc1) as ayy, regr_sxy(x, t - tc1) as axy from s join v5 using (user_id) group by 1),
 z as (select v5.*, w.n, w.ft, w.lt, fx, lx, wv, case when w.n < 8 then 'unknown' else oc end as outcome, case when w.n >= 8 then tc1 end as tc, case when gn < 3 then ax else gx end as px, case when gn < 3 then av else gv end as pv, case when gn < 3 then sqrt(greatest(0, ayy - av * axy) / w.n) else sqrt(greatest(0, gyy - gv * gxy) / gn) end as prms, case when gn < 3 then w.n else gn end as pn,
 case when w.n < 8 then 'none' when joined then 'shadow+depth' when corner or trend then 'shadow' when hm <> 'none' then 'depth' else 'none' end as method from v5 join w on w.user_id = v5.user_id),
 y as (select *, outcome = 'measured' and tc is not null as md, greatest(case when method = 'shadow' then case when gs <> 0 then grms / abs(gs) / sqrt(greatest(air, 1)) else 1 / 60.0 end when sb <> sa then hrms / abs(sb - sa) / sqrt(greatest(hnb, 1)) else 1 / 60.0 end, case when joined then abs(htc - gtc) / 2 else 0 end, 0.25 / 60) as sigma from z)
 select user_id, outcome, round(tc, 6) as contact_t, round(case when md then px end, 5) as world_x, round(case when outcome in ('measured', 'departure', 'unseen') and (hm = 'hinge' or method = 'depth') then y0 end, 5) as world_y, round(case when md then pv else wv end, 6) as velocity_mps,
 round(case when md then sqrt((abs(pv) * sigma) ** 2 + (prms / sqrt(pn)) ** 2) else 0 end, 5) as uncertainty_m, round(case outcome when 'long' then lx when 'unseen' then fx end, 5) as bound_x, method,
 concat_ws('; ', case when n < 8 then 'track too short' end, case when joined and off > 4 then 'shadow and depth cues apart; taken between' end, case when coalesce(agrees, false) and not joined then 'depth fit contradicts the shadow' end, case when outcome = 'long' then 'still descending when it left the window' end, case when outcome = 'departure' and tc is null then 'climbing for the whole track' end,
 case when method = 'depth' and convex then 'no shadow: decided from the depth trend alone' end, case when outcome = 'unseen' then 'no descent seen' end, case when md and tc - ft < 6 / 60.0 then 'touched down almost as it came into view' end, case when md and lt - tc < 4 / 60.0 then 'left the window right after touching down' end) as flags from y"""


@query(OUTCOMES)
def track_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _samples(spark, sf_dir)
    s = e.select("user_id", "index", "t", (F.col("t") * 0.5).alias("world_x"), F.col("y").alias("world_y"), F.when(F.col("index") % 2 == 0, F.col("y")).alias("gap_px"), F.col("y").alias("reach_px"))
    out = fits.outcomes(s, "user_id").withColumn("flags", F.array_join("flags", "; "))
    digits = {"contact_t": 6, "world_x": 5, "world_y": 5, "velocity_mps": 6, "uncertainty_m": 5, "bound_x": 5}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query()
def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    blobs = e.select(F.col("user_id").alias("session"), F.floor(F.unix_micros("ts") / 3.6e9).cast("long").alias("frame"), (F.floor(F.unix_micros("ts") / 3.6e9) / 60.0).alias("t"), F.col("value").alias("cx"), (F.col("value") * 2).alias("cy"), F.col("value").alias("area"), F.col("event_id").alias("ordinal"))
    return tracks.assign_tracks(blobs).select("session", "frame", "ordinal", "track")


@query("select distinct user_id, ts from events")
def dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(_table(spark, sf_dir, "events").dropDuplicates(["user_id", "ts"]).select("user_id", "ts"), "ts")


@query("""with f as (select user_id, event_type, min((ts, event_id)) as a from events group by 1, 2) select user_id, string_agg(event_type, ',' order by a) as kinds from f group by 1""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("a"))
    lists = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("a", "event_type"))).alias("l"))
    return lists.select("user_id", F.array_join(F.transform("l", lambda x: x["event_type"]), ",").alias("kinds"))


@query("""with c as (select user_id as id, event_id as seq, case event_type when 'purchase' then 'confirm' when 'click' then 'reject' when 'view' then 'edit' else 'reopen' end as action, case when event_type in ('purchase', 'view') then 'N' || event_id end as note from events)
 select id, arg_max(case action when 'confirm' then 'confirmed' when 'reject' then 'rejected' else 'pending' end, seq) filter (where action <> 'edit') as status, arg_max(note, seq) filter (where note is not null) as note, count(*) as changes from c group by 1""")
def fold_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    action = F.create_map(*(F.lit(x) for p in (("purchase", "confirm"), ("click", "reject"), ("view", "edit")) for x in p))[F.col("event_type")]
    note = F.when(F.col("event_type").isin("purchase", "view"), F.concat(F.lit("N"), F.col("event_id").cast("string")))
    requests = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").alias("at_utc"), F.coalesce(action, F.lit("reopen")).alias("action"), note.alias("note"))
    return judging.folded(judging.changes(requests)).select("id", "status", "note", F.size("history").cast("long").alias("changes"))


@query("select o_orderkey as id, n as position, (n - 1) // 25 as page from (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as n from orders)")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    rows = ordered.numbered(o, -F.col("o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return results.pages(rows, 25).select(F.col("o_orderkey").alias("id"), F.col("position").cast("long").alias("position"), "page")


@query("""with g as (select user_id, event_id as o, value, event_type = 'view' as key from events), f as (select user_id, count(*) as n, max(value) as last from g group by 1), k as (select user_id, o - lag(o) over (partition by user_id order by o) as d from g where key)
 select user_id, case when n >= 2 and n / last >= 0.98 then 'pass' else 'fail' end as fps, case when max(d) is null then 'warn' when max(d) - min(d) > 2 then 'fail' when max(d) > 90 then 'warn' else 'pass' end as gop from f left join k using (user_id) where n >= 2 group by user_id, n, last""")
def frame_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    frames = e.select(F.col("user_id").alias("source"), F.col("event_id").alias("ordinal"), F.col("value").alias("pts"), (F.col("event_type") == "view").alias("key_frame"))
    found = checks.frame_checks(frames, target_fps=1.0).filter("name in ('measured fps', 'GOP')")
    wide = found.groupBy(F.col("source").alias("user_id")).agg(F.max(F.when(F.col("name") == "measured fps", F.col("status"))).alias("fps"), F.max(F.when(F.col("name") == "GOP", F.col("status"))).alias("gop"))
    return wide.filter("gop is not null")


@query("""select n_regionkey as id, case when count(*) < 4 then 'few' else '' end as problem from nation group by 1""")
def marker_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("double")
    m = n.select(F.col("n_regionkey").alias("id"), (k * 100).alias("image_x"), (k * k * 37 % 1000).alias("image_y"), k.alias("world_x"), (k * k % 17).alias("world_y"))
    return calibration.geometry(m, ["id"]).select("id", "problem")


@query("select count(*) as n, count(distinct user_id) as users from (select distinct user_id, ts from events)")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.feeds import deduplicated_counts

    return deduplicated_counts(spark, f"{sf_dir}/events.parquet")

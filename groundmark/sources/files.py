"""Readers and writers of the recording side's files: JSON Lines, JSON documents, feeds and names."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import epoch_instant, is_network_source, local_clock, rate, redacted, segment_start, stripped
from ..schemas import ANNOTATION, GAP, MARKER, SEGMENT, SORTIE, Field
from .decode import fix_records, landing_records, tolerant


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines of a fixed schema: unknown keys are ignored, missing ones null, lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, SEGMENT)


def fix_lanes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fixes, rescued) of JSON Lines files: a line must have the keys of a fix and no others."""
    return fix_records(spark.read.text(path).select(F.col("value").alias("text")))


def fixes(spark: SparkSession, path: str) -> DataFrame:
    """The fixes that decode."""
    return fix_lanes(spark, path)[0]


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, ANNOTATION)


def recording_gaps(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, GAP)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def landing_lanes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(landings, rescued) of stores, one JSON document each with an array `landings`; an unreadable document has none.

    Rescued are the records that do not decode, with the reason; see `decode.landing_records`.
    """
    read = spark.read.schema("schema_version int, landings array<string>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return landing_records(read.select(F.explode("landings").alias("text")))


def landings(spark: SparkSession, path: str) -> DataFrame:
    """The landings that decode."""
    return landing_lanes(spark, path)[0]


def settings(spark: SparkSession, path: str, kind: type, default: object = None) -> object:
    """A `Field` or `Rules` from a JSON document: unknown keys go, missing ones have their default; a missing or unreadable
    document, or one with values of another kind, gives the defaults."""
    default = default or kind()
    types = {f.name: {"float": "double", "int": "int", "bool": "boolean", "str": "string"}[str(f.type)] for f in fields(kind)}
    try:
        read = spark.read.option("wholetext", True).text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("text"))
        good, _ = tolerant(read, ", ".join(f"{c} {t}" for c, t in types.items()))
        row = good.first()
        return replace(default, **{c: v for c, v in row.asDict().items() if v is not None}) if row else default
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return default
    except ValueError:  # values that the kind itself refuses
        return default


def save_settings(spark: SparkSession, value: object, path: str) -> None:
    spark.createDataFrame([asdict(value)]).coalesce(1).write.mode("overwrite").json(path)


def manifest_offset_h(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset_h) of session manifests; a session without an offset is taken as UTC."""
    read = spark.read.schema("utc_offset_seconds double").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return read.select(F.input_file_name().alias("path"), (F.coalesce("utc_offset_seconds", F.lit(0.0)) / 3600).alias("offset_h"))


def segment_files(
    spark: SparkSession, path: str, offset_h: float = 0.0, settled_before: dt.datetime | None = None, suffix: str = "*.mp4",
    known: DataFrame | None = None, recording: bool = False,
) -> DataFrame:
    """(name, start_utc, size_bytes, modified_utc) of segment files whose name is an instant; contents are not read.

    Only files last changed before `settled_before` count, where that is given; while `recording`, the last name of all is
    still being written and does not; names in `known` (name) were indexed before.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True)
    if settled_before:
        reader = reader.option("modifiedBefore", settled_before.strftime("%Y-%m-%dT%H:%M:%S"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    every = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True)
    newest = every.load(path).agg(F.max(name).alias("_newest"))  # one row
    found = reader.load(path).select(name.alias("name"), segment_start("path", offset_h).alias("start_utc"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_utc"))
    if recording:
        found = found.join(F.broadcast(newest), F.lit(True)).filter("name <> _newest").drop("_newest")
    if known is not None:
        found = found.join(known.select("name"), "name", "left_anti")
    return found.filter("start_utc is not null")


def digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def live_fixes(pages: DataFrame, text: str = "text", now: str = "now_utc") -> DataFrame:
    """Position fixes from pages of `<m a="..."/>` markers; a marker with too few fields or a bad number is left out.

    A fix's instant is the page's less its age, cut to whole seconds; blank numbers count as 0.
    """
    ordinal = [c for c in ("page_id",) if c in pages.columns]
    marks = pages.select(*ordinal, F.col(now).alias("now"), F.posexplode(F.slice(F.split(text, '<m a="'), 2, 1_000_000_000)).alias("ordinal", "chunk"))
    parts = F.split(F.split_part("chunk", F.lit('"'), F.lit(1)), ",")
    rows = marks.withColumn("p", parts).filter(F.size("p") >= 14)
    number = lambda k: F.when(F.trim(F.col("p")[k]) == "", 0.0).otherwise(F.col("p")[k].try_cast("double"))
    word = lambda k: stripped(F.col("p")[k])
    strict = lambda k: F.col("p")[k].try_cast("double")
    found = rows.select(
        *ordinal, "ordinal", F.timestamp_seconds(F.floor(F.unix_micros("now") / 1e6 - number(6))).alias("utc"), word(13).alias("flarm_id"), word(3).alias("registration"),
        F.regexp_replace(word(2), "^_+", "").alias("competition_number"), strict(0).alias("lat"), strict(1).alias("lon"), number(4).alias("alt_m"),
        number(7).alias("track_deg"), number(8).alias("speed_kmh"), number(9).alias("climb_ms"), number(10).cast("int").alias("aircraft_type"), word(11).alias("receiver"),
    )
    return found.dropna(subset=["utc", "lat", "lon", "alt_m", "track_deg", "speed_kmh", "climb_ms", "aircraft_type"])


LOGBOOK = (
    "sorties array<struct<cs:string,cn:string,actype:string,date:string,date_tkof:string,date_ldg:string,"
    "tkof:struct<time:string,loc:string>,ldg:struct<time:string,loc:string>>>"
)


def logbook(documents: DataFrame, offset_h: float, text: str = "text") -> DataFrame:
    """Sorties of nested logbook documents; masked or unreadable times are null, dashes around a number go."""
    rows = documents.select(F.posexplode(F.from_json(text, LOGBOOK)["sorties"]).alias("ordinal", "s"))
    time = lambda k: local_clock(F.coalesce(F.col(f"s.date_{k}"), F.col("s.date")), F.col(f"s.{k}.time"), offset_h)
    word = lambda c: F.coalesce(stripped(f"s.{c}"), F.lit(""))
    return rows.select(
        "ordinal", word("cs").alias("registration"), F.regexp_replace(word("cn"), "^-+|-+$", "").alias("competition_number"), word("actype").alias("aircraft_type"),
        time("tkof").alias("takeoff_utc"), time("ldg").alias("landing_utc"), F.coalesce("s.ldg.loc", F.lit("")).alias("landing_place"),
        F.create_map(F.lit("flarm_id"), F.lit("")).alias("raw"),
    )


FLIGHTBOOK = (
    "code string, airfield struct<code:string,name:string,latlng:array<double>,elevation:double,time_info:struct<tz_offset:string>>, "
    "devices array<struct<registration:string,competition:string,aircraft:string,address:string>>, "
    "flights array<struct<device:int,start_tsp:long,stop_tsp:long,towing:boolean>>"
)


def flightbook(documents: DataFrame, text: str = "text") -> DataFrame:
    """Sorties of flight-book documents: flights with the device at their position in the list.

    A missing position, and a negative one, count from the end of the list, so a flight without one has the last device;
    a position past the end has none.
    """
    doc = documents.select(F.from_json(text, FLIGHTBOOK).alias("d"))
    place = F.coalesce("d.airfield.code", "d.code", F.lit(""))
    rows = doc.select(place.alias("place"), F.col("d.devices").alias("devices"), F.posexplode("d.flights").alias("ordinal", "f"))
    k = F.coalesce("f.device", F.lit(-1))
    device = F.get("devices", F.when(k < 0, F.size("devices") + k).otherwise(k))
    rows = rows.withColumn("dev", device)
    word = lambda c: F.coalesce(stripped(F.col(f"dev.{c}")), F.lit(""))
    towing = F.coalesce("f.towing", F.lit(False))
    return rows.select(
        "ordinal", word("registration").alias("registration"), word("competition").alias("competition_number"),
        F.concat(word("aircraft"), F.when(towing, " (tug)").otherwise("")).alias("aircraft_type"), epoch_instant("f.start_tsp").alias("takeoff_utc"),
        epoch_instant("f.stop_tsp").alias("landing_utc"), F.col("place").alias("landing_place"),
        F.create_map(F.lit("flarm_id"), F.coalesce("dev.address", F.lit("")), F.lit("towing"), towing.cast("string")).alias("raw"),
    )


def first_with_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of `first`, or those of `second` if it has none."""
    none = first.agg(F.count("*").alias("_n")).filter("_n = 0")
    return first.unionByName(second.join(F.broadcast(none), F.lit(True), "left_semi"))


def airfields(documents: DataFrame, previous: Field = Field(), text: str = "text") -> DataFrame:
    """Airfield settings of flight-book documents that have a code and two coordinates; the rest carries over."""
    a = documents.select(F.from_json(text, FLIGHTBOOK)["airfield"].alias("a")).filter("coalesce(a.code, '') <> '' and size(a.latlng) = 2")
    zone = F.regexp_extract(F.coalesce("a.time_info.tz_offset", F.lit("")), r"([+-])(\d\d)(\d\d)$", 0)
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    hours = sign * (F.substring(zone, 2, 2).try_cast("int") + F.substring(zone, 4, 2).try_cast("int") / 60)
    return a.select(
        F.upper("a.code").alias("airfield"), F.coalesce("a.name", F.lit("")).alias("name"), F.col("a.latlng")[0].alias("lat"), F.col("a.latlng")[1].alias("lon"),
        F.coalesce("a.elevation", F.lit(0.0)).alias("elevation_m"), F.lit(previous.radius_km).alias("radius_km"), F.lit(previous.enabled).alias("enabled"),
        F.when(zone != "", hours).otherwise(F.lit(previous.timezone_offset_h)).alias("timezone_offset_h"),
    )


PROBE = (
    "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,pix_fmt:string,r_frame_rate:string,avg_frame_rate:string,"
    "bit_rate:string,nb_frames:string,duration:string>>, format struct<bit_rate:string,duration:string>"
)


def probes(documents: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """The first video stream of each probe document; rate, length and count fall back, and 0 counts as missing."""
    d = documents.select(source, F.from_json(text, PROBE).alias("d"))
    d = d.withColumn("s", F.get(F.filter("d.streams", lambda x: x["codec_type"] == "video"), 0)).filter("s is not null")
    number = lambda c, t: F.nullif(F.col(c).try_cast(t), F.lit(0).cast(t))
    return d.select(
        source, F.col("s.width").alias("width"), F.col("s.height").alias("height"), F.col("s.codec_name").alias("codec"), F.col("s.pix_fmt").alias("pix_fmt"),
        F.coalesce(rate("s.r_frame_rate"), rate("s.avg_frame_rate")).alias("fps"), F.coalesce(number("s.bit_rate", "long"), number("d.format.bit_rate", "long")).alias("bit_rate"),
        number("s.nb_frames", "int").alias("nb_frames"), F.coalesce(number("s.duration", "double"), number("d.format.duration", "double")).alias("duration_s"),
    )


def frame_times(documents: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, ordinal, pts, key_frame) of each frame of probe documents; an unreadable time is null."""
    kind = "frames array<struct<pts_time:string,best_effort_timestamp_time:string,key_frame:int>>"
    rows = documents.select(source, F.posexplode(F.from_json(text, kind)["frames"]).alias("ordinal", "f"))
    pts = F.coalesce("f.pts_time", "f.best_effort_timestamp_time").try_cast("double")
    return rows.select(source, "ordinal", pts.alias("pts"), (F.coalesce("f.key_frame", F.lit(0)) == 1).alias("key_frame"))


def progress(lines: DataFrame, by: list[str], ordinal: str = "ordinal", text: str = "value") -> DataFrame:
    """(by, key, value): the last value of each key of `key=value` lines; a value is all behind the first `=`."""
    pair = lines.filter(F.col(text).contains("=")).select(*by, ordinal, stripped(F.split_part(text, F.lit("="), F.lit(1))).alias("key"), stripped(F.expr(f"substr({text}, instr({text}, '=') + 1)")).alias("value"))
    return pair.groupBy(*by, "key").agg(F.max_by("value", ordinal).alias("value"))


def written(spark: SparkSession, path: str) -> DataFrame:
    """(folder, files, bytes) of what lies under `path`, newest name first; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc("folder"))


CALIBRATION = (
    f"matrix array<array<double>>, inverse array<array<double>>, markers array<struct<{MARKER.replace(' ', ':').replace(',:', ',')}>>, residual_m double, "
    "worst_m double, per_marker_m array<double>, image_size array<int>, source string, created_utc timestamp, notes string"
)


def calibrations(spark: SparkSession, path: str) -> DataFrame:
    """Calibration documents; the two keys that follow from the others are not read, and a document without a matrix is none."""
    read = spark.read.schema(CALIBRATION).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return read.filter("matrix is not null")


def write_calibrations(found: DataFrame, path: str, target_m: float = 0.10) -> None:
    """One document a line, with whether the residual is within the target, and the target."""
    found.withColumns({"acceptable": F.col("residual_m") <= target_m, "target_residual_m": F.lit(target_m)}).write.mode("overwrite").json(path)


def save_sorties(sorties: DataFrame, path: str, fetched_utc: dt.datetime) -> None:
    """A logbook's sorties as they were fetched, in place of those saved before."""
    sorties.withColumn("fetched_utc", F.lit(fetched_utc)).write.mode("overwrite").json(path)


def saved_sorties(spark: SparkSession, path: str) -> DataFrame:
    """The saved sorties; none where nothing was saved, and lines that are no JSON are left out."""
    try:
        return json_lines(spark, path, SORTIE)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SORTIE)


def write_manifests(sessions: DataFrame, path: str, schema_version: int = 1) -> None:
    """The facts of sessions, one document a line: credentials go from the source, and the offset defaults to UTC."""
    facts = sessions.withColumns({
        "schema_version": F.lit(schema_version), "source": redacted("source"), "utc_offset_seconds": F.coalesce("utc_offset_seconds", F.lit(0)).cast("int"),
        "rtsp_transport": F.when(is_network_source("source"), F.col("rtsp_transport")),
    })
    facts.write.mode("overwrite").json(path)


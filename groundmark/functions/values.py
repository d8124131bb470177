"""Column expressions of single rows: scores, texts, distances, probabilities, projections, times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import AIRBORNE, DEPARTURE, KINDS, LONG, MEASURED, ON_GROUND, SHORT, UNSEEN, Field, Rules

EARTH_M = 6_371_000.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(text: Column | str) -> Column:
    """`text` without white space of any kind at either end."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(_c(text), F.lit(""))


def scored_offset(confirmed: Column | str, measured: Column | str) -> Column:
    return F.coalesce(_c(confirmed), _c(measured))


def kind(outcome: Column | str) -> Column:
    found = F.lit("pass")
    for name, value in KINDS.items():
        found = F.when(_c(outcome) == name, value).otherwise(found)
    return found


def rounded(x: Column | str, decimals: int) -> Column:
    """Half-even rounding of the double itself, not of its printed decimal (0.15 lies below its print, so it gives 0.1).

    The scaled value is a rounded product, which can only mislead where it is a half exactly: there the factor is split into
    two parts whose products are exact, and what they leave of the half decides.
    """
    x, scale = _c(x).cast("double"), float(10**decimals)
    if decimals == 0:
        return F.bround(x, 0)
    wide = x * 134217729.0  # 2**27 + 1: cuts a double into two of 26 bits
    high = wide - (wide - x)
    scaled = x * scale
    floor = F.floor(scaled).cast("double")
    beyond = (high * scale - (floor + 0.5)) + (x - high) * scale
    even = floor + F.abs(floor % 2)
    half = F.when(beyond > 0, floor + 1).when(beyond < 0, floor).otherwise(even)
    small = F.abs(x) < 1e14 / scale  # larger ones have no such decimals, or are no numbers
    return F.when(small, F.when(scaled == floor + 0.5, half).otherwise(F.bround(scaled, 0)) / scale).otherwise(x)


def unrounded_score(offset: Column | str, outcome: Column | str, rules: Rules = Rules()) -> Column:
    """Points of a landing before rounding; null for what is not scored. Zero offset counts as beyond the line."""
    x = _c(offset)
    rate = F.when(x < 0, F.lit(rules.short_per_m)).otherwise(F.lit(rules.long_per_m))
    points = F.greatest(F.lit(float(rules.min_points)), F.lit(float(rules.max_points)) - rate * F.abs(x))
    return F.when(_c(outcome).isin(SHORT, LONG), F.lit(float(rules.out_of_range_points))).when((_c(outcome) == MEASURED) & x.isNotNull(), points)


def score(offset: Column | str, outcome: Column | str, rules: Rules = Rules()) -> Column:
    return rounded(unrounded_score(offset, outcome, rules), rules.decimals)


def signed(x: Column | str, decimals: int) -> Column:
    """`x` with its sign and so many decimals; a negative number that rounds to zero keeps its minus."""
    size = F.format_string(f"%.{decimals}f", F.abs(rounded(x, decimals)))
    return F.when(_c(x).isNotNull(), F.concat(F.when(_c(x) < 0, "-").otherwise("+"), size))


def label(outcome: Column | str, offset: Column | str, bound: Column | str) -> Column:
    o = _c(outcome)
    return (
        F.when((o == MEASURED) & _c(offset).isNotNull(), F.concat(signed(offset, 1), F.lit(" m")))
        .when((o == SHORT) & _c(bound).isNotNull(), F.concat(F.lit("< "), signed(bound, 0), F.lit(" m")))
        .when((o == LONG) & _c(bound).isNotNull(), F.concat(F.lit("> "), signed(bound, 0), F.lit(" m")))
        .when(o == ON_GROUND, "rolling")
        .when(o == DEPARTURE, "take-off")
        .when(o == AIRBORNE, "fly-through")
        .when(o == UNSEEN, "pick frame")
        .otherwise("?")
    )


def offset_text(outcome: Column | str, offset: Column | str, label_: Column | str) -> Column:
    measured = (_c(outcome) == MEASURED) & _c(offset).isNotNull()
    return F.when(measured, F.concat(signed(offset, 1), F.lit(" m"))).otherwise(F.coalesce(_c(label_), F.lit("")))


def points_text(score_: Column | str, rules: Rules = Rules()) -> Column:
    return F.when(_c(score_).isNull(), "-").otherwise(F.format_string(f"%.{rules.decimals}f", _c(score_)))


def rules_text(rules: Rules) -> str:
    """The rules in one line, numbers without needless digits."""
    g = lambda v: f"{v:g}"
    return f"{rules.name or 'scoring'}: {g(rules.max_points)} pts on the line, -{g(rules.short_per_m)}/m short, -{g(rules.long_per_m)}/m long, floor {g(rules.min_points)}, outside the window {g(rules.out_of_range_points)}"


def wait_text(outcome: Column | str) -> Column:
    return F.when(_c(outcome) == UNSEEN, "judge picks frame").otherwise("being verified")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def fix_probability(best: Column | str, runner_up: Column | str) -> Column:
    """How sure the best fix is: less with its own score, and less the closer the runner-up comes."""
    b, r = _c(best), _c(runner_up)
    alone = F.greatest(F.lit(0.05), 1 - b / 2)
    beside = F.least(F.lit(1.0), (r - b) / F.greatest(r, F.lit(1e-6)) + 0.5)
    return rounded(alone * F.when(r.isNull(), 1.0).otherwise(beside), 2)


def logbook_probability(dt: Column | str, runner_up: Column | str, window_s: float = 240.0, close_s: float = 60.0) -> Column:
    """How sure the nearest event is; `dt` and `runner_up` are distances in seconds."""
    d, r = F.abs(_c(dt)), _c(runner_up)
    beside = F.when(r.isNull(), 1.0).when(r - d < close_s, 0.5).otherwise(0.8)
    return rounded(F.greatest(F.lit(0.05), 1 - d / window_s) * beside, 2)


def uncertainty_m(speed: Column, sigma_t: Column, rms_x: Column, n_x: Column, residual_m: Column | float, fps: Column | float) -> Column:
    floor = F.greatest(sigma_t, F.lit(0.25) / fps)
    return F.sqrt(F.pow(F.abs(speed) * floor, 2.0) + F.pow(rms_x / F.sqrt(n_x), 2.0) + F.pow(F.lit(residual_m) if isinstance(residual_m, float) else residual_m, 2.0))


def project(x: Column | str, y: Column | str, matrix: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """A point through a plane projection; NaN where the point goes to infinity."""
    rows = [F.lit(float(a)) * _c(x) + F.lit(float(b)) * _c(y) + F.lit(float(c)) for a, b, c in matrix]
    far = F.abs(rows[2]) < 1e-12
    return tuple(F.when(far, F.lit(float("nan"))).otherwise(r / rows[2]) for r in rows[:2])


def finite(*columns: Column | str) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & _c(c).isNotNull() & ~F.isnan(_c(c)) & (F.abs(_c(c)) < float("inf"))
    return found


def in_window(x: Column | str, half_m: float = 19.4) -> Column:
    return F.abs(_c(x)) <= half_m


def redacted(url: Column | str) -> Column:
    """A URL without the user and password in it."""
    return F.regexp_replace(_c(url), r"//[^/@\s]*@", "//***@")


def is_network_source(url: Column | str) -> Column:
    return _c(url).rlike(r"^(rtsp|rtsps|http|https|udp|tcp|rtmp|srt)://")


def clip_name(registration: Column | str, number: Column | str) -> Column:
    """A file-name stem from a registration, else a numbered placeholder."""
    safe = F.regexp_replace(F.upper(stripped(registration)), r"[^A-Z0-9_-]", "")
    return F.coalesce(blank_to_null(safe), F.format_string("UNKNOWN-%03d", _c(number).cast("int")))


def clip_window(instant: Column | str, before_s: int = 3, after_s: int = 5) -> tuple[Column, Column]:
    return _c(instant) - F.make_dt_interval(secs=F.lit(before_s)), _c(instant) + F.make_dt_interval(secs=F.lit(after_s))


def segment_start(name: Column | str, offset_h: Column | str | float = 0.0) -> Column:
    """The instant in a segment's file name, local to the offset, as UTC; null if it is none."""
    stem = F.regexp_extract(_c(name), r"(\d{4}-\d\d-\d\d_\d\d-\d\d-\d\d)\.\w+$", 1)
    offset = _c(offset_h) if isinstance(offset_h, (str, Column)) else F.lit(offset_h)
    return seconds_later(F.try_to_timestamp(stem, F.lit("yyyy-MM-dd_HH-mm-ss")), -3600 * offset)


def seconds_later(instant: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(instant) + F.round(seconds * 1e6).cast("long"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def frame_instant(start: Column | str, frame: Column | str, fps: Column | str) -> Column:
    return seconds_later(_c(start), _c(frame) / _c(fps))


def local_clock(day: Column | str, clock: Column | str, offset_h: float) -> Column:
    """`HH:mm` of a day, local to the offset, as UTC; null if blank, masked with an X or unreadable."""
    masked = F.upper(_c(clock)).contains("X")
    found = F.try_to_timestamp(F.concat_ws(" ", _c(day), _c(clock)), F.lit("yyyy-MM-dd HH:mm"))
    return seconds_later(F.when(masked, F.lit(None)).otherwise(found), F.lit(-3600.0 * offset_h))


def epoch_instant(seconds: Column | str) -> Column:
    """Epoch seconds as an instant; null and 0 are none."""
    return F.timestamp_seconds(F.nullif(_c(seconds), F.lit(0)))


def bounding_box(field: Field) -> tuple[Column, Column, Column, Column]:
    """North, south, east and west of the field's surroundings."""
    d = F.lit(field.radius_km / 111.0)
    wide = d / F.greatest(F.lit(0.1), F.cos(F.radians(F.lit(field.lat))))
    return F.lit(field.lat) + d, F.lit(field.lat) - d, F.lit(field.lon) + wide, F.lit(field.lon) - wide


def rate(text: Column | str) -> Column:
    """`60/1` or `29.97` as a number; null if unreadable, zero or over zero."""
    parts = F.split(_c(text), "/")
    top, low = F.get(parts, 0).try_cast("double"), F.when(F.size(parts) > 1, F.get(parts, 1).try_cast("double")).otherwise(1.0)
    return F.nullif(F.try_divide(top, low), F.lit(0.0))


def elapsed_text(seconds: Column | str) -> Column:
    s = F.floor(_c(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def site_geometry(distance: Column, mast: Column, fps: Column, hfov: Column, width_px: int = 1920, height_px: int = 1080, vfov: float = 17.0, speed: float = 25.0) -> dict[str, Column]:
    """What a camera place gives: covered width, scale, elevation angle, depth of a pixel, travel between frames."""
    width = 2 * distance * F.tan(F.radians(hfov) / 2)
    elevation = F.degrees(F.atan(mast / distance))
    depth = F.radians(F.lit(vfov)) / height_px * distance / F.sin(F.radians(elevation))
    return {
        "covered_m": width, "px_per_m": width_px / width, "elevation_deg": elevation, "depth_m_per_px": depth,
        "edge_error_m": depth * (width / 2) / distance, "travel_m_per_frame": speed / fps,
    }

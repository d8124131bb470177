"""Column types of the input tables, and the settings that operators take as parameters."""

from __future__ import annotations

from dataclasses import dataclass

TRACK_POINT = (
    "segment string, frame int, t double, u double, v double, world_x double, world_y double, clipped boolean, "
    "gap_px double, reach_px double, tyre_seen boolean"
)
LANDING = (
    "id string, session string, created_utc timestamp, kind string, outcome string, status string, "
    "touchdown_utc timestamp, segment string, frame int, subframe double, fps double, direction int, "
    "longitudinal_m double, lateral_m double, uncertainty_m double, bound_m double, speed_mps double, image_x double, "
    "image_y double, method string, flags array<string>, "
    f"track array<struct<{TRACK_POINT.replace(' ', ':').replace(',:', ',')}>>, first_utc timestamp, last_utc timestamp, "
    "registration string, competition_number string, aircraft_type string, identified_by string, pilot string, "
    "clip_path string, overlay_path string, confirmed_utc timestamp, confirmed_longitudinal_m double, "
    "confirmed_frame int, note string"
)
SEGMENT = "name string, start_utc timestamp, duration_s double, nb_frames int, fps double, size_bytes long, sha256 string"
FIX = (
    "utc timestamp, flarm_id string, registration string, competition_number string, lat double, lon double, "
    "alt_m double, track_deg double, speed_kmh double, climb_ms double, aircraft_type int, receiver string"
)
SORTIE = (
    "registration string, competition_number string, aircraft_type string, takeoff_utc timestamp, landing_utc timestamp, "
    "landing_place string, raw map<string,string>"
)
SAMPLE = "track_id string, index int, t double, world_x double, world_y double, u double, v double, gap_px double, reach_px double"
MARKER = "image_x double, image_y double, world_x double, world_y double, label string"
ANNOTATION = (
    "session string, segment string, frame int, fps double, touchdown_utc timestamp, image_x double, image_y double, "
    "aircraft string, note string, created_utc timestamp, world_x double, world_y double, residual_m double, in_range boolean"
)
GAP = "start_utc timestamp, end_utc timestamp, seconds double"

MEASURED, SHORT, LONG, ON_GROUND = "measured", "short", "long", "on_ground"
DEPARTURE, AIRBORNE, UNSEEN, UNKNOWN = "departure", "airborne", "unseen", "unknown"
PENDING, CONFIRMED, REJECTED = "pending", "confirmed", "rejected"
#: Kinds of the outcomes that are not a mere pass.
KINDS = {MEASURED: "landing", SHORT: "landing", LONG: "landing", UNSEEN: "landing", DEPARTURE: "departure"}


@dataclass(frozen=True)
class Rules:
    """Scoring: points on the line, points lost per metre before and beyond it, floor, and points outside the window."""

    max_points: float = 100.0
    short_per_m: float = 5.0
    long_per_m: float = 2.0
    min_points: float = 0.0
    out_of_range_points: float = 0.0
    decimals: int = 0
    name: str = "Club rules"

    def __post_init__(self):
        if self.max_points <= 0 or self.short_per_m < 0 or self.long_per_m < 0:
            raise ValueError("points must be positive and rates not negative")


@dataclass(frozen=True)
class Field:
    """An airfield; `timezone_offset_h` is that of its logbook's times."""

    airfield: str = ""
    name: str = ""
    lat: float = 0.0
    lon: float = 0.0
    elevation_m: float = 0.0
    radius_km: float = 5.0
    enabled: bool = False
    timezone_offset_h: float = 0.0


@dataclass(frozen=True)
class MatchLimits:
    """Bounds, all inclusive, within which a position fix or a logbook event may belong to a touchdown."""

    fix_window_s: float = 90.0
    radius_m: float = 1500.0
    max_agl_m: float = 150.0
    logbook_window_s: float = 240.0
    close_s: float = 60.0

"""Scalar functions as columns, all within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
WALK_SPEED, MIN_WALK_S = 1.4, 30
UNIX_CUT = 946_684_800
#: Cost factor, in thousandths, by route type; other known types take DEFAULT_FACTOR.
ROUTE_FACTORS = {0: 1100, 1: 1100, 2: 1000, 3: 2000, 4: 1200, 5: 1300, 6: 1200, 7: 2000, 11: 2000, 12: 2000, 100: 1000, 109: 1100, 1000: 1200}
DEFAULT_FACTOR, UNKNOWN_SPEED_FACTOR = 1450, 1500
#: Route types by common names.
ROUTE_NAMES = {
    2: "rail train intercity interregio ic ir rer sbahn s-bahn subway metro", 0: "tram streetcar light_rail light-rail",
    3: "bus coach autobus", 4: "ferry boat", 6: "cable gondola funicular lift",
}
UNKNOWN_TYPE, WALK_CAP_S = -1, 900
#: Least mean speed in m/s and the factor it earns.
SPEED_FACTORS = ((14, 1000), (10, 1150), (7, 1450))
SLOW_FACTOR = 1900


def parse_time_seconds(text: Column) -> Column:
    """Digits, H:MM or H:MM:SS as seconds; null for anything else."""
    text = F.trim(text)
    part = lambda i: F.try_element_at(F.split(text, ":"), F.lit(i)).cast("bigint")
    clock = part(1) * 3600 + part(2) * 60 + F.coalesce(part(3), F.lit(0))
    return F.when(text.rlike(r"^\d+$"), text.cast("bigint")).when(text.rlike(r"^\d+:\d+(:\d+)?$"), clock)


def time_number(value: Column) -> Column:
    """A time given as a number, without its fraction."""
    return value.cast("bigint")


def departure_seconds(value: Column, offset: int = 0) -> Column:
    """Seconds of day; Unix times are taken to seconds of their day, ``offset`` seconds east of UTC."""
    return F.when(F.abs(value) >= UNIX_CUT, F.pmod(value + offset, F.lit(86_400))).otherwise(value)


def departure_text(text: Column, offset: int = 0) -> Column:
    """The same of text: digits, or a date and time whose own clock counts; null for anything else."""
    text = F.trim(text)
    at = text.try_cast("timestamp_ntz")
    clock = (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).cast("bigint")
    return F.when(text.rlike(r"^[+-]?\d+$"), departure_seconds(text.try_cast("bigint"), offset)).when(text.rlike(r"^\d{4}-\d\d-\d\d"), clock)


def route_type(text: Column) -> Column:
    """A route type from a number or a common name; UNKNOWN_TYPE for anything else."""
    text = F.lower(F.trim(text))
    out = F.coalesce(text.try_cast("double").try_cast("int"), F.lit(UNKNOWN_TYPE))
    for kind, names in ROUTE_NAMES.items():
        out = F.when(text.isin(*names.split()), kind).otherwise(out)
    return out


def number_or(text: Column, default: float, kind: str = "double") -> Column:
    """Text as a number, or the default."""
    return F.coalesce(F.trim(text).try_cast(kind), F.lit(default).cast(kind))


def walk_score_penalty(seconds: Column, cap: Column | int = WALK_CAP_S) -> Column:
    """Half of the walking seconds, up to the cap."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    return F.floor(F.least(F.greatest(seconds, F.lit(0)), F.greatest(cap, F.lit(0))) / 2).cast("bigint")


def walking_speed_kmh(meters: Column, seconds: Column) -> Column:
    return F.when((meters > 0) & (seconds > 0), F.round(meters / seconds * 3.6, 2))


def known(x: Column) -> Column:
    """Null in place of NaN."""
    return F.when(~F.isnan(x), x)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def walk_seconds(meters: Column) -> Column:
    return F.greatest(F.lit(MIN_WALK_S), (meters / WALK_SPEED).cast("bigint"))


def station_key(stop_id: Column) -> Column:
    return F.substring_index(F.trim(stop_id), ":", 1)


def normalize_text(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def route_type_factor(route_type: Column) -> Column:
    out = F.lit(DEFAULT_FACTOR)
    for kind, factor in ROUTE_FACTORS.items():
        out = F.when(route_type == kind, factor).otherwise(out)
    return out


def speed_factor(speed: Column) -> Column:
    out = F.lit(SLOW_FACTOR)
    for least, factor in reversed(SPEED_FACTORS):
        out = F.when(speed >= least, factor).otherwise(out)
    return F.when(speed.isNull(), UNKNOWN_SPEED_FACTOR).otherwise(out)

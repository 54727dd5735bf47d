"""Column helpers that all operators share. ANSI mode is assumed: divisions go through ratio()."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
EARTH_KM = 6371.0


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(100 * ratio(a, b), digits)


def bands(value: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """The label of the first threshold that value reaches; thresholds come greatest first. Null gets `otherwise`."""
    out = F.when(value >= steps[0][0], F.lit(steps[0][1]))
    for least, label in steps[1:]:
        out = out.when(value >= least, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def lookup(value: Column, table: dict, otherwise: object) -> Column:
    """table[value], by one CASE, `otherwise` for what is not in it."""
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def seconds(duration: str) -> int:
    """Seconds in '30 minutes', '4 hours', '1 day', ...; ValueError for anything else."""
    m = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day|week)s?\s*", duration)
    if not m:
        raise ValueError(f"not a duration: {duration!r}")
    return int(m[1]) * SECONDS[m[2]]


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as a long, for RANGE frames; also from timestamp_ntz (session zone: UTC)."""
    return ts.cast("timestamp").cast("long")


def iso_week(ts: Column) -> Column:
    """`2024-W01`: the ISO year and week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def period(ts: Column, unit: str) -> Column:
    """The label of the hour, day, week (its Monday), month, quarter or year of ts."""
    if unit == "week":
        return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")
    if unit == "quarter":
        return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))
    formats = {"hour": "yyyy-MM-dd HH", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
    if unit not in formats:
        raise ValueError(f"not a period: {unit!r}")
    return F.date_format(ts, formats[unit])


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.sin(F.radians(b - a) / 2) ** 2
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def is_location_anomaly(lat1: Column, lon1: Column, lat2: Column, lon2: Column, threshold_km: float = 500.0) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) > threshold_km


def bot_agent(agent: Column) -> Column:
    return F.coalesce(F.lower(agent).rlike("bot|crawler|spider|scraper"), F.lit(False))

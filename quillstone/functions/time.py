"""Time rules as Column -> Column functions; the session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_instant(text: Column) -> Column:
    """An RFC 3339 time; more than six decimals are cut, no zone means UTC, anything else is null."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
    cut = F.regexp_replace(F.trim(text), r"(\.\d{6})\d+", "$1")
    zoned = F.when(cut.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.regexp_replace(cut, r"([+-]\d{2})(\d{2})$", "$1:$2")).otherwise(F.concat(cut, F.lit("Z")))
    return F.when(F.trim(text).rlike(shape), F.try_to_timestamp(zoned))


def iso_week(ts: Column) -> Column:
    """2025-W01"""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts))


def local_day(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def local_month(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM")


def seconds_to_midnight(ts: Column, zone: str) -> Column:
    there = F.from_utc_timestamp(ts, zone)
    return (86_400 - (F.hour(there) * 3600 + F.minute(there) * 60 + F.second(there))).cast("long")


def digest_due(ts: Column, zone: str) -> Column:
    """From Monday 10:00 to Wednesday 23:59 local time."""
    there = F.from_utc_timestamp(ts, zone)
    day = F.weekday(there)
    return ((day == 0) & (F.hour(there) >= 10)) | day.isin(1, 2)


def age_text(seconds: Column) -> Column:
    """3d, 5h, 7m or now."""
    s = seconds.cast("long")
    return (
        F.when(s >= 86_400, F.concat(F.floor(s / 86_400).cast("string"), F.lit("d"))).when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))
        .when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).otherwise("now")
    )

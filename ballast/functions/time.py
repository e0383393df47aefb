"""Clock, calendar and service-day column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NETWORK_ZONE = "Europe/Amsterdam"
IRIS_ZONE = "Europe/Berlin"


def epoch_in_zone(local: Column, zone: str) -> Column:
    """Epoch seconds of a zone-less timestamp read as local time of the zone."""
    return F.unix_timestamp(F.to_utc_timestamp(local, zone))


def clock_seconds(col: Column) -> Column:
    """Seconds of day of "HH:MM:SS"; hours may pass 24."""
    part = F.split(F.nullif(col, F.lit("")), ":")
    return (part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("int")).cast("int")


def dep_hour(dep_s: Column) -> Column:
    """Hour of day 0-23; departures past midnight wrap to the early hours."""
    return (F.floor(dep_s / 3600).cast("bigint") % 24).cast("bigint")


def day_type(service_date: Column) -> Column:
    """wd, sat or sun of a yyyyMMdd date."""
    weekday = F.weekday(F.to_date(service_date, "yyyyMMdd"))
    return F.when(weekday == 5, "sat").when(weekday == 6, "sun").otherwise("wd")


def service_day(col: Column) -> Column:
    """Date of a yyyyMMdd string; NULL when it is none."""
    return F.when(col.rlike("^[0-9]{8}"), F.try_to_timestamp(F.substring(col, 1, 8), F.lit("yyyyMMdd"))).cast("date")


def service_day_floor(as_of: Column, hours: int) -> Column:
    """Oldest service date still open at an instant: its UTC date some hours earlier, yyyyMMdd."""
    return F.date_format(F.timestamp_seconds(as_of - hours * 3600), "yyyyMMdd")


def utc_day(ts: Column) -> Column:
    return F.to_date(F.timestamp_seconds(ts))


def iris_epoch(col: Column) -> Column:
    """Epoch seconds of "yyMMddHHmm" German local time; NULL when invalid."""
    local = F.when(col.rlike("^[0-9]{10}$"), F.try_to_timestamp(col, F.lit("yyMMddHHmm")))
    return epoch_in_zone(local, IRIS_ZONE)


def local_minute(ts: Column, zone: str = NETWORK_ZONE) -> Column:
    """"YYYY-MM-DD HH:MM" of an instant in a zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(ts), zone), "yyyy-MM-dd HH:mm")


def iso_epoch(col: Column) -> Column:
    """Epoch seconds of an ISO 8601 time with offset; NULL when invalid."""
    offset_with_colon = F.regexp_replace(col, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return F.unix_timestamp(F.try_to_timestamp(offset_with_colon))


def compact_epoch(col: Column, zone: str = NETWORK_ZONE) -> Column:
    """Epoch seconds of "yyyyMMddTHHmmss" local time; NULL when invalid."""
    return epoch_in_zone(F.try_to_timestamp(col, F.lit("yyyyMMdd'T'HHmmss")), zone)


def latest_end(ends: Column, zone: str = NETWORK_ZONE) -> Column:
    """Local minute of the greatest of the period ends; NULL when that one is invalid or none is set."""
    given = F.filter(ends, lambda e: e.isNotNull() & (e != ""))
    return local_minute(compact_epoch(F.array_max(given), zone), zone)

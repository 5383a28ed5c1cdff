"""Timestamp extraction, parsing and ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom import fixed


def first_ts(text: Column) -> Column:
    """The first timestamp pattern present, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in fixed.TIMESTAMP_PATTERNS])


def without_ts(text: Column, ts: Column) -> Column:
    """The trimmed text without its timestamp; the text as it is where `ts` is null."""
    at = F.position(ts, text)
    rest = F.trim(F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(ts))))
    return F.when(ts.isNull(), text).otherwise(rest)


def extract_ts(text: Column) -> Column:
    """struct(ts_str, rest): first_ts and without_ts. Over many rows make them columns one after the other, as the
    text parser does: here the patterns run again for every use."""
    ts = first_ts(text)
    return F.struct(ts.alias("ts_str"), without_ts(text, ts).alias("rest"))


def parse_ts(text: Column, default_year: int | Column | None = None) -> Column:
    """Timestamp from epoch seconds or milliseconds, Apache, syslog, common log, ISO and US
    forms; null when nothing fits. Times without a zone are UTC (the session zone)."""
    year = default_year if isinstance(default_year, Column) else (
        F.lit(default_year) if default_year is not None else F.year(F.current_date()))
    t = F.trim(text)

    def part(pattern):
        return F.nullif(F.regexp_extract(t, pattern, 0), F.lit(""))

    def read(value, fmt):
        return F.try_to_timestamp(value, F.lit(fmt))

    seconds = F.when(t.rlike(fixed.TIMESTAMP_PATTERNS[3]), t.try_cast("double"))
    millis = F.when(t.rlike(fixed.TIMESTAMP_PATTERNS[4]), t.try_cast("bigint"))
    apache = F.regexp_replace(part(fixed.TIMESTAMP_PATTERNS[1]), r"[\[\]]", "")
    syslog = F.concat_ws(" ", year.cast("string"), F.regexp_replace(part(fixed.TIMESTAMP_PATTERNS[2]), r"\s+", " "))

    def zoned(value):
        return F.regexp_replace(value, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")

    # a text that is an ISO time as a whole fits no other form
    return F.when(t.rlike(rf"^(?:{fixed.TIMESTAMP_PATTERNS[0]})\z"), zoned(t)).otherwise(F.coalesce(
        F.timestamp_seconds(seconds),
        F.timestamp_millis(millis),
        read(apache, "dd/MMM/yyyy:HH:mm:ss Z"),
        F.when(part(fixed.TIMESTAMP_PATTERNS[2]).isNotNull(), read(syslog, "yyyy MMM d HH:mm:ss")),
        read(part(fixed.TIMESTAMP_PATTERNS[5]), "dd/MMM/yyyy:HH:mm:ss"),
        zoned(part(fixed.TIMESTAMP_PATTERNS[0])),
        read(part(fixed.TIMESTAMP_PATTERNS[7]), "MM/dd/yyyy HH:mm:ss"),
    ))


def to_utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


RANGE_PRESETS = {"1h": 1, "6h": 6, "24h": 24, "7d": 24 * 7, "30d": 24 * 30}


def time_range(ts: Column, preset: str, now: dt.datetime) -> Column:
    """Predicate for a relative range that ends at `now`, inclusive both ends; `all` keeps every
    row and an unknown preset means 24h."""
    if preset == "all":
        return F.lit(True)
    start = now - dt.timedelta(hours=RANGE_PRESETS.get(preset, 24))
    return ts.between(F.lit(start).cast("timestamp"), F.lit(now).cast("timestamp"))

"""Timestamps, durations, numbers as text, and local-time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agorametrics.vocab import DISPLAY_TZ

_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
_ISO = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
)
_MONTH_FIRST = r"^\d{1,2}/\d{1,2}/\d{4}( \d{1,2}:\d{2}(:\d{2})?)?$"
_NUMBER = r"^[ \t\r\n]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\r\n]*$"

GRANULARITIES = {
    # label pattern and step of one bucket
    "hour": ("yyyy-MM-dd HH:00", "interval 1 hour"),
    "day": ("yyyy-MM-dd", "interval 1 day"),
    "week": ("yyyy-MM-dd", "interval 7 days"),
    "month": ("yyyy-MM", "interval 1 month"),
}


def parse_iso_dt(text: Column) -> Column:
    """ISO 8601 text to a UTC timestamp; ``Z``, ``+00:00`` and ``+0000`` honoured, no offset is
    UTC, anything else null. Needs the session time zone UTC."""
    text = F.trim(text)
    with_colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(_ISO), with_colon.try_cast("timestamp"))


def parse_timestamp_local(text: Column, tz: str = DISPLAY_TZ) -> Column:
    """Export timestamp to UTC: wall-clock time without an offset is local to ``tz``."""
    text = F.trim(text)
    parsed = F.coalesce(
        parse_iso_dt(text),
        F.when(
            text.rlike(_MONTH_FIRST),
            F.coalesce(
                F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm:ss")),
                F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm")),
                F.try_to_timestamp(text, F.lit("M/d/yyyy")),
            ),
        ),
    )
    return F.when(text.rlike(r"\d{2}:\d{2}.*" + _OFFSET), parsed).otherwise(
        F.to_utc_timestamp(parsed, tz)
    )


def to_int(text: Column) -> Column:
    """Whole number from text, fractions cut towards zero, anything else null."""
    text = text.cast("string")
    whole = F.trim(text)
    return F.when(
        text.rlike(_NUMBER),
        F.coalesce(whole.try_cast("bigint"), whole.try_cast("double").try_cast("bigint")),
    )


def iso_duration_seconds(text: Column) -> Column:
    """Seconds of ``PT#H#M#S``; null when no part is given."""
    pattern = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, i).try_cast("bigint"), F.lit(0))

    return F.when(
        text.rlike(pattern) & text.rlike(r"\d"), part(1) * 3600 + part(2) * 60 + part(3)
    )


def local_time(ts: Column, tz: str = DISPLAY_TZ) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_dow(ts: Column, tz: str = DISPLAY_TZ) -> Column:
    """0 is Monday."""
    return F.weekday(local_time(ts, tz)).cast("bigint")


def local_hour(ts: Column, tz: str = DISPLAY_TZ) -> Column:
    return F.hour(local_time(ts, tz)).cast("bigint")


def bucket(ts: Column, granularity: str, tz: str = DISPLAY_TZ) -> Column:
    """Start of the local-time bucket; weeks start on Monday."""
    _check(granularity)
    return F.date_trunc(granularity, local_time(ts, tz))


def bucket_label(start: Column, granularity: str) -> Column:
    _check(granularity)
    return F.date_format(start, GRANULARITIES[granularity][0])


def step(granularity: str) -> Column:
    _check(granularity)
    return F.expr(GRANULARITIES[granularity][1])


def _check(granularity: str) -> None:
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity!r}: use one of {list(GRANULARITIES)}")

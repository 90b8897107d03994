"""Time expressions: timestamp parsing, epoch milliseconds, buckets, lag, durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtables.functions.text import strip

# The accepted shapes. With a T: optional dot fraction, optional
# zone. With a blank: optional dot or comma fraction, no zone. No zone means UTC.
_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
ZONED_SHAPE = rf"^{_DAY}[Tt]{_CLOCK}(?:\.\d{{1,6}})?(?:Z|[+-]\d{{2}}:?\d{{2}})$"
T_SHAPE = rf"^{_DAY}[Tt]{_CLOCK}(?:\.\d{{1,6}})?$"
BLANK_SHAPE = rf"^{_DAY}\s+{_CLOCK}(?:[.,]\d{{1,6}})?$"

DURATION_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def parse_timestamp(value: Column, trimmed: bool = False) -> Column:
    """Timestamp of a log time string, NULL if it has none of the accepted shapes."""
    text = value if trimmed else strip(value)
    blank_as_t = F.regexp_replace(F.translate(text, ",", "."), r"\s+", "T")
    text = F.translate(text, "t", "T")
    return (
        F.when(text.rlike(ZONED_SHAPE), text)
        .when(text.rlike(T_SHAPE), F.concat(text, F.lit("Z")))
        .when(text.rlike(BLANK_SHAPE), F.concat(blank_as_t, F.lit("Z")))
    ).try_cast("timestamp")


# Day, and any one character, hour, minute, second, fraction and zone after it.
_ISO = (
    r"^(\d{4}-\d{2}-\d{2})(?:.(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
    r"(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)


def parse_iso(value: Column) -> Column:
    """Timestamp of an ISO day or time; without a zone it is UTC, NULL in any other shape."""
    day, hour, minute, second, fraction, zone = (
        F.nullif(F.regexp_extract(value, _ISO, i), F.lit("")) for i in range(1, 7)
    )
    zero = F.lit("00")
    clock = F.concat_ws(":", *(F.coalesce(x, zero) for x in (hour, minute, second)))
    whole = F.concat(
        day, F.lit("T"), clock, F.lit("."), F.coalesce(fraction, F.lit("0")), F.coalesce(zone, F.lit("Z"))
    )
    return F.when(value.rlike(_ISO), whole).try_cast("timestamp")


def utc(ts: Column) -> Column:
    """Time shifted so that its clock reads UTC, whatever zone the session is in."""
    return F.to_utc_timestamp(ts, F.current_timezone())


def utc_date(ts: Column) -> Column:
    """Calendar date in UTC."""
    return F.to_date(utc(ts))


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds since the epoch, rounded down."""
    return F.unix_millis(ts)


def from_epoch_ms(ms: Column) -> Column:
    """Timestamp of whole milliseconds since the epoch."""
    return F.timestamp_millis(ms)


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start, in epoch milliseconds, of the time bucket holding ``ts``."""
    ms = epoch_ms(ts)
    return ms - F.pmod(ms, F.lit(seconds * 1000))


def ingest_lag_ms(ts: Column, ingest_ts: Column) -> Column:
    """Milliseconds from event time to ingest time; 0 if negative or unknown."""
    lag = (F.unix_micros(ingest_ts) - F.unix_micros(ts)) / 1000.0
    return F.greatest(F.lit(0.0), F.coalesce(lag, F.lit(0.0)))


def duration_seconds(value: str | int) -> int:
    """Seconds of ``90``, ``'30s'``, ``'5m'``, ``'2h'`` or ``'1d'``; else ValueError."""
    if isinstance(value, int):
        return value
    found = re.fullmatch(r"([0-9]+)([smhd])", value)
    if not found:
        raise ValueError(f"not a duration: {value!r}; write a number and one of s, m, h, d")
    return int(found[1]) * DURATION_SECONDS[found[2]]

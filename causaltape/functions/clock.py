"""Nanosecond clocks as long integers: buckets, conversions and text parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_S, NS_PER_MS = 1_000_000_000, 1_000_000
#: Seconds of each timeframe name.
TIMEFRAMES = {"15s": 15, "30s": 30, "1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}


def floor_bucket(t: Column, width: int | Column) -> Column:
    """The start of the bucket of `width` that holds t, for negative t too."""
    return t - F.pmod(t, F.lit(width) if isinstance(width, int) else width)


def ms_to_ns(ms: Column) -> Column:
    """Milliseconds as nanoseconds; null where the product leaves 64 bits."""
    return F.try_multiply(ms.cast("long"), F.lit(NS_PER_MS).cast("long"))


def ns_to_ms(ns: Column) -> Column:
    """Whole milliseconds at or before a nanosecond time."""
    return floor_div(ns, NS_PER_MS)


def floor_div(t: Column, width: int) -> Column:
    """Floor division of long integers, exact to the last digit."""
    return F.call_function("div", t - F.pmod(t, F.lit(width).cast("long")), F.lit(width).cast("long"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's time zone does to zone-less ones."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


RFC3339 = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(?:[Zz]|([+-])(\d{2}):(\d{2}))$"


def rfc3339_ns(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 time; null for bad dates, fractions beyond nine digits and offsets of
    24 hours or more."""
    part = lambda k: F.regexp_extract(text, RFC3339, k)
    stamp = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit(" +0000")), F.lit("yyyy-MM-dd HH:mm:ss Z"))
    hours, minutes = part(5).try_cast("int"), part(6).try_cast("int")
    offset = F.when(part(4) == "", F.lit(0)).when((hours < 24) & (minutes < 60), (hours * 3600 + minutes * 60) * F.when(part(4) == "-", -1).otherwise(1))
    nanos = F.rpad(part(3), 9, "0").try_cast("long")
    fraction = F.when(part(3) == "", F.lit(0).cast("long")).otherwise(nanos)
    return F.when(text.rlike(RFC3339), (F.unix_seconds(stamp) - offset) * NS_PER_S + fraction)

"""Column expressions over time stamps without zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def boundary_number(ts: Column, seconds: int) -> Column:
    """Number of the fixed-width bucket a time stamp lies in; differences count boundaries."""
    width = F.lit(seconds * 1_000_000)
    at = micros(ts)
    return ((at - F.pmod(at, width)) / width).cast("bigint")


def bucket(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def iso_text(ts: Column) -> Column:
    """2020-01-31T08:00:00, with .ffffff only where microseconds are present."""
    fraction = F.date_format(ts, "SSSSSS")
    head = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(fraction == "000000", head).otherwise(F.concat(head, F.lit("."), fraction))

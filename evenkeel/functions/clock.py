"""Instants as whole microseconds, so spans are plain integer arithmetic."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICRO = 1
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 for a timestamp column with or without zone."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(F.col(name))
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", epoch, F.col(name).cast("timestamp_ntz"))


def from_micros(df: DataFrame, name: str, us: Column) -> Column:
    """The instant ``us`` in the type of column ``name``."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.timestamp_micros(us)
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_add("MICROSECOND", us, epoch)


def span(us: int) -> Column:
    """A literal day-time interval of ``us`` microseconds."""
    return F.lit(timedelta(microseconds=us))


def elapsed(start: Column, end: Column, unit: int) -> Column:
    """Time from ``start`` to ``end`` in multiples of ``unit``, as a double."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(unit)

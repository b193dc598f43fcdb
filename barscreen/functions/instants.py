"""Timestamp helpers that keep the column's own type.

Parquet columns without a zone arrive as TIMESTAMP_NTZ, epoch seconds become TIMESTAMP. Literals are
built in the type of the column they are compared with, so that the comparison needs no cast on the
column side and reaches the Parquet reader as a pushed filter.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Instant = datetime | str


def instant(value: Instant, like: T.DataType | None = None) -> Column:
    """A point in time as a literal of the given timestamp type (TIMESTAMP by default)."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast(like or T.TimestampType())


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def bucket_start(df: DataFrame, ts: str, minutes: int, offset_minutes: int = 0) -> Column:
    """Start of the bar that `ts` falls into, in the type of `ts`.

    Bars of every length are counted from 1970-01-01 00:00 of the wall clock (the session's zone for
    TIMESTAMP), shifted by `offset_minutes`, in batches and streams alike; so days begin at midnight
    and shorter bars nest in longer ones. The hour that a clock goes through twice is one hour.
    """
    kind = column_type(df, ts)
    if minutes == 1440 and offset_minutes == 0:
        return F.to_date(F.col(ts)).cast(kind)
    t = F.col(ts)
    passed = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")) * 1440 + F.hour(t) * 60 + F.minute(t)
    begun = F.floor((passed - offset_minutes) / minutes) * minutes + offset_minutes
    epoch = F.lit("1970-01-01 00:00:00").cast(T.TimestampNTZType())
    return (epoch + F.make_dt_interval(mins=begun.cast("int"))).cast(kind)


def check_nesting(fine: int, coarse: int, fine_offset: int = 0, coarse_offset: int = 0) -> None:
    """Refuse a roll-up whose bars would cut the finer ones."""
    if coarse % fine or (coarse_offset - fine_offset) % fine:
        raise ValueError(
            f"bars of {coarse} minutes from {coarse_offset} cut bars of {fine} minutes from {fine_offset}")


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01; never decreases with `ts`, whatever its timestamp type."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def utc_day(ts: Column) -> Column:
    """The day of UTC that `ts` falls into, whatever the session's zone: the day folders of the tables."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts.cast("timestamp")) / 86400).cast("int"))

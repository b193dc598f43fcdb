"""Candle building: resampling, roll-up, look-back and bar de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.functions.instants import (
    Instant,
    bucket_start,
    check_nesting,
    column_type,
    instant,
)

KEYS = ["symbol", "interval_min", "ts"]
VALUES = ["open", "high", "low", "close", "volume"]


TICK_ORDER = ("ts", "seq")


def ohlcv(order: Sequence[str] = TICK_ORDER) -> list[Column]:
    """Open, high, low, close and volume of the ticks of one bar."""
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return [
        F.min_by("price", place).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", place).alias("close"),
        F.sum("volume").cast("bigint").alias("volume"),
    ]


def resample_ticks(
    ticks: DataFrame,
    interval_min: int,
    offset_minutes: int = 0,
    order: Sequence[str] = TICK_ORDER,
) -> DataFrame:
    """Ticks `(symbol, ts, seq, price, volume)` to OHLCV bars of one interval.

    Every aggregate has a partial form, so a hot symbol is reduced to one row per bar and map task
    before anything is shuffled. `seq` orders ticks of one instant. Where it orders all ticks of a
    symbol, as an exchange's sequence number does, `order=("seq",)` lets the aggregation run in a
    hash map instead of sorting the ticks of a task by bar.
    """
    return (
        ticks.withColumn("bar", bucket_start(ticks, "ts", interval_min, offset_minutes))
        .groupBy("symbol", "bar")
        .agg(*ohlcv(order))
        .select("symbol", F.lit(interval_min).alias("interval_min"),
                F.col("bar").alias("ts"), *VALUES)
    )


def _merged() -> list[Column]:
    """Open, high, low, close and volume of the finer bars of one bar."""
    return [
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").cast("bigint").alias("volume"),
    ]


def rollup_bars(
    bars: DataFrame,
    interval_min: int,
    offset_minutes: int = 0,
    fine: tuple[int, int] | None = None,
) -> DataFrame:
    """Finer bars to bars of a multiple of their interval; the ticks are not read again.

    Name the interval and offset of `bars` in `fine` to have it checked that they nest.
    """
    if fine is not None:
        check_nesting(fine[0], interval_min, fine[1], offset_minutes)
    return (
        bars.withColumn("bar", bucket_start(bars, "ts", interval_min, offset_minutes))
        .groupBy("symbol", "bar")
        .agg(*_merged())
        .select("symbol", F.lit(interval_min).alias("interval_min"),
                F.col("bar").alias("ts"), *VALUES)
    )


def timeframes(
    bars: DataFrame,
    intervals: list[int],
    offset_minutes: int = 0,
    fine: tuple[int, int] | None = None,
) -> DataFrame:
    """Bars of several intervals from one pass over finer bars, clustered by symbol.

    Each interval is a multiple of that of `bars`. Every finer bar is sent once, to its symbol, and
    takes part in one bar of each interval there; what follows per symbol needs no other shuffle.
    A symbol's finer bars meet in one task, so bound them by a look-back first. `fine` is as for
    `rollup_bars`.
    """
    for minutes in intervals if fine is not None else []:
        check_nesting(fine[0], minutes, fine[1], offset_minutes)
    starts = F.array(
        *[
            F.struct(
                F.lit(minutes).alias("interval_min"),
                bucket_start(bars, "ts", minutes, offset_minutes).alias("start"),
            )
            for minutes in intervals
        ]
    )
    return (
        bars.select("symbol", "ts", *VALUES)
        .repartition("symbol")
        .withColumn("bar", F.explode(starts))
        .groupBy("symbol", F.col("bar.interval_min"), F.col("bar.start"))
        .agg(*_merged())
        .withColumnRenamed("start", "ts")
    )


def recent_ticks(
    ticks: DataFrame, interval_min: int, days_back: int, as_of: Instant
) -> DataFrame:
    """Ticks from `as_of - days_back` up to `as_of` itself; a plain range on `ts` for the reader.

    The bar that `as_of` lies in is made from what had been traded by then.
    """
    kind = column_type(ticks, "ts")
    end = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    first = instant(end - timedelta(days=days_back), kind)
    return ticks.where((F.col("ts") >= first) & (F.col("ts") <= instant(end, kind)))


def lookback(
    bars: DataFrame, windows: list[tuple[int, int]], as_of: Instant, unfinished: bool = True
) -> DataFrame:
    """Bars of each `(interval_min, days_back)` that start in `[as_of - days_back, as_of]`.

    Without `unfinished`, bars that end after `as_of` are left out: a stored bar may hold what was
    traded later.
    """
    kind = column_type(bars, "ts")
    end = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    keep = F.lit(False)
    for interval_min, days_back in windows:
        keep = keep | (
            (F.col("interval_min") == interval_min)
            & (F.col("ts") >= instant(end - timedelta(days=days_back), kind))
            & (F.col("ts") <= instant(end if unfinished else end - timedelta(minutes=interval_min), kind))
        )
    return bars.where(keep)


def dedupe_bars(bars: DataFrame, landed: str = "ord") -> DataFrame:
    """One bar per (symbol, interval, ts): the one that landed last."""
    newest = F.max_by(F.struct(*VALUES), F.col(landed)).alias("bar")
    return bars.groupBy(*KEYS).agg(newest).select(*KEYS, "bar.*")

"""Bars that can be merged: OHLCV together with the places of the first and the last tick.

A plain bar cannot take in a late tick, since nothing tells whether the tick came before its open or after its close. A bar
state keeps the order keys of both, so two states of one bar merge into one without their ticks:
the open of the earlier first tick, the close of the later last tick, extremes and sums. Merging is
associative and commutative; the states of any split of the ticks give the bars of all ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.functions.instants import bucket_start, check_nesting
from barscreen.operators.candles import KEYS, TICK_ORDER, VALUES, ohlcv

STATE = [*VALUES, "first_tick", "last_tick"]


def bar_states(ticks: DataFrame, interval_min: int, offset_minutes: int = 0) -> DataFrame:
    """Ticks `(symbol, ts, seq, price, volume)` to bar states; partial results ahead of the only shuffle."""
    place = F.struct(*TICK_ORDER)
    return (
        ticks.withColumn("bar", bucket_start(ticks, "ts", interval_min, offset_minutes))
        .groupBy("symbol", "bar")
        .agg(*ohlcv(), F.min(place).alias("first_tick"), F.max(place).alias("last_tick"))
        .select("symbol", F.lit(interval_min).alias("interval_min"), F.col("bar").alias("ts"), *STATE)
    )


def _merged() -> list:
    return [
        F.min_by("open", "first_tick").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last_tick").alias("close"),
        F.sum("volume").cast("bigint").alias("volume"),
        F.min("first_tick").alias("first_tick"),
        F.max("last_tick").alias("last_tick"),
    ]


def merge_states(states: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One state per bar from any number of states of it."""
    return states.groupBy(*keys).agg(*_merged()).select(*keys, *STATE)


def rollup_states(states: DataFrame, interval_min: int, offset_minutes: int = 0, fine: tuple[int, int] | None = None) -> DataFrame:
    """Finer states to those of a multiple of their interval; `fine` as for `candles.rollup_bars`."""
    if fine is not None:
        check_nesting(fine[0], interval_min, fine[1], offset_minutes)
    return (
        states.withColumn("bar", bucket_start(states, "ts", interval_min, offset_minutes))
        .groupBy("symbol", "bar")
        .agg(*_merged())
        .select("symbol", F.lit(interval_min).alias("interval_min"), F.col("bar").alias("ts"), *STATE)
    )


def bars_of(states: DataFrame) -> DataFrame:
    """Plain bars of merged states."""
    return states.select(*KEYS, *VALUES)

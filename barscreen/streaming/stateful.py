"""Signals over a stream of bars with keyed state: the last five bars of every series.

Where `streaming.signals` rewrites the state of all series in each batch, this operator reads and writes
only the series that have bars in the batch, each with one call to the store for its state and one to keep it. Each new bar comes out with its look-ups of earlier
bars, and the signals are the same expressions over them as in a batch. The state store must be RocksDB, which keeps state out of the heap; with changelog
checkpoints a batch uploads the changed rows only. `keyed_state` sets both while a query is started.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, StructType

from barscreen.operators.signals import BREAK_LOOKBACK, PRICES, SERIES, clean_prices, signal_columns

BAR = [*SERIES, "ts", "open", "high", "low", "close", "volume"]
KEPT = ["at", "high", "low", "close"]
HIGH, LOW, CLOSE = (KEPT.index(c) for c in KEPT[1:])
KEPT_SCHEMA = "bars array<struct<at: long, high: double, low: double, close: double>>"
FLAGS = ["has1", "has2", "has3"]
NUMBERS = ["high1", "low1", "close1", "high2", "low2", "low3", "swing_high", "swing_low"]

#: Settings of the state store.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store's settings for queries that are started within; the session's own come back after."""
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def look_ups(bars: list[tuple], known: int) -> Iterator[tuple]:
    """What each of `bars` (`KEPT`) of one series in order of time looks up in those before it (`FLAGS`, `NUMBERS`), from place `known` on."""

    def value(place: int, field: int) -> float | None:
        return bars[place][field] if place >= 0 else None

    for i in range(known, len(bars)):
        before = bars[max(0, i - BREAK_LOOKBACK) : i]
        highs, lows = ([bar[field] for bar in before if bar[field] is not None] for field in (HIGH, LOW))
        yield (
            i >= 1, i >= 2, i >= 3,
            value(i - 1, HIGH), value(i - 1, LOW), value(i - 1, CLOSE),
            value(i - 2, HIGH), value(i - 2, LOW), value(i - 3, LOW),
            max(highs, default=None), min(lows, default=None),
        )


class LastBars(StatefulProcessor):
    """Keeps the last five bars of a series, as one value, and gives every new bar its look-ups, in the columns `names`."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", KEPT_SCHEMA)
        self.out = Row(*self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.last.get()
        known = [tuple(bar) for bar in held[0]] if held else []
        new = sorted((row for row in rows if not known or row.at > known[-1][0]), key=lambda row: row.at)
        if not new:
            return
        every = known + [tuple(row[c] for c in KEPT) for row in new]
        self.last.update((every[-BREAK_LOOKBACK:],))
        for row, found in zip(new, look_ups(every, len(known))):
            yield self.out(*row, *found)

    def close(self) -> None:
        pass


def stateful_signals(bars: DataFrame) -> DataFrame:
    """Every bar of a stream with its signals; use append mode.

    A series' bars come in order of time from batch to batch, as `stream_bars` gives them; within a batch they
    may come in any order. A bar that is not later than its series' newest one of an earlier batch is left out,
    as a tick behind the watermark is. A task holds the bars that one series has in one batch.
    """
    sent = clean_prices(bars.select(*BAR)).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    columns = [*SERIES, "at", *PRICES, "volume"]
    sent = sent.select(*columns)
    schema = StructType([*sent.schema.fields])
    for name in (*FLAGS, *NUMBERS):
        schema = schema.add(name, BooleanType() if name in FLAGS else DoubleType())
    keyed = sent.groupBy(*SERIES)
    found = keyed.transformWithState(LastBars(schema.names), schema, outputMode="Append", timeMode="None")
    found = found.withColumn("ts", F.timestamp_micros("at"))
    return found.select(*BAR, *[column.alias(name) for name, column in signal_columns().items()])

"""Signals with keyed state against the batch history: many triggers, a restart, gaps and missing prices."""

import os
from datetime import timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from barscreen.operators import signals
from barscreen.streaming.stateful import FLAGS, NUMBERS, LastBars, keyed_state, stateful_signals
from tests.helpers import START

BARS = "symbol string, interval_min int, ts timestamp, open double, high double, low double, close double, volume long"
TRIGGERS = 10


def bar_rows():
    """Four series; one pauses, one has bars in two triggers only, some prices are missing."""
    rows = []
    for i in range(5 * TRIGGERS):
        for k, symbol in enumerate(["A", "B", "C", None]):
            if symbol == "B" and 11 <= i < 32 or symbol == "C" and i // 5 not in (2, 7):
                continue
            price = float((i * 7 + k * 13 + i * i) % 23)
            high = None if (i + k) % 11 == 0 else price + (i * 5) % 3
            low = float("nan") if (i + k) % 13 == 0 else price - (i * 3) % 4
            rows.append((symbol, 240, START + timedelta(hours=4 * i), price, high, low, price + i % 2, i))
    return rows


def land(spark, folder, triggers):
    for n in triggers:
        first = START + timedelta(hours=20 * n)
        part = [r for r in bar_rows() if first <= r[2] < first + timedelta(hours=20)]
        # Not in order of time within a trigger.
        frame = spark.createDataFrame(part[::-1], BARS).coalesce(1)
        frame.write.parquet(f"{folder}/in{n}")
        for name in os.listdir(f"{folder}/in{n}"):
            os.utime(f"{folder}/in{n}/{name}", (1000 + n, 1000 + n))


def run(spark, folder):
    bars = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*")
    writer = stateful_signals(bars).writeStream.format("parquet").option("path", f"{folder}/out")
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    with keyed_state(spark):
        query = writer.start()
    query.awaitTermination()
    return [p for p in query.recentProgress if p.numInputRows]


def test_equals_the_batch_history_over_triggers_and_a_restart(spark, tmp_path):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    land(spark, tmp_path, range(4))
    first = run(spark, tmp_path)
    land(spark, tmp_path, range(4, TRIGGERS))
    second = run(spark, tmp_path)
    assert len(first) + len(second) == TRIGGERS
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    found = spark.read.parquet(f"{tmp_path}/out").select("symbol", "interval_min", "ts", *signals.SIGNALS)
    want = signals.history(spark.createDataFrame(bar_rows(), BARS))
    assert found.count() == want.count() == len(bar_rows())
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def test_only_series_with_bars_are_touched(spark, tmp_path):
    """A batch of one series among many updates the rows of that series alone."""
    many = [(f"S{k}", 240, START + timedelta(hours=4 * i), 1.0, 2.0, 0.5, 1.5, 1) for k in range(40) for i in range(6)]
    spark.createDataFrame(many, BARS).coalesce(1).write.parquet(f"{tmp_path}/in0")
    run(spark, tmp_path)
    one = [("S7", 240, START + timedelta(days=3), 1.0, 2.0, 0.5, 1.5, 1)]
    spark.createDataFrame(one, BARS).coalesce(1).write.parquet(f"{tmp_path}/in1")
    (progress,) = run(spark, tmp_path)
    (state,) = progress.stateOperators
    assert progress.numInputRows == 1 and state.numRowsTotal == 40
    assert state.numRowsUpdated <= 5
    found = spark.read.parquet(f"{tmp_path}/out").where(F.col("symbol") == "S7")
    assert found.count() == 7


def test_bars_behind_their_series_are_left_out(spark, tmp_path):
    rows = [("A", 240, START + timedelta(hours=4 * i), 1.0, 2.0, 0.5, 1.5, 1) for i in range(3)]
    for n, part in enumerate([rows[1:], rows[:1]]):
        spark.createDataFrame(part, BARS).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
        run(spark, tmp_path)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


class OneValue:
    """A value state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def test_a_series_costs_one_call_to_read_and_one_to_keep():
    names = ["symbol", "interval_min", "at", "open", "high", "low", "close", "volume", *FLAGS, *NUMBERS]
    bar = Row(*names[:8])
    state, processor = OneValue(), LastBars(names)
    processor.init(state)
    bars = [bar("A", 240, i, 1.0, None if i == 2 else float(i * 5 % 7), float(i), float(i), 1) for i in range(9)]
    found = [*processor.handleInputRows(("A", 240), iter(bars[5::-1]), None)]
    found += processor.handleInputRows(("A", 240), iter(bars[4:]), None)
    assert state.calls == ["get", "update"] * 2
    assert [r.at for r in found] == list(range(9))
    for i, r in enumerate(found):
        highs = [b.high for b in bars[max(0, i - 5) : i] if b.high is not None]
        assert r.swing_high == (max(highs) if highs else None) and r.has2 == (i >= 2)
        assert r.low3 == (bars[i - 3].low if i >= 3 else None)
    assert [b[0] for b in state.value[0]] == [4, 5, 6, 7, 8]

"""The kept history against the history of all bars: appends, restatements, gaps, new series, repeated updates."""

import glob
import os
import random
from datetime import timedelta

from barscreen.operators import signals, zones
from barscreen.sources import history, sinks
from tests.helpers import START

BARS = "symbol string, interval_min int, ts timestamp, open double, high double, low double, close double, volume long"


def bar(symbol, day, rng):
    low = float(rng.randrange(20))
    opened, close = low + rng.randrange(4), low + rng.randrange(4)
    high = None if rng.random() < 0.05 else low + 4
    return (symbol, 1440, START + timedelta(days=day), opened, high, low, close, 1)


def steps():
    """Bars of each landing. B trades every twelfth day, C pauses for long, D comes late; old bars are restated."""
    rng = random.Random(6)
    days = {"A": range(40), "B": range(0, 40, 12), "C": [*range(9), *range(33, 40)], "D": range(30, 40)}
    landed = []
    for first, last in ((0, 20), (20, 31), (31, 36), (36, 40)):
        landed.append([bar(s, d, rng) for s, ds in days.items() for d in ds if first <= d < last])
    landed.insert(2, [bar("A", 12, rng), bar("A", 13, rng), bar("C", 2, rng), bar("B", 12, rng)])
    landed.insert(4, [bar("C", 8, rng), bar("A", 0, rng)])
    return landed


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def folders(path):
    return {f: sorted(os.listdir(f)) for f in glob.glob(f"{path}/interval_min=*/day=*")}


def check(spark, path, bars):
    kept = spark.read.parquet(path)
    assert same(history.signals_of(kept), signals.history(bars))
    assert same(history.order_blocks_of(kept), zones.order_blocks(bars))
    assert same(history.gaps_of(kept), zones.fair_value_gaps(bars))


def test_updates_equal_the_history_of_all_bars(spark, tmp_path):
    margin = 2
    candles, path = f"{tmp_path}/candles", f"{tmp_path}/history"
    held = {}
    for number, landed in enumerate(steps()):
        frame = spark.createDataFrame(landed, BARS)
        held |= {(r[0], r[2]): r for r in landed}
        sinks.write_candles(frame, candles)
        before = folders(path)
        history.update_history(spark, candles, path, frame, margin_days=margin)
        if number in (2, 4):
            check(spark, path, spark.createDataFrame(list(held.values()), BARS))
            after = folders(path)
            untouched = [f for f in before if before[f] == after[f]]
            # At most eight bars of each changed series around a changed bar are made anew.
            assert len(untouched) >= len(before) - 8 * len(landed) and untouched
    bars = spark.createDataFrame(list(held.values()), BARS)
    check(spark, path, bars)
    history.update_history(spark, candles, path, frame, margin_days=margin)
    history.update_history(spark, candles, path, frame.limit(0), margin_days=margin)
    check(spark, path, bars)


def test_days_outside_the_margins_are_not_read(spark, tmp_path):
    candles = f"{tmp_path}/candles"
    every = spark.createDataFrame([r for landed in steps() for r in landed], BARS)
    sinks.write_candles(every, candles)
    changed = every.where("symbol = 'A'").orderBy(every.ts.desc()).limit(1)
    first = (START + timedelta(days=30)).date()
    around = history._around(spark, candles, changed.select("symbol", "interval_min", "ts"), first, first + timedelta(days=30))
    assert {r.symbol for r in around.select("symbol").distinct().collect()} == {"A"}
    assert around.count() == 10

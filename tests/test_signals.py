import pytest
from pyspark.sql import functions as F

from barscreen.operators import signals, zones
from tests.helpers import (
    bars_frame,
    day,
    expected_blocks,
    expected_gaps,
    expected_signals,
    random_series,
)

SERIES = {
    **{f"len{n}": random_series(n, n) for n in range(1, 8)},
    **{f"short_nulls{n}_{k}": random_series(100 * k + n, n, nulls=True)
       for n in range(1, 8) for k in range(6)},
    **{f"long{k}": random_series(900 + k, 40) for k in range(8)},
    **{f"long_nulls{k}": random_series(950 + k, 40, nulls=True) for k in range(8)},
}
SPLITS = [None, 1, 2, 4, 7, 11, 4096]


def signal_rows(df):
    return {(r["symbol"], r["ts"]): tuple(r[s] for s in signals.SIGNALS) for r in df.collect()}


def expected_history():
    return {
        (symbol, day(i)): expected_signals(bars[: i + 1])
        for symbol, bars in SERIES.items()
        for i in range(len(bars))
    }


@pytest.mark.parametrize("split", SPLITS)
def test_history_equals_the_definition_on_every_prefix(spark, split):
    df = signals.history(bars_frame(spark, SERIES, shuffle=True), split)
    rows = df.collect()
    assert len(rows) == sum(len(b) for b in SERIES.values())
    assert signal_rows(df) == expected_history()


@pytest.mark.parametrize("split", SPLITS)
def test_zones_equal_the_definition(spark, split):
    bars = bars_frame(spark, SERIES, shuffle=True)

    def rows(df):
        return sorted(
            ((r["symbol"], r["ts"], r["kind"], r["zone_low"], r["zone_high"]) for r in df.collect()),
            key=str,
        )

    def wanted(find):
        return sorted(
            ((s, day(i), kind, low, high) for s, b in SERIES.items()
             for i, kind, low, high in find(b)),
            key=str,
        )

    assert rows(zones.order_blocks(bars, split)) == wanted(expected_blocks)
    assert rows(zones.fair_value_gaps(bars, split)) == wanted(expected_gaps)


def test_latest_equals_the_last_bar_of_the_history(spark):
    bars = bars_frame(spark, SERIES, shuffle=True)
    want = {(s, day(len(b) - 1)): expected_signals(b) for s, b in SERIES.items()}
    assert signal_rows(signals.latest(bars)) == want


def test_nan_prices_count_as_missing(spark):
    bars = bars_frame(spark, SERIES)
    spoiled = bars.fillna(float("nan"), ["open", "high", "low", "close"])
    assert spoiled.where("isnan(high)").count() > 0
    for split in (None, 4):
        assert signal_rows(signals.history(spoiled, split)) == signal_rows(
            signals.history(bars, None))
    assert signal_rows(signals.latest(spoiled)) == signal_rows(signals.latest(bars))


def test_series_of_two_timeframes_do_not_mix(spark):
    daily = bars_frame(spark, {"A": random_series(1, 30)})
    fourh = bars_frame(spark, {"A": random_series(2, 30)}, interval_min=240)
    both = signals.history(daily.unionByName(fourh), 4)
    for interval_min, alone in ((1440, daily), (240, fourh)):
        part = both.where(F.col("interval_min") == interval_min)
        assert signal_rows(part) == signal_rows(signals.history(alone, None))


CASES = {
    # name: (bars, trend, bullish break, bearish break, character change)
    "up": ([(1, 2, 1, 2), (2, 3, 2, 3)], "Bullish", True, False, False),
    "down": ([(2, 3, 2, 3), (1, 2, 1, 2)], "Bearish", False, False, False),
    "mixed": ([(1, 3, 1, 2), (2, 4, 0, 3)], "Neutral", False, False, False),
    "one_bar": ([(1, 2, 1, 2)], None, False, False, False),
    "old_high_ignored": ([(9, 99, 1, 5), *[(5, 5, 5, 5)] * 5, (5, 6, 5, 6)],
                         "Neutral", True, False, False),
    "tie_is_no_break": ([(5, 5, 5, 5), (5, 5, 5, 5)], "Neutral", False, False, False),
    "character_change": ([(10, 11, 10, 10), (10, 10, 9, 9), (9, 9, 7, 8), (8, 13, 8, 12)],
                         "Bullish", True, False, True),
    # The lowest of three includes the second bar's own low, so its close cannot be below it.
    "three_consistent": ([(10, 11, 10, 10), (9, 9, 7, 8), (8, 13, 8, 12)],
                         "Bullish", True, False, False),
}


def test_hand_computed_signals(spark):
    bars = bars_frame(spark, {name: case[0] for name, case in CASES.items()})
    found = {r["symbol"]: tuple(r[s] for s in signals.SIGNALS)
             for r in signals.latest(bars).collect()}
    assert found == {name: case[1:] for name, case in CASES.items()}


def test_hand_computed_zones(spark):
    bars = bars_frame(
        spark,
        {
            "block": [(5, 6, 3, 4), (4, 8, 4, 7)],
            "doji": [(5, 6, 3, 5), (4, 8, 4, 7)],
            "gap": [(1, 2, 1, 1), (3, 5, 3, 3), (3, 5, 3, 3)],
            "gap_in_last_pair": [(1, 2, 1, 1), (1, 2, 1, 1), (3, 5, 3, 3)],
            "two_bars": [(1, 2, 1, 1), (3, 5, 3, 3)],
        },
    )
    blocks = {r["symbol"]: (r["kind"], r["zone_low"], r["zone_high"])
              for r in zones.order_blocks(bars).collect()}
    assert blocks == {"block": ("bullish", 3.0, 6.0)}
    gaps = [(r["symbol"], r["kind"], r["zone_low"], r["zone_high"])
            for r in zones.fair_value_gaps(bars).collect()]
    assert gaps == [("gap", "up", 2.0, 3.0)]


def test_series_with_long_pauses_are_cut_right(spark):
    """Pieces of very different fill, some with a single bar."""
    series = random_series(5, 60)
    bars = bars_frame(spark, {"A": series}).withColumn("i", F.datediff("ts", F.lit(day(0))))
    jump = F.expr("make_dt_interval(cast(floor(i / 7) * 400 + floor(i / 3) as int))")
    paused = bars.withColumn("ts", F.col("ts") + jump).drop("i")
    for split in (1, 3, 30, 300):
        assert signal_rows(signals.history(paused, split)) == signal_rows(
            signals.history(paused, None)
        )


def test_one_hot_symbol_is_spread_over_pieces(spark):
    """A symbol with most of the bars is computed piecewise and still whole."""
    rows = spark.range(20000).select(
        F.when(F.col("id") < 15000, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 50))
        .alias("symbol"),
        F.lit(60).alias("interval_min"),
        F.timestamp_seconds(F.col("id") * 3600).alias("ts"),
        *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(50)) + 1).cast("double").alias(c)
          for c in ("open", "high", "low", "close")],
        F.lit(1).cast("bigint").alias("volume"),
    )
    split = signals.history(rows, 100)
    whole = signals.history(rows, None)
    assert split.count() == 20000
    assert split.exceptAll(whole).isEmpty() and whole.exceptAll(split).isEmpty()

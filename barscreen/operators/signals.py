"""Price-structure signals over candle series, for all symbols in one plan.

A series is the bars of one (symbol, interval_min), ordered by `ts`, with unique non-null `ts`.

Two forms:

* `history`: one row per bar, answering for the series that ends at that bar.
* `latest`: one row per series. Only the last six bars of a series matter, so the map tasks drop
  all others before the shuffle (`WindowGroupLimit`).

A single series may hold a large part of all rows. `with_neighbours` therefore sorts a series in
pieces of about `split_bars` bars; only the few bars around a cut go through a second window that
spans the whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barscreen.functions.instants import day_number
from barscreen.functions.parsing import nan_to_null

SERIES = ["symbol", "interval_min"]
PRICES = ["open", "high", "low", "close"]
BREAK_LOOKBACK = 5  # bars before the current one that form the prior swing
SPLIT_BARS = 4096

# Look-ups of earlier bars. A bar needs at most BREAK_LOOKBACK bars before it.
BACKWARD: dict[str, Callable[[WindowSpec], Column]] = {
    "has1": lambda w: F.lag("ts", 1).over(w).isNotNull(),
    "has2": lambda w: F.lag("ts", 2).over(w).isNotNull(),
    "has3": lambda w: F.lag("ts", 3).over(w).isNotNull(),
    "high1": lambda w: F.lag("high", 1).over(w),
    "low1": lambda w: F.lag("low", 1).over(w),
    "close1": lambda w: F.lag("close", 1).over(w),
    "high2": lambda w: F.lag("high", 2).over(w),
    "low2": lambda w: F.lag("low", 2).over(w),
    "low3": lambda w: F.lag("low", 3).over(w),
    "swing_high": lambda w: F.max("high").over(w.rowsBetween(-BREAK_LOOKBACK, -1)),
    "swing_low": lambda w: F.min("low").over(w.rowsBetween(-BREAK_LOOKBACK, -1)),
}

# Look-ups of later bars. A bar needs at most two bars after it.
FORWARD: dict[str, Callable[[WindowSpec], Column]] = {
    "has_next1": lambda w: F.lead("ts", 1).over(w).isNotNull(),
    "has_next2": lambda w: F.lead("ts", 2).over(w).isNotNull(),
    "open_n": lambda w: F.lead("open", 1).over(w),
    "high_n": lambda w: F.lead("high", 1).over(w),
    "low_n": lambda w: F.lead("low", 1).over(w),
    "close_n": lambda w: F.lead("close", 1).over(w),
}
FORWARD_REACH = 2


def clean_prices(bars: DataFrame) -> DataFrame:
    """Prices with null for NaN, so that maxima pass over them and no comparison holds."""
    return bars.withColumns({p: nan_to_null(F.col(p)) for p in PRICES if p in bars.columns})


def with_neighbours(
    bars: DataFrame,
    split_bars: int | None = SPLIT_BARS,
    names: Collection[str] = (*BACKWARD, *FORWARD),
) -> DataFrame:
    """Add the named look-ups of `BACKWARD` and `FORWARD` to every bar.

    `split_bars=None` uses one window per series: right when the length of a series is bounded,
    as after `lookback`.
    """
    bars = clean_prices(bars)
    backward = {n: make for n, make in BACKWARD.items() if n in names}
    forward = {n: make for n, make in FORWARD.items() if n in names}
    if split_bars is None:
        series = W.partitionBy(*SERIES).orderBy("ts")
        return bars.withColumns(
            {name: make(series) for name, make in {**backward, **forward}.items()}
        )

    # Pieces are calendar spans, so rows find theirs without knowing the others.
    span_days = F.greatest(F.lit(1), F.ceil(F.col("interval_min") * F.lit(split_bars) / 1440))
    pieced = bars.withColumn("_piece", F.floor(day_number(F.col("ts")) / span_days))
    piece = W.partitionBy(*SERIES, "_piece").orderBy("ts")
    place = {
        "_from_start": F.row_number().over(piece),
        "_near_end": F.lead("ts", BREAK_LOOKBACK).over(piece).isNull(),
    }
    at_cut = (F.col("_from_start") <= BREAK_LOOKBACK) | F.col("_near_end")
    inside = pieced.withColumns(
        {name: make(piece) for name, make in {**backward, **forward}.items()} | place
    ).where(~at_cut)

    # The bars at a cut see across it. Seven bars after and ten before every cut hold all that the
    # five on either side look up.
    series = W.partitionBy(*SERIES).orderBy("ts")
    context = (F.col("_from_start") <= BREAK_LOOKBACK + FORWARD_REACH) | F.col("_context_end")
    around = pieced.withColumns(
        place | {"_context_end": F.lead("ts", 2 * BREAK_LOOKBACK).over(piece).isNull()}
    ).where(context)
    across = around.drop("_context_end").withColumns(
        {name: make(series) for name, make in {**backward, **forward}.items()}
    ).where(at_cut)
    return inside.unionByName(across).drop("_piece", *place)


def trend(high: Column, low: Column, high1: Column, low1: Column) -> Column:
    """Direction of the last two bars."""
    return (
        F.when((high > high1) & (low > low1), "Bullish")
        .when((high < high1) & (low < low1), "Bearish")
        .otherwise("Neutral")
    )


def bullish_break(close: Column, swing_high: Column) -> Column:
    return F.coalesce(close > swing_high, F.lit(False))


def bearish_break(close: Column, swing_low: Column) -> Column:
    return F.coalesce(close < swing_low, F.lit(False))


def bullish_character_change(
    *,
    close: Column,
    close1: Column,
    low: Column,
    low1: Column,
    low2: Column,
    low3: Column,
    high2: Column,
    has2: Column,
    has3: Column,
) -> Column:
    """A close below an earlier low, then a close above the high two bars back.

    With exactly three bars the earlier low is the lowest of all three, the current one included.
    """
    lowest_of_three = F.when(low2.isNotNull(), F.least(low2, low1, low))
    prior_low = F.when(has3, low3).otherwise(lowest_of_three)
    return F.coalesce(has2 & (close1 < prior_low) & (close > high2), F.lit(False))


def signal_columns() -> dict[str, Column]:
    """The four per-bar signals over the look-ups of `with_neighbours`."""
    c = F.col
    return {
        "trend": F.when(c("has1"), trend(c("high"), c("low"), c("high1"), c("low1"))),
        "bullish_bos": bullish_break(c("close"), c("swing_high")),
        "bearish_bos": bearish_break(c("close"), c("swing_low")),
        "bullish_choch": bullish_character_change(
            close=c("close"), close1=c("close1"), low=c("low"), low1=c("low1"), low2=c("low2"),
            low3=c("low3"), high2=c("high2"), has2=c("has2"), has3=c("has3"),
        ),
    }


SIGNALS = ["trend", "bullish_bos", "bearish_bos", "bullish_choch"]


def history(bars: DataFrame, split_bars: int | None = SPLIT_BARS) -> DataFrame:
    """All four signals at every bar; a series' first bar has no trend."""
    return with_neighbours(bars, split_bars, BACKWARD).select(
        *SERIES, "ts", *[col.alias(name) for name, col in signal_columns().items()]
    )


def latest(bars: DataFrame) -> DataFrame:
    """All four signals at the last bar of every series."""
    newest_first = W.partitionBy(*SERIES).orderBy(F.desc("ts"))
    recent = (
        clean_prices(bars.select(*SERIES, "ts", "high", "low", "close"))
        .withColumn("_rn", F.row_number().over(newest_first))
        .where(F.col("_rn") <= BREAK_LOOKBACK + 1)
    )

    def at(name: str, back: int) -> Column:
        return F.max(F.when(F.col("_rn") == back + 1, F.col(name)))

    before = F.col("_rn") > 1
    picked = recent.groupBy(*SERIES).agg(
        F.max("ts").alias("ts"),
        F.max("_rn").alias("_bars"),
        *[at(name, k).alias(f"{name}{k}")
          for name, ks in {"high": (0, 1, 2), "low": (0, 1, 2, 3), "close": (0, 1)}.items()
          for k in ks],
        F.max(F.when(before, F.col("high"))).alias("swing_high"),
        F.min(F.when(before, F.col("low"))).alias("swing_low"),
    )
    c = F.col
    return picked.select(
        *SERIES,
        "ts",
        F.when(c("_bars") >= 2, trend(c("high0"), c("low0"), c("high1"), c("low1"))).alias("trend"),
        bullish_break(c("close0"), c("swing_high")).alias("bullish_bos"),
        bearish_break(c("close0"), c("swing_low")).alias("bearish_bos"),
        bullish_character_change(
            close=c("close0"), close1=c("close1"), low=c("low0"), low1=c("low1"), low2=c("low2"),
            low3=c("low3"), high2=c("high2"), has2=c("_bars") >= 3, has3=c("_bars") >= 4,
        ).alias("bullish_choch"),
    )

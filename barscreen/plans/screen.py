"""The screen: technical, fundamental and event profiles joined per symbol, then the rules.

Every input is shuffled once, by symbol, after it has been reduced to one row per symbol (or to the
bars within the look-back), so the joins at the end meet unique keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.functions.instants import Instant
from barscreen.operators import candles as cd
from barscreen.operators import news, rules, zones
from barscreen.operators.signals import SPLIT_BARS, signal_columns, with_neighbours
from barscreen.operators.validate import first_per_key
from barscreen.schemas import DAILY, FOUR_HOUR

# Causes in the order a symbol would meet them; the first is reported.
CAUSES = ["bad_candle_row", "short_daily", "no_4h_bars", "no_fundamentals"]


def technical_profile(bars: DataFrame, split_bars: int | None = SPLIT_BARS) -> DataFrame:
    """One row per symbol from its daily and four-hour bars.

    `fourh_liq_sweep` and `fourh_order_block` are slots for callers with such detectors.

    `split_bars=None` is for bars that are one per interval by construction (`resample_ticks`,
    `rollup_bars`, `timeframes`): the look-back then leaves at most 366 daily and 541 four-hour bars
    to a symbol. The series of other tables are cut as in `with_neighbours`.
    """
    c = F.col
    daily = c("interval_min") == DAILY[0]
    fourh = c("interval_min") == FOUR_HOUR[0]
    last = ~c("has_next1")
    signals = signal_columns()
    low_high = [c("low").alias("low"), c("high").alias("high")]

    per_bar = with_neighbours(bars, split_bars).select(
        "symbol",
        daily.alias("daily"),
        fourh.alias("fourh"),
        F.when(daily & last, signals["trend"]).alias("daily_trend"),
        F.when(daily & last, signals["bullish_bos"]).alias("daily_bos"),
        F.when(fourh & last, signals["bullish_bos"]).alias("fourh_bos"),
        F.when(daily & last, signals["bullish_choch"]).alias("daily_choch"),
        F.when(
            daily & zones.order_block_kind().isNotNull(), F.struct("ts", *low_high)
        ).alias("block"),
        F.when(daily, zones.gap_zones()).alias("gaps"),
        "ts",
    )
    gap_entry = F.when(
        F.size("gaps") > 0, F.struct("ts", "gaps")
    )
    grouped = per_bar.groupBy("symbol").agg(
        F.count_if("daily").alias("daily_bars"),
        F.count_if("fourh").alias("fourh_bars"),
        F.max("daily_trend").alias("daily_trend"),
        F.max("daily_bos").alias("daily_bos"),
        F.max("fourh_bos").alias("fourh_bos"),
        F.max("daily_choch").alias("daily_choch"),
        F.collect_list("block").alias("blocks"),
        F.collect_list(gap_entry).alias("gaps"),
    )
    gap_list = F.flatten(F.transform(F.array_sort("gaps"), lambda e: e["gaps"]))
    return grouped.select(
        "symbol", "daily_bars", "fourh_bars", "daily_trend", "daily_bos", "fourh_bos",
        "daily_choch",
        zones.ordered_zones(c("blocks")).alias("order_blocks"),
        F.lit(False).alias("fourh_liq_sweep"),
        F.lit(None).cast("struct<low:double,high:double>").alias("fourh_order_block"),
        F.transform(
            gap_list,
            lambda z: F.struct(z["zone_low"].alias("low"), z["zone_high"].alias("high")),
        ).alias("daily_fvg"),
    )


def failure_cause() -> Column:
    """The first reason why a symbol cannot be assessed, or null."""
    c = F.col
    return (
        F.when(c("bad_series").isNotNull(), "bad_candle_row")
        .when(F.coalesce(c("daily_bars"), F.lit(0)) < 2, "short_daily")
        .when(F.coalesce(c("fourh_bars"), F.lit(0)) < 1, "no_4h_bars")
        .when(c("filed").isNull(), "no_fundamentals")
    )


def filed_profiles(fundamentals: DataFrame, mapping: str | dict[str, str] = "corrected") -> DataFrame:
    """The ratios of every code, from its first row."""
    coded = fundamentals.where(F.col("nse_code").isNotNull())
    return (
        rules.fundamental_profile(first_per_key(coded, "nse_code"), mapping)
        .select(
            F.col("nse_code").alias("symbol"), "ord", F.lit(True).alias("filed"),
            "roce", "de_ratio", "altman_z", "piotroski_score",
        )
    )


def assess(
    bars: DataFrame,
    fundamentals: DataFrame,
    announcements: DataFrame,
    as_of: Instant,
    *,
    symbols: DataFrame | None = None,
    bad_series: DataFrame | None = None,
    mapping: str | dict[str, str] = "corrected",
    landed: str | None = None,
    split_bars: int | None = SPLIT_BARS,
) -> DataFrame:
    """One row per symbol: profiles, decision and, where the symbol failed, the cause.

    `bars` holds both timeframes; name its landing-order column in `landed` when a bar may occur
    twice. `symbols(symbol, ord)` defaults to the codes of the validated fundamentals.
    """
    recent = cd.lookback(bars, [DAILY, FOUR_HOUR], as_of)
    if landed is not None:
        recent = cd.dedupe_bars(recent, landed)
    technical = technical_profile(recent, split_bars)

    filed = filed_profiles(fundamentals, mapping)
    listed = filed if symbols is None else symbols.join(filed.drop("ord"), "symbol", "left")

    events = news.first_announcement(announcements).select("symbol", "sentiment", "title")
    joined = listed.join(technical, "symbol", "left").join(events, "symbol", "left")
    if bad_series is None:
        joined = joined.withColumn("bad_series", F.lit(None).cast("boolean"))
    else:
        bad = bad_series.select("symbol").distinct().withColumn("bad_series", F.lit(True))
        joined = joined.join(bad, "symbol", "left")
    return rules.evaluate(news.with_event_defaults(joined)).withColumn("cause", failure_cause())


def shortlist(assessed: DataFrame) -> DataFrame:
    """Buy decisions in symbol order, with the report line."""
    line = F.concat(F.col("symbol"), F.lit(": "), F.concat_ws("; ", "reasons"))
    return (
        assessed.where(F.col("cause").isNull() & (F.col("decision") == "Buy"))
        .select("ord", "symbol", "reasons", line.alias("line"))
        .orderBy("ord")
    )


def failures(assessed: DataFrame) -> DataFrame:
    """Symbols that could not be assessed."""
    return assessed.where(F.col("cause").isNotNull()).select("symbol", "cause")

"""Price zones found between adjacent bars: order blocks and fair value gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.operators.signals import SERIES, SPLIT_BARS, with_neighbours

BLOCK_LOOK_UPS = ["open_n", "close_n"]
GAP_LOOK_UPS = ["has_next2", "high_n", "low_n"]


def order_block_kind() -> Column:
    """`bullish` for a red bar before a green one, `bearish` for the reverse, else null."""
    red, green = F.col("close") < F.col("open"), F.col("close") > F.col("open")
    red_n, green_n = F.col("close_n") < F.col("open_n"), F.col("close_n") > F.col("open_n")
    return F.when(red & green_n, "bullish").when(green & red_n, "bearish")


def gap_zones() -> Column:
    """Gaps between a bar and the next, up before down; a series' last pair is not looked at."""
    c = F.col

    def gap(kind: str, low: Column, high: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), low.alias("zone_low"), high.alias("zone_high"))

    up = F.when(c("has_next2") & (c("low_n") > c("high")), gap("up", c("high"), c("low_n")))
    down = F.when(c("has_next2") & (c("high_n") < c("low")), gap("down", c("high_n"), c("low")))
    return F.array_compact(F.array(up, down))


def order_blocks(bars: DataFrame, split_bars: int | None = SPLIT_BARS) -> DataFrame:
    """One row per order block: the zone of the first bar of the pair."""
    return (
        with_neighbours(bars, split_bars, BLOCK_LOOK_UPS)
        .select(*SERIES, "ts", order_block_kind().alias("kind"),
                F.col("low").alias("zone_low"), F.col("high").alias("zone_high"))
        .where(F.col("kind").isNotNull())
    )


def fair_value_gaps(bars: DataFrame, split_bars: int | None = SPLIT_BARS) -> DataFrame:
    """One row per gap, stamped with the first bar of the pair."""
    return (
        with_neighbours(bars, split_bars, GAP_LOOK_UPS)
        .select(*SERIES, "ts", F.explode(gap_zones()).alias("zone"))
        .select(*SERIES, "ts", "zone.*")
    )


def ordered_zones(entries: Column) -> Column:
    """Collected `(ts, n, low, high)` structs to a time-ordered list of `(low, high)`."""
    return F.transform(
        F.array_sort(entries),
        lambda e: F.struct(e["low"].alias("low"), e["high"].alias("high")),
    )

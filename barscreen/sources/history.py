"""A table of signals and zones per bar that follows the candle table by increments.

A bar's row depends on the five bars before it and the two after it. When bars are appended or restated, the
rows of these bars, of the five after each and of the two before each are made anew and merged into their days; the folders
of all other days stay as they are. An update that is repeated gives the same table.

Read for an update are the days from `margin_days` before the first changed bar to as many after the last one, of
the series that changed. Series with fewer than seven bars in a margin (new, suspended or rarely traded ones) are looked up
beyond it too, where only the nearest seven bars leave the map tasks.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barscreen.functions.instants import utc_day
from barscreen.operators.candles import KEYS, VALUES
from barscreen.operators.signals import (
    BREAK_LOOKBACK,
    FORWARD_REACH,
    SERIES,
    SIGNALS,
    SPLIT_BARS,
    signal_columns,
    with_neighbours,
)
from barscreen.operators.zones import gap_zones, order_block_kind
from barscreen.sources.sinks import table_exists, write_by_day
from barscreen.sources.storage import shared_dir

HISTORY = [*SIGNALS, "block", "low", "high", "gaps"]
#: Bars on either side of a changed one that its neighbours' rows look at.
REACH = BREAK_LOOKBACK + FORWARD_REACH


def bar_history(bars: DataFrame, split_bars: int | None = SPLIT_BARS) -> DataFrame:
    """Every bar's signals, its order block kind with its own low and high as the zone, and its gaps."""
    return with_neighbours(bars, split_bars).select(
        *KEYS,
        *[column.alias(name) for name, column in signal_columns().items()],
        order_block_kind().alias("block"),
        "low",
        "high",
        gap_zones().alias("gaps"),
    )


def update_history(spark: SparkSession, candles: str, path: str, changed: DataFrame, margin_days: int = 45) -> None:
    """Bring the history below `path` up to date with the candle table after the bars `changed` landed in it."""
    if not table_exists(spark, path):
        write_by_day(bar_history(spark.read.parquet(candles).select(*KEYS, *VALUES)), path, HISTORY)
        return
    staged = shared_dir(spark, "changed-bars")
    changed.select(*KEYS).distinct().write.parquet(staged)
    changed = spark.read.parquet(staged)
    day = utc_day(F.col("ts"))
    first, last = changed.agg(F.min(day), F.max(day)).first()
    if first is None:
        return
    around = _around(spark, candles, changed, first - timedelta(days=margin_days), last + timedelta(days=margin_days))
    series = W.partitionBy(*SERIES).orderBy("ts")
    near = F.max("is_changed").over(series.rowsBetween(-BREAK_LOOKBACK, FORWARD_REACH))
    marked = around.join(changed.withColumn("is_changed", F.lit(True)), KEYS, "left").withColumn("is_near", near)
    rows = bar_history(marked.drop("is_changed", "is_near"), None).join(
        marked.where("is_near").select(*KEYS), KEYS, "left_semi"
    )
    write_by_day(rows, path, HISTORY)


def _around(spark: SparkSession, candles: str, changed: DataFrame, first, last) -> DataFrame:
    """The bars of the changed series from day `first` to `last`, and the nearest beyond where these are few."""
    table = spark.read.parquet(candles)
    touched = changed.groupBy(*SERIES).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    inside = table.where(F.col("day").between(first, last)).join(touched.select(*SERIES), SERIES, "left_semi")
    inside = inside.select(*KEYS, *VALUES)
    staged = shared_dir(spark, "bars-around")
    inside.write.parquet(staged)
    inside = spark.read.parquet(staged)
    counts = inside.join(touched, SERIES).groupBy(*SERIES).agg(
        F.count_if(F.col("ts") < F.col("first_ts")).alias("before"),
        F.count_if(F.col("ts") > F.col("last_ts")).alias("after"),
    )

    def beyond(side: Column, few: str, nearest: Column) -> DataFrame:
        wanted = counts.where(F.col(few) < REACH).select(*SERIES)
        place = F.row_number().over(W.partitionBy(*SERIES).orderBy(nearest))
        found = table.where(side).join(wanted, SERIES, "left_semi").select(*KEYS, *VALUES)
        return found.withColumn("place", place).where(F.col("place") <= REACH).drop("place")

    earlier = beyond(F.col("day") < first, "before", F.desc("ts"))
    later = beyond(F.col("day") > last, "after", F.asc("ts"))
    return inside.unionByName(earlier).unionByName(later)


def signals_of(history: DataFrame) -> DataFrame:
    return history.select(*KEYS, *SIGNALS)


def order_blocks_of(history: DataFrame) -> DataFrame:
    zone = [F.col("low").alias("zone_low"), F.col("high").alias("zone_high")]
    return history.where("block is not null").select(*KEYS, F.col("block").alias("kind"), *zone)


def gaps_of(history: DataFrame) -> DataFrame:
    return history.select(*KEYS, F.explode("gaps").alias("zone")).select(*KEYS, "zone.*")

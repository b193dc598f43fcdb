"""Decisions at many moments in one plan.

The screen answers for one moment. Here a series of moments, evenly spaced, is answered at once: everything that becomes
known is dated by the first moment that knows it (its slot), reduced to one row per symbol and slot, and carried
forward over a symbol's slots by windows. So every bar is read once, however many moments see it. What a decision
needs of a moment's look-back is kept exact: bars are counted in when they end and out when the look-back leaves
them, and the last bar brings along the bars that its signals look up, of which those too old are dropped.

The windows hold a row per slot of a symbol; before them, the bars of one series meet in one task (365 daily and 2,190 four-hour
bars a year). Announcements are reduced per symbol and slot before they are sent, so a symbol may have any number.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barscreen.functions.instants import day_number
from barscreen.operators import candles as cd
from barscreen.operators import news, rules, zones
from barscreen.operators.signals import (
    BREAK_LOOKBACK,
    SERIES,
    bullish_break,
    bullish_character_change,
    trend,
    with_neighbours,
)
from barscreen.plans.screen import failure_cause, filed_profiles
from barscreen.schemas import DAILY, FOUR_HOUR

MINUTE = 60_000_000
DAY = 1440 * MINUTE


def _micros(ts: Column) -> Column:
    """Microseconds of the wall clock since 1970, for either timestamp type."""
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return day_number(ts).cast("bigint") * DAY + (F.hour(ts) * 60 + F.minute(ts)).cast("bigint") * MINUTE + second


class Moments:
    """`count` moments of the wall clock from `start` on, `step_minutes` apart."""

    def __init__(self, start: datetime, count: int, step_minutes: int = 1440) -> None:
        self.start, self.count, self.step_minutes = start, count, step_minutes
        self.first = (start - datetime(1970, 1, 1)) // timedelta(microseconds=1)

    @property
    def span(self) -> timedelta:
        return timedelta(minutes=self.step_minutes) * (self.count - 1)

    def at(self, slot: Column) -> Column:
        """A slot's moment in microseconds."""
        return F.lit(self.first) + slot * (self.step_minutes * MINUTE)

    def time(self, slot: Column) -> Column:
        start = F.lit(self.start.isoformat(sep=" ")).cast("timestamp_ntz")
        return start + F.make_dt_interval(mins=(slot * self.step_minutes).cast("int"))

    def slot(self, micros: Column) -> Column:
        """The first slot whose moment is not before `micros`; `count` or more where none is."""
        step = F.lit(self.step_minutes * MINUTE)
        ahead = micros - F.lit(self.first)
        return F.greatest(F.lit(0), (ahead + F.pmod(-ahead, step)) / step).cast("bigint")


def _known_bars(bars: DataFrame, moments: Moments, windows: list[tuple[int, int]]) -> DataFrame:
    """What bars tell, by slot: `daily`, `fourh` (bars in less bars out), `bar` (the last one and those before it), `gap`.

    A bar is known from its end on, a gap from the end of the second bar after it.
    """
    c = F.col
    spans = [(minutes, (timedelta(days=days) + moments.span) / timedelta(days=1)) for minutes, days in windows]
    held = cd.lookback(bars, spans, moments.start + moments.span, unfinished=False)
    series = W.partitionBy(*SERIES).orderBy("ts")
    is_daily = c("interval_min") == DAILY[0]
    looked_up = F.collect_list(F.struct("at", "high", "low", "close")).over(series.rowsBetween(-BREAK_LOOKBACK, 0))
    seen = with_neighbours(held.withColumn("at", _micros(c("ts"))), None, zones.GAP_LOOK_UPS).withColumns({
        "bars": looked_up, "second_next": F.lead("at", 2).over(series)})

    length = c("interval_min").cast("bigint") * MINUTE
    days_back = F.lit(0)
    for minutes, days in windows:
        days_back = F.when(c("interval_min") == minutes, F.lit(days)).otherwise(days_back)
    known = moments.slot(c("at") + length)
    left = F.greatest(known, moments.slot(c("at") + days_back.cast("bigint") * DAY + 1))
    bar = F.when(is_daily, F.struct("at", "bars"))
    gap = F.when(is_daily & (F.size("gaps") > 0), F.struct("at", "gaps"))

    def told(slot: Column, change: int, bar: Column, gap: Column) -> Column:
        return F.struct(slot.alias("slot"), F.lit(change).alias("change"), bar.alias("bar"), gap.alias("gap"))

    no_bar, no_gap = F.when(F.lit(False), bar), F.when(F.lit(False), gap)
    rows = F.array(
        told(known, 1, bar, no_gap),
        told(left, -1, no_bar, no_gap),
        told(F.when(gap.isNotNull(), moments.slot(c("second_next") + length)), 0, no_bar, gap),
    )
    told_rows = seen.withColumn("gaps", zones.gap_zones()).select("symbol", is_daily.alias("is_daily"), F.explode(rows).alias("told"))
    return told_rows.select("symbol", "is_daily", "told.*").where(c("slot") < moments.count).select(
        "symbol", "slot",
        F.when(c("is_daily"), c("change")).otherwise(0).alias("daily"),
        F.when(c("is_daily"), 0).otherwise(c("change")).alias("fourh"),
        "bar", "gap",
    )


def _known_news(announcements: DataFrame, moments: Moments, known_at: str) -> DataFrame:
    """Announcements by slot; those without a time are not known at any moment."""
    event = F.struct("feed_ord", "sentiment", "title")
    dated = news.classify(announcements).where(F.col(known_at).isNotNull())
    found = dated.select("symbol", moments.slot(_micros(F.col(known_at))).alias("slot"), event.alias("event"))
    return found.where(F.col("slot") < moments.count).groupBy("symbol", "slot").agg(F.min("event").alias("event"))


def _signals(bars: Column) -> dict[str, Column]:
    """Daily signals at the last of up to six bars."""

    def at(name: str, back: int) -> Column:
        return F.try_element_at(bars, F.lit(-1 - back))[name]

    n = F.size(bars)
    before = F.slice(bars, F.lit(1), F.greatest(n - 1, F.lit(0)))
    highest = F.array_max(F.transform(before, lambda b: b["high"]))
    return {
        "daily_trend": F.when(n >= 2, trend(at("high", 0), at("low", 0), at("high", 1), at("low", 1))),
        "daily_bos": bullish_break(at("close", 0), highest),
        "daily_choch": bullish_character_change(
            close=at("close", 0), close1=at("close", 1), low=at("low", 0), low1=at("low", 1), low2=at("low", 2),
            low3=at("low", 3), high2=at("high", 2), has2=n >= 3, has3=n >= 4),
    }


def decision_history(
    bars: DataFrame,
    fundamentals: DataFrame,
    announcements: DataFrame,
    moments: Moments,
    *,
    mapping: str | dict[str, str] = "corrected",
    known_at: str = "published_at",
) -> DataFrame:
    """One row per listed symbol and moment, with decision and, where it could not be assessed, the cause.

    A moment knows the bars that had ended by then, within the screen's look-backs, and the announcements whose `known_at` is not
    later; of these the first in feed order counts. `bars` has each bar once. The fundamentals are the same at all moments.
    """
    c = F.col
    windows = [DAILY, FOUR_HOUR]
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(moments.count - 1).cast("bigint"))
    filed = filed_profiles(fundamentals, mapping)
    profile = F.struct(*[x for x in filed.columns if x != "symbol"]).alias("profile")
    parts = _known_bars(bars, moments, windows).unionByName(
        _known_news(announcements, moments, known_at), allowMissingColumns=True
    ).unionByName(filed.select("symbol", profile), allowMissingColumns=True)
    # A profile is sent once and repeated for every slot where its symbol is; slots and windows then need no other exchange.
    of_profile = F.when(c("profile").isNotNull(), slots).otherwise(F.array("slot"))
    parts = parts.repartition("symbol").withColumn("slot", F.explode(of_profile))
    by_slot = parts.groupBy("symbol", "slot").agg(
        F.coalesce(F.sum("daily"), F.lit(0)).alias("daily"),
        F.coalesce(F.sum("fourh"), F.lit(0)).alias("fourh"),
        F.max_by("bar", c("bar.at")).alias("bar"),
        F.collect_list("gap").alias("gaps"),
        F.min("event").alias("event"),
        F.first("profile", ignorenulls=True).alias("profile"),
    )
    until = W.partitionBy("symbol").orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    # Slots within the look-back; where that reaches before the first slot for all, a frame that only grows adds each row once.
    back = DAILY[1] * 1440 // moments.step_minutes
    within = until if moments.count <= back + 1 else W.partitionBy("symbol").orderBy("slot").rangeBetween(-back, 0)
    carried = by_slot.withColumns({
        "daily_bars": F.sum("daily").over(until),
        "fourh_bars": F.sum("fourh").over(until),
        "bar": F.last("bar", ignorenulls=True).over(until),
        "event": F.min("event").over(until),
        "gaps": F.flatten(F.collect_list("gaps").over(within)),
    }).where(c("profile").isNotNull())

    oldest = moments.at(c("slot")) - DAILY[1] * DAY
    bars_seen = F.filter(F.coalesce(c("bar.bars"), F.array().cast("array<struct<at:bigint,high:double,low:double,close:double>>")),
                         lambda b: b["at"] >= oldest)
    gaps_seen = F.flatten(F.transform(F.array_sort(F.filter("gaps", lambda g: g["at"] >= oldest)), lambda g: g["gaps"]))
    placed = carried.select("symbol", "slot", "profile.*", "daily_bars", "fourh_bars", "event.sentiment", "event.title",
                            bars_seen.alias("bars"), gaps_seen.alias("gaps"))
    joined = placed.withColumns(_signals(c("bars"))).select(
        "symbol", moments.time(c("slot")).alias("moment"), *[x for x in filed.columns if x != "symbol"], "daily_bars", "fourh_bars",
        "daily_trend", "daily_bos", "daily_choch", "sentiment", "title",
        F.transform("gaps", lambda z: F.struct(z["zone_low"].alias("low"), z["zone_high"].alias("high"))).alias("daily_fvg"),
        F.lit(None).cast("boolean").alias("bad_series"),
    )
    return rules.evaluate(news.with_event_defaults(joined)).withColumn("cause", failure_cause()).drop("bad_series", "filed")

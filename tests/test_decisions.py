"""The history of decisions against the screen run for each moment by itself."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barscreen.operators import candles as cd
from barscreen.operators import news
from barscreen.plans import decisions, screen
from barscreen.plans import queries as q
from barscreen.schemas import CANDLE, DAILY, FOUR_HOUR
from tests.test_screen import fundamentals

FIRST = datetime(2022, 1, 1)
NEWS = "feed_ord bigint, symbol string, title string, link string, date string, published_at timestamp"
SHOWN = ["symbol", "decision", "reasons", "veto_reason", "daily_bars", "fourh_bars", "daily_trend", "daily_bos", "daily_choch",
         "daily_fvg", "sentiment", "title", "cause"]


def sparse_bars(spark):
    """Two years in which bars are near each other, then far apart, so that look-backs cut between them."""
    draw, rows = random.Random(8), []
    for symbol in ("UP", "NEWS", "BAD", "FLAT", "LOST"):
        for interval_min, per_day, often in ((1440, 1, 0.02), (240, 6, 0.004)):
            dense = set(range(per_day * 12)) if symbol != "FLAT" else set()
            places = dense | {i for i in range(per_day * 760) if draw.random() < often}
            for i in sorted(places):
                prices = [None if draw.random() < 0.1 else float(draw.randint(1, 9)) for _ in range(4)]
                rows.append((symbol, interval_min, FIRST + timedelta(minutes=interval_min * i), *prices, 1))
    return spark.createDataFrame(rows, CANDLE)


def announcements(spark):
    draw = random.Random(9)
    rows = [(-i, draw.choice(["UP", "NEWS", "BAD", ""]), draw.choice(["bonus", "loss", "notice"]), "", "",
             None if i % 9 == 0 else FIRST + timedelta(hours=draw.randrange(24 * 700))) for i in range(40)]
    return spark.createDataFrame(rows, NEWS)


@pytest.mark.parametrize("moments", [
    decisions.Moments(FIRST + timedelta(days=9), 5, 1440), decisions.Moments(FIRST + timedelta(days=300, hours=7), 6, 100_000),
    decisions.Moments(FIRST + timedelta(days=370, minutes=1), 4, 1437), decisions.Moments(FIRST + timedelta(days=377), 1)])
def test_equal_to_the_screen_of_each_moment(spark, moments):
    bars, feed = sparse_bars(spark).persist(), announcements(spark)
    found = decisions.decision_history(bars, fundamentals(spark), feed, moments)
    rows = [r.asDict(recursive=True) for r in found.collect()]
    assert len(rows) == 7 * moments.count
    for k in range(moments.count):
        at = moments.start + timedelta(minutes=moments.step_minutes) * k
        known = cd.lookback(bars, [DAILY, FOUR_HOUR], at, unfinished=False)
        want = screen.assess(known, fundamentals(spark), feed.where(F.col("published_at") <= F.lit(at)), at).collect()
        got = {r["symbol"]: r for r in rows if r["moment"] == at}
        assert len(want) == len(got)
        for row in (r.asDict(recursive=True) for r in want):
            # A symbol without bars has nothing to count.
            empty = {"daily_bars": 0, "fourh_bars": 0, "daily_bos": False, "daily_choch": False, "daily_fvg": []}
            row = {c: empty.get(c) if row[c] is None else row[c] for c in SHOWN}
            assert {c: got[row["symbol"]][c] for c in SHOWN} == row


def test_bars_are_read_once(spark):
    text = q.decision_history(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Ticks, announcements (of the same table) and the four tables of the filings.
    assert text.count("FileScan") == 6


def test_profiles_are_sent_once(spark):
    """The rows of a symbol's slots are made after the exchange that brings its parts together, and not sent again."""
    found = decisions.decision_history(sparse_bars(spark), fundamentals(spark), announcements(spark), decisions.Moments(FIRST, 30))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(") < plan.index("RepartitionByExpression")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode(")]

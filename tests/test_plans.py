"""What the plans must look like to hold at scale."""

import re

import pytest

from barscreen.plans import queries as q
from barscreen.plans import screen
from barscreen.plans import warehouse as wh
from barscreen.operators import candles as cd
from barscreen.operators import signals
from barscreen.operators.master import incoming_companies, upsert

SF_DIR = "/root/testdata/sf0.001"
STREAMING = {name for name in q.QUERIES if name.startswith("stream_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - STREAMING))
def test_no_python_rows_and_no_cross_joins(spark, name):
    text = plan(q.QUERIES[name](spark, SF_DIR))
    for banned in ("Python", "Pandas", "Cartesian", "NestedLoop"):
        assert banned not in text, banned


def test_resampling_shuffles_once_after_partial_aggregation(spark):
    text = plan(q.daily_candles(spark, SF_DIR))
    assert text.count("Exchange") == 1
    assert "partial_min_by" in text.split("Exchange")[1]


def test_latest_bars_are_picked_before_the_shuffle(spark):
    bars = wh.table(spark, SF_DIR, "events").selectExpr(
        "cast(user_id as string) symbol", "60 interval_min", "ts", "value high", "value low",
        "value close")
    text = plan(signals.latest(bars))
    assert text.count("Exchange") == 1
    assert re.search(r"WindowGroupLimit .*, 6, Partial", text.split("Exchange")[1])


@pytest.mark.parametrize("name", ["dedupe_isin", "first_announcement"])
def test_first_rows_are_picked_before_the_shuffle(spark, name):
    text = plan(q.QUERIES[name](spark, SF_DIR))
    assert re.search(r"WindowGroupLimit .*, 1, Partial", text.split("Exchange hashpartitioning")[1])


def test_master_upsert_sums_up_before_its_shuffle(spark):
    incoming = incoming_companies(wh.filings(spark, SF_DIR))
    text = plan(upsert(wh.known_companies(spark, SF_DIR), incoming))
    assert "partial_min_by" in text.split("Exchange hashpartitioning(isin")[1]


def test_ticks_are_read_once_and_pruned(spark):
    recent = cd.lookback(q._both_timeframes(spark, SF_DIR), [q.DAILY, q.FOUR_HOUR], q.AS_OF)
    text = plan(screen.technical_profile(recent, split_bars=None))
    assert text.count("FileScan") == 1
    # Ticks to bars, bars to their symbol, and nothing more up to the profile.
    assert text.count("Exchange") == 2
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed
    assert "event_type" not in text and "props" not in text


def test_signals_of_one_series_share_one_sort(spark):
    bars = q.daily_candles(spark, SF_DIR).select("symbol", "interval_min", "ts", "high", "low", "close")
    text = plan(signals.history(bars, None))
    assert text.count("Window [") == 1


def test_unread_signals_leave_the_plan(spark):
    bars = q.daily_candles(spark, SF_DIR)
    text = plan(signals.history(bars, None).select("symbol", "ts", "trend"))
    assert "swing_high" not in text and "max(high" not in text

import itertools

from barscreen.functions.text import number_text
from barscreen.operators import rules

PROFILE = (
    "symbol string, roce double, de_ratio double, altman_z double, piotroski_score double,"
    " daily_trend string, daily_bos boolean, fourh_liq_sweep boolean,"
    " fourh_order_block struct<low:double,high:double>,"
    " daily_fvg array<struct<low:double,high:double>>, sentiment string, title string"
)
STRONG = ("S", 15.0, 0.5, 3.0, 8.0, "Bullish", True, True, (1700.0, 1730.0), [(1680.0, 1690.0)],
          "Neutral", "")


def test_full_profile(spark):
    found = rules.evaluate(spark.createDataFrame([STRONG], PROFILE)).first()
    assert found["decision"] == "Buy" and found["veto_reason"] is None
    assert found["reasons"] == [
        "High Piotroski Score (quality)", "Daily uptrend", "Daily BOS confirmed",
        "4H liquidity sweep detected", "Order block at (1700.0, 1730.0)",
        "Fair Value Gap at [(1680.0, 1690.0)]",
    ]


def test_truth_table(spark):
    """Weak fundamentals never block; a break or good news buys; bad news vetoes."""
    rows, want = [], {}
    grid = itertools.product(
        (5.0, 10.0, None), (2.0, 2.5, None), (1.7, 1.8, None), (6.9, 7.0, None),
        ("Bullish", "Neutral", None), (True, False, None), ("Positive", "Negative", "Neutral"),
    )
    for i, (roce, debt, altman, score, trend, bos, sentiment) in enumerate(grid):
        symbol = f"S{i}"
        rows.append((symbol, roce, debt, altman, score, trend, bos, False, None, [], sentiment, "T"))
        reasons = []
        if roce == 5.0 or debt == 2.5:
            reasons.append(rules.WEAK_FUNDAMENTALS)
        if altman == 1.7:
            reasons.append(rules.LOW_ALTMAN)
        if score == 7.0:
            reasons.append(rules.HIGH_PIOTROSKI)
        if trend == "Bullish":
            reasons.append("Daily uptrend")
        if bos:
            reasons.append("Daily BOS confirmed")
        if sentiment == "Negative":
            want[symbol] = ("Hold", [], "Negative news: T")
            continue
        if sentiment == "Positive":
            reasons.append("Positive news/announcement")
        buy = bool(bos) or sentiment == "Positive"
        want[symbol] = ("Buy" if buy else "Hold", reasons, None)
    found = rules.evaluate(spark.createDataFrame(rows, PROFILE)).collect()
    assert {r["symbol"]: (r["decision"], r["reasons"], r["veto_reason"]) for r in found} == want


def test_absent_columns(spark):
    """Ratios that are not given at all count as 0, signals as not seen."""
    found = rules.evaluate(spark.createDataFrame([("A",)], "symbol string")).first()
    assert found["decision"] == "Hold"
    assert found["reasons"] == [rules.WEAK_FUNDAMENTALS, rules.LOW_ALTMAN]


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([("A", nan, nan, nan, nan)],
                               "symbol string, roce double, de_ratio double, altman_z double,"
                               " piotroski_score double")
    assert rules.evaluate(df).first()["reasons"] == []


def test_numbers_print_as_in_python(spark):
    values = [0.0, -0.0, 1.5, -2.25, 0.1, 0.001, 0.0005, 1.25e-4, 9.99e-5, 1.5e-5, 1e-10, 1e7,
              12345678.25, 123456789012345.6, 1e15, 1e16, 1.5e16, 1e22, 1.7e300, 100.0, -1e16,
              -3e-7, 1e-100, 2.5e8, 40000000.0, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = df.select("x", number_text("x").alias("text")).collect()
    assert [r["text"] for r in found] == [repr(r["x"]) for r in found]

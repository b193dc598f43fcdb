"""Fundamental profile and the candidate rule set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.functions.parsing import nan_to_null
from barscreen.functions.text import zone_text, zones_text

# Profile field -> landed column. `literal` looks for other spellings of two headers and falls back
# to 0 where a file does not carry them.
PROFILE_COLUMNS = {
    "corrected": {
        "roce": "return_on_capital_employed",
        "de_ratio": "debt_to_equity",
        "altman_z": "altman_z_score",
        "piotroski_score": "piotroski_score",
    },
    "literal": {
        "roce": "Return on capital employed",
        "de_ratio": "Debt to equity",
        "altman_z": "altman_z_score",
        "piotroski_score": "piotroski_score",
    },
}

# The reason texts.
WEAK_FUNDAMENTALS = "Weak fundamentals (ROCE<10% or D/E>2)"
LOW_ALTMAN = "Altman Z-Score low (distress sign)"
HIGH_PIOTROSKI = "High Piotroski Score (quality)"
UPTREND = "Daily uptrend"
DAILY_BREAK = "Daily BOS confirmed"
LIQUIDITY_SWEEP = "4H liquidity sweep detected"
ORDER_BLOCK = "Order block at "
VALUE_GAP = "Fair Value Gap at "
POSITIVE_NEWS = "Positive news/announcement"
NEGATIVE_NEWS = "Negative news: "

# The thresholds of the fundamental rules.
MIN_ROCE = 10
MAX_DEBT = 2
MIN_ALTMAN = 1.8
MIN_PIOTROSKI = 7



def fundamental_profile(
    fundamentals: DataFrame, mapping: str | dict[str, str] = "corrected"
) -> DataFrame:
    """Add roce, de_ratio, altman_z and piotroski_score.

    A column that is absent counts as 0; a value that is missing stays missing.
    """
    chosen = PROFILE_COLUMNS[mapping] if isinstance(mapping, str) else mapping

    def pick(source: str) -> Column:
        if source not in fundamentals.columns:
            return F.lit(0.0)
        col = F.col(f"`{source}`")
        text = dict(fundamentals.dtypes)[source] == "string"
        return col.try_cast("double") if text else col.cast("double")

    return fundamentals.withColumns({field: pick(src) for field, src in chosen.items()})


def evaluate(profiles: DataFrame) -> DataFrame:
    """Add decision, reasons and veto_reason to joined profiles.

    Ratios that are null give no reason; ratio columns that are absent count as 0; other absent
    columns count as not given. A negative announcement vetoes: Hold, without reasons.
    """
    have = set(profiles.columns)

    def given(name: str, default: Column) -> Column:
        return F.col(name) if name in have else default

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    def ratio(name: str) -> Column:
        return nan_to_null(given(name, F.lit(0.0)).cast("double"))

    roce, debt = ratio("roce"), ratio("de_ratio")
    altman, piotroski = ratio("altman_z"), ratio("piotroski_score")
    bos = holds(given("daily_bos", F.lit(False)))
    sentiment = given("sentiment", F.lit("Neutral"))
    positive, veto = holds(sentiment == "Positive"), holds(sentiment == "Negative")

    found = [
        F.when(holds(roce < MIN_ROCE) | holds(debt > MAX_DEBT), WEAK_FUNDAMENTALS),
        F.when(altman < MIN_ALTMAN, LOW_ALTMAN),
        F.when(piotroski >= MIN_PIOTROSKI, HIGH_PIOTROSKI),
        F.when(given("daily_trend", F.lit(None).cast("string")) == "Bullish", UPTREND),
        F.when(bos, DAILY_BREAK),
        F.when(given("fourh_liq_sweep", F.lit(False)), LIQUIDITY_SWEEP),
    ]
    if "fourh_order_block" in have:
        block = F.concat(F.lit(ORDER_BLOCK), zone_text("fourh_order_block"))
        found.append(F.when(F.col("fourh_order_block").isNotNull(), block))
    if "daily_fvg" in have:
        gaps = F.concat(F.lit(VALUE_GAP), zones_text("daily_fvg"))
        found.append(F.when(F.size("daily_fvg") > 0, gaps))
    found.append(F.when(positive, POSITIVE_NEWS))

    no_reasons = F.array().cast("array<string>")
    return profiles.withColumns(
        {
            "decision": F.when(~veto & (bos | positive), "Buy").otherwise("Hold"),
            "reasons": F.when(veto, no_reasons).otherwise(F.array_compact(F.array(*found))),
            "veto_reason": F.when(
                veto,
                F.concat(
                    F.lit(NEGATIVE_NEWS), F.coalesce(given("title", F.lit("")), F.lit(""))
                ),
            ),
        }
    )

"""Corporate announcements: shaping, classification and the first match per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.functions.parsing import rss_date_or_null
from barscreen.functions.text import before_colon, contains_any
from barscreen.operators.validate import first_per_key

# Words looked for in the lower-cased title, event type, sentiment; first match wins.
RULES = [
    (["buyback", "bonus", "dividend"], "Corporate Action", "Positive"),
    (["board meeting", "results", "quarterly"], "Results", "Neutral"),
    (["debt", "fall", "restructure", "loss"], "Fundamental", "Negative"),
]
NO_MATCH = ("General", "Neutral")


def shape_items(items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Feed items `(feed_ord, title, link, pubDate)` to announcements; missing text becomes ''."""
    title = F.coalesce("title", F.lit(""))
    date = F.coalesce("pubDate", F.lit(""))
    return items.select(
        "feed_ord",
        before_colon(title).alias("symbol"),
        title.alias("title"),
        F.coalesce("link", F.lit("")).alias("link"),
        date.alias("date"),
        rss_date_or_null(date).alias("published_at"),
        *(keep or []),
    )


def classification(title: Column) -> Column:
    """`struct<event_type, sentiment>` of a title."""

    def outcome(event_type: str, sentiment: str) -> Column:
        return F.struct(
            F.lit(event_type).alias("event_type"), F.lit(sentiment).alias("sentiment")
        )

    text = F.lower(title)
    (words, *first), *rest = RULES
    chosen = F.when(contains_any(text, words), outcome(*first))
    for words, event_type, sentiment in rest:
        chosen = chosen.when(contains_any(text, words), outcome(event_type, sentiment))
    return chosen.otherwise(outcome(*NO_MATCH))


def classify(announcements: DataFrame) -> DataFrame:
    found = classification(F.col("title"))
    return announcements.withColumns(
        {"event_type": found["event_type"], "sentiment": found["sentiment"]}
    )


def first_announcement(announcements: DataFrame) -> DataFrame:
    """The first announcement of every symbol in feed order, classified."""
    return classify(first_per_key(announcements, "symbol", "feed_ord"))


def event_profile(symbols: DataFrame, announcements: DataFrame) -> DataFrame:
    """Sentiment and title per symbol; ('Neutral', '') for symbols without announcement."""
    found = first_announcement(announcements).select("symbol", "event_type", "sentiment", "title")
    return with_event_defaults(symbols.join(found, "symbol", "left"))


def with_event_defaults(joined: DataFrame) -> DataFrame:
    return joined.withColumns(
        {
            "sentiment": F.coalesce("sentiment", F.lit("Neutral")),
            "title": F.coalesce("title", F.lit("")),
        }
    )

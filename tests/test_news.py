import os
from datetime import datetime

import pytest

from barscreen.operators import news
from barscreen.sources.feed import read_feed

TITLES = {
    "RELIANCE: Board Meeting Results": ("RELIANCE", "Results", "Neutral"),
    "AAA: Board Meeting on Buyback": ("AAA", "Corporate Action", "Positive"),
    "BBB: Quarterly loss": ("BBB", "Results", "Neutral"),
    "CCC: Revenue shortfall": ("CCC", "Fundamental", "Negative"),
    "Exchange circular": ("", "General", "Neutral"),
    "DDD: Debt restructured, DIVIDEND kept": ("DDD", "Corporate Action", "Positive"),
    "EEE: Debt: nothing": ("EEE", "Fundamental", "Negative"),
    " FFF : update": (" FFF ", "General", "Neutral"),
    ": bonus": ("", "Corporate Action", "Positive"),
    "": ("", "General", "Neutral"),
}
ITEM = "feed_ord bigint, title string, link string, pubDate string"


def items(spark, titles):
    return spark.createDataFrame([(i, t, None, None) for i, t in enumerate(titles)], ITEM)


def test_symbols_and_classes_of_titles(spark):
    found = news.classify(news.shape_items(items(spark, TITLES))).collect()
    assert {r["title"]: (r["symbol"], r["event_type"], r["sentiment"]) for r in found} == TITLES
    assert {(r["link"], r["date"], r["published_at"]) for r in found} == {("", "", None)}


WORDS = [(word, i) for i, (words, _, _) in enumerate(news.RULES) for word in words]


def test_every_pair_of_words_follows_the_rule_order(spark):
    pairs = {f"{a} / {b}": min(i, j) for a, i in WORDS for b, j in WORDS}
    found = news.classify(news.shape_items(items(spark, pairs))).collect()
    assert {r["title"]: (r["event_type"], r["sentiment"]) for r in found} == {
        title: news.RULES[first][1:] for title, first in pairs.items()
    }


def test_missing_title_is_empty(spark):
    df = spark.createDataFrame([(1, None, "l", "d")], ITEM)
    assert news.shape_items(df).first()["title"] == ""


def test_first_in_feed_order_is_taken_with_exact_case(spark):
    df = items(spark, ["A: x", "a: loss", "A: bonus", "B: debt", "B: bonus"])
    symbols = spark.createDataFrame([("A",), ("a",), ("B",), ("C",)], "symbol string")
    found = news.event_profile(symbols, news.shape_items(df))
    assert sorted((r["symbol"], r["sentiment"], r["title"]) for r in found.collect()) == [
        ("A", "Neutral", "A: x"), ("B", "Negative", "B: debt"), ("C", "Neutral", ""),
        ("a", "Negative", "a: loss"),
    ]


def document(titles, pub="Mon, 01 Jan 2024 10:00:00 +0530"):
    body = "".join(
        f"<item><title>{t}</title><link>http://x/{i}</link><pubDate>{pub}</pubDate></item>"
        for i, t in enumerate(titles)
    )
    return f'<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>{body}</channel></rss>'


def test_feed_documents(spark, tmp_path):
    (tmp_path / "old.xml").write_text(document(["A: loss", "B: bonus"]))
    (tmp_path / "new.xml").write_text(document(["A: dividend &amp; more", "plain"]))
    os.utime(tmp_path / "old.xml", (1000, 1000))
    os.utime(tmp_path / "new.xml", (2000, 2000))
    shaped = news.shape_items(read_feed(spark, str(tmp_path)))
    rows = shaped.orderBy("feed_ord").collect()
    assert [r["title"] for r in rows] == ["A: dividend & more", "plain", "A: loss", "B: bonus"]
    assert rows[0]["published_at"] == datetime(2024, 1, 1, 4, 30)
    assert rows[0]["link"] == "http://x/0"
    first = {r["symbol"]: r["sentiment"] for r in news.first_announcement(shaped).collect()}
    assert first == {"A": "Positive", "": "Neutral", "B": "Positive"}


@pytest.mark.parametrize(
    ("text", "parsed"),
    [("Fri, 05 Jan 2024 00:00:00 +0000", datetime(2024, 1, 5)), ("yesterday", None), ("", None)],
)
def test_dates(spark, text, parsed):
    df = spark.createDataFrame([(1, "t", "l", text)], ITEM)
    found = news.shape_items(df).first()
    assert (found["date"], found["published_at"]) == (text, parsed)

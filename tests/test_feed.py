"""Broken feed documents cost what is broken alone, and the ledger keeps landing times when files are copied."""

import os
import shutil
from datetime import datetime, timedelta

import pytest

from barscreen.operators import news
from barscreen.sources.feed import read_feed, read_feed_rejects, read_ledger, update_ledger
from barscreen.streaming.feed import start_announcement_stream, stream_feed
from tests.test_news import document

BROKEN = "<item><title>B: bonus</title><link>x</link></itm>"


def broken_document():
    whole = document(["A: loss", "C: dividend", "D: debt"])
    at = whole.index("<item><title>C")
    return whole[:at] + BROKEN + whole[at:]


def titles(df):
    return [r["title"] for r in news.shape_items(df).orderBy("feed_ord").collect()]


def test_broken_items_cost_themselves(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.xml").write_text(broken_document().replace("<link>", "\n<link>").replace("</item>", "</item>\n"))
    (folder / "b.xml").write_text(document(["E: one", "F: two"])[:-60])
    (folder / "c.xml").write_text("")
    (folder / "d.xml").write_text('<rss><channel><item id="1"><title>G &amp; x</title></item></channel></rss>\n')
    for name, at in zip("abcd", (4000, 3000, 2000, 1000)):
        os.utime(folder / f"{name}.xml", (at, at))
    assert titles(read_feed(spark, str(folder))) == ["A: loss", "C: dividend", "D: debt", "E: one", "G & x"]
    rejects = {(r.file.rsplit("/", 1)[1], r.pos) for r in read_feed_rejects(spark, str(folder)).collect()}
    assert rejects == {("a.xml", 2), ("b.xml", 2), ("b.xml", 0)}
    assert BROKEN in [r.record.replace("\n", "") for r in read_feed_rejects(spark, str(folder)).collect()]
    start_announcement_stream(stream_feed(spark, str(folder)), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["A: loss", "C: dividend", "D: debt", "E: one", "G & x"]


def at(second):
    return datetime(1970, 1, 1) + timedelta(seconds=second)


def test_copies_keep_their_landing_times(spark, tmp_path):
    folder, ledger = tmp_path / "in", f"{tmp_path}/ledger"
    folder.mkdir()
    for name, when, title in (("a", 1000, "A: loss"), ("b", 2000, "A: bonus"), ("c", 3000, "A: debt")):
        (folder / f"{name}.xml").write_text(document([title]))
        os.utime(folder / f"{name}.xml", (when, when))
    with pytest.raises(ValueError, match="not in the ledger"):
        read_feed(spark, str(folder), at(2500), ledger=ledger)
    update_ledger(spark, str(folder), ledger)

    def answers(path):
        return [titles(read_feed(spark, str(path), at(t), since, ledger)) for t, since in
                ((500, timedelta(0)), (1000, timedelta(0)), (2500, timedelta(0)), (9000, timedelta(seconds=1500)))]

    want = [[], ["A: loss"], ["A: bonus"], ["A: debt", "A: bonus"]]
    assert answers(folder) == want
    copy = tmp_path / "copy"
    shutil.copytree(folder, copy)
    for name, when in zip("abc", (9100, 9000, 8900)):
        os.utime(copy / f"{name}.xml", (when, when))
    update_ledger(spark, str(copy), ledger)
    assert answers(copy) == want
    # The first folder can still be read, and a poll that overwrites a document is a new document.
    assert answers(folder) == want
    (folder / "a.xml").write_text(document(["A: merger"]))
    os.utime(folder / "a.xml", (9500, 9500))
    update_ledger(spark, str(folder), ledger)
    assert titles(read_feed(spark, str(folder), at(9600), ledger=ledger)) == ["A: merger"]
    assert titles(read_feed(spark, str(folder), at(2500), ledger=ledger)) == ["A: bonus"]
    assert read_ledger(spark, ledger).count() == 7
    update_ledger(spark, str(folder), ledger)
    assert read_ledger(spark, ledger).count() == 7


def test_items_are_parsed_once_by_many_tasks(spark, tmp_path):
    """One document is cut by one task; nothing is parsed before its items are dealt out."""
    (tmp_path / "a.xml").write_text(document([f"S{k}: bonus" for k in range(500)]))
    items = read_feed(spark, str(tmp_path))
    assert items.count() == 500
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1
    assert 0 < plan.index("from_xml") < plan.index("RepartitionByExpression")


def test_documents_without_a_preamble_or_an_end(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<item><title>A: x</title></item><items/><item ><title>B: y</title></item>")
    (tmp_path / "b.xml").write_text("no tags")
    assert titles(read_feed(spark, str(tmp_path))) == ["A: x", "B: y"]
    rejects = {(r.file.rsplit("/", 1)[1], r.pos, r.record[-7:]) for r in read_feed_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {("a.xml", 0, "</item>"), ("b.xml", 0, "no tags")}

import os
import shutil
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from barscreen.operators import candles as cd
from barscreen.operators import signals
from barscreen.sources.storage import committed_versions
from barscreen.streaming.bars import stream_bars
from barscreen.streaming.feed import start_announcement_stream, stream_feed
from barscreen.streaming.signals import start_signal_stream
from tests.helpers import START
from tests.test_candles import TICKS

DAYS = 12


def tick_rows():
    """Three symbols over twelve days; the second pauses for a while."""
    rows = []
    for i in range(DAYS * 24):
        for k, symbol in enumerate("ABC"):
            if symbol == "B" and 60 <= i < 150:
                continue
            price = float((i * 7 + k * 13 + i * i) % 23)
            rows.append((symbol, START + timedelta(hours=i, minutes=k), i * 3 + k, price, 1))
    return rows


@pytest.fixture(scope="module")
def tick_files(spark, tmp_path_factory):
    """One file per two days, landed in time order."""
    root = tmp_path_factory.mktemp("ticks")
    rows = tick_rows()
    for n in range(DAYS // 2):
        first = START + timedelta(days=2 * n)
        part = [r for r in rows if first <= r[1] < first + timedelta(days=2)]
        spark.createDataFrame(part, TICKS).coalesce(1).write.parquet(f"{root}/in{n}")
        for path in (root / f"in{n}").glob("*.parquet"):
            os.utime(path, (1000 + n, 1000 + n))
    return str(root)


def tick_stream(spark, root):
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in*")


def closed_bars(spark, interval_min, delay_minutes):
    ticks = spark.createDataFrame(tick_rows(), TICKS)
    last = max(r[1] for r in tick_rows()) - timedelta(minutes=delay_minutes)
    bars = cd.resample_ticks(ticks, interval_min)
    return bars.where(F.col("ts") + F.make_dt_interval(mins=F.lit(interval_min)) <= F.lit(last))


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == b.count()


def test_closed_bars_equal_the_batch_result(spark, tick_files, tmp_path):
    bars = stream_bars(tick_stream(spark, tick_files), 240, "30 minutes")
    query = (
        bars.writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert same(spark.read.parquet(f"{tmp_path}/out"), closed_bars(spark, 240, 30))


def run_signals(spark, tick_files, folder):
    bars = stream_bars(tick_stream(spark, tick_files), 240, "30 minutes")
    start_signal_stream(
        bars, f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("symbol", "interval_min", "ts",
                                                      *signals.SIGNALS)


def test_rolling_signals_equal_the_batch_history(spark, tick_files, tmp_path):
    found = run_signals(spark, tick_files, tmp_path)
    want = signals.history(closed_bars(spark, 240, 30))
    assert same(found, want)
    assert len(committed_versions(spark, f"{tmp_path}/state")) <= 4
    assert len(committed_versions(spark, f"{tmp_path}/out")) > 4

    # A batch that was done but not recorded as done is repeated with the same result.
    commits = tmp_path / "checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if (commits / name).exists():
            (commits / name).unlink()
    assert same(run_signals(spark, tick_files, tmp_path), want)


def feed_item(title, date, link=""):
    return f"<item><title>{title}</title><link>{link}</link><pubDate>{date}</pubDate></item>"


def test_polls_of_the_feed_give_each_announcement_once(spark, tmp_path):
    """An old date, one title on two dates and an item that is still there after a year."""
    polls = tmp_path / "polls"
    polls.mkdir()
    new, old = "Mon, 29 Jan 2024 10:00:00 +0000", "Sun, 31 Dec 2023 10:00:00 +0000"
    kept = feed_item("A: bonus", new)
    documents = [kept, kept + feed_item("C: late bonus", old, "x"), feed_item("A: bonus", old) + kept, kept]
    for n, body in enumerate(documents):
        path = polls / f"poll{n}.xml"
        path.write_text(f"<rss><channel>{body}</channel></rss>")
        os.utime(path, (1000 + n * 40_000_000, 1000 + n * 40_000_000))
    start_announcement_stream(
        stream_feed(spark, str(polls), files_per_trigger=1), f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    ).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["version"], r["symbol"], r["date"], r["sentiment"]) for r in found.collect()) == [
        (0, "A", new, "Positive"), (1, "C", old, "Positive"), (2, "A", old, "Positive")]


def test_lost_state_is_an_error(spark, tick_files, tmp_path):
    run_signals(spark, tick_files, tmp_path)
    shutil.rmtree(tmp_path / "state")
    commits = tmp_path / "checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if (commits / name).exists():
            (commits / name).unlink()
    with pytest.raises(Exception, match="is gone"):
        run_signals(spark, tick_files, tmp_path)

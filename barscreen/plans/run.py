"""A whole run: land and validate, update the master, screen, store and print."""

from __future__ import annotations

from datetime import timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from barscreen.functions.instants import Instant
from barscreen.operators import news, validate
from barscreen.plans import screen
from barscreen.schemas import DAILY, FOUR_HOUR
from barscreen.sources import sinks
from barscreen.sources.candles import Responses, parse_responses, read_candles, read_responses
from barscreen.sources.feed import read_feed, read_feed_rejects, update_ledger
from barscreen.sources.fundamentals import Landed, non_numeric_warnings, read_fundamentals, read_validated
from barscreen.sources.storage import shared_dir


class Ingested(NamedTuple):
    frame: DataFrame
    report: DataFrame
    warnings: DataFrame
    master: DataFrame
    extra: list[str]


class Screened(NamedTuple):
    assessed: DataFrame
    shortlist: DataFrame
    failures: DataFrame


def land(
    spark: SparkSession, csv_path: str, landed_path: str | None = None, multi_line: bool = False
) -> Landed:
    """The typed rows of fundamentals CSV files, parsed once and stored; scratch storage unless a path is given.

    Row order and cells are drawn from the files here and nowhere else, so all that follows sees the same
    rows. Counting by metrics observed on the way to the validated table would save this step, but tasks
    ahead of a shuffle that run again after a lost executor count twice there.
    """
    path = landed_path or shared_dir(spark, "landed-fundamentals")
    landed = read_fundamentals(spark, csv_path, multi_line=multi_line)
    landed.frame.write.mode("overwrite").parquet(path)
    return Landed(spark.read.parquet(path), landed.extra)


def ingest(
    spark: SparkSession,
    csv_path: str,
    validated_path: str,
    master_root: str,
    as_of: Instant,
    landed_path: str | None = None,
    multi_line: bool = False,
) -> Ingested:
    """Fundamentals CSV to the stored validated table and the company master.

    The CSV is scanned once; the report reads the few landed columns it counts. With a `landed_path` a
    later run of the day can `validate` what was landed without the CSV.
    """
    landed = land(spark, csv_path, landed_path, multi_line)
    checked = validate.validate(landed.frame, as_of, landed.extra)
    sinks.write_validated(checked.frame, validated_path)
    frame = read_validated(spark, validated_path)
    master = sinks.update_master(frame, master_root)
    return Ingested(frame, checked.report, non_numeric_warnings(frame), master, checked.extra)


def load_responses(spark: SparkSession, path: str) -> Responses:
    """Candles of landed responses; a bar that landed again is there twice."""
    return parse_responses(read_responses(spark, path))


def screen_stored(
    spark: SparkSession,
    validated_path: str,
    feed_path: str,
    as_of: Instant,
    out: str,
    *,
    candle_table: str | None = None,
    responses: str | None = None,
    mapping: str = "corrected",
    news_since: timedelta = timedelta(0),
    feed_ledger: str | None = None,
) -> Screened:
    """Screen stored inputs; assessments are written once and the two reports read from them.

    The news are those of the newest feed document landed by `as_of`, and of the ones landed up to
    `news_since` before it. Name a `feed_ledger` to have landing times kept when the documents are copied. Items
    that could not be read go to `feed_rejects`.
    """
    if feed_ledger is not None:
        update_ledger(spark, feed_path, feed_ledger)
    read_feed_rejects(spark, feed_path).write.mode("overwrite").parquet(f"{out}/feed_rejects")
    bad_series = None
    if candle_table is not None:
        bars, landed = read_candles(spark, candle_table, [DAILY, FOUR_HOUR], as_of), None
    elif responses is not None:
        loaded = load_responses(spark, responses)
        bars, bad_series = loaded.candles, loaded.bad_series
        loaded.rejects.write.mode("overwrite").parquet(f"{out}/rejects")
        landed = "landed"
    else:
        raise ValueError("give a candle table or candle responses")
    screen.assess(
        bars,
        read_validated(spark, validated_path),
        news.shape_items(read_feed(spark, feed_path, as_of, news_since, feed_ledger)),
        as_of,
        bad_series=bad_series,
        landed=landed,
        mapping=mapping,
    ).write.mode("overwrite").parquet(f"{out}/assessed")
    assessed = spark.read.parquet(f"{out}/assessed")
    return Screened(assessed, screen.shortlist(assessed), screen.failures(assessed))

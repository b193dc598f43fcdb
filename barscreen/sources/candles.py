"""Candle tables and landed candle responses."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.functions.instants import Instant
from barscreen.functions.parsing import nan_to_null
from barscreen.operators.candles import VALUES, lookback
from barscreen.operators.signals import clean_prices
from barscreen.schemas import CANDLE_RESPONSE
from barscreen.sources.storage import file_order_fields

FIELDS = ["ts", *VALUES]
# Fixed value: the last whole second of a nanosecond clock that starts in 1970.
MAX_EPOCH_SECONDS = 9223372036


class Responses(NamedTuple):
    candles: DataFrame
    bad_series: DataFrame
    rejects: DataFrame | None = None


def read_candles(
    spark: SparkSession,
    path: str,
    windows: list[tuple[int, int]],
    as_of: Instant,
    unfinished: bool = False,
) -> DataFrame:
    """Bars of the candle table within the look-back of each `(interval_min, days_back)`.

    A bar that ends after `as_of` is left out unless `unfinished` asks for it.

    `sinks.write_candles` partitions by interval and day, so whole directories are skipped; within
    the files the bounds on `ts` reach the Parquet reader.
    """
    recent = clean_prices(lookback(spark.read.parquet(path), windows, as_of, unfinished))
    if "day" not in recent.columns:
        return recent
    end = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    listed = F.lit(False)
    for interval_min, days_back in windows:
        # A day more on either side, in case the writer's session had another time zone.
        first = (end - timedelta(days=days_back + 1)).date()
        final = (end + timedelta(days=1)).date()
        listed = listed | (
            (F.col("interval_min") == interval_min) & F.col("day").between(first, final)
        )
    return recent.where(listed).drop("day")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed candle responses, one JSON object per line; `landed` sorts them, later files last."""
    responses = spark.read.schema(CANDLE_RESPONSE).json(path)
    landed = F.struct(
        F.col("_metadata.file_modification_time").alias("at"), *file_order_fields()
    )
    return responses.select("*", landed.alias("landed"), F.col("_metadata.file_path").alias("file"))


def cell_number(cell: Column) -> Column:
    """A cell as a number; text that only a programming language takes for one is none."""
    text = cell.cast("string")
    return F.when(~text.rlike("[dDfF]$"), text.try_cast("double"))


def response_is_bad() -> Column:
    """No candle has all six fields, one has more, a cell is no number, or a time no epoch second."""
    widest = F.array_max(F.transform("candles", F.size))
    out_of_range = F.exists("candles", lambda c: F.abs(cell_number(F.get(c, 0))) > MAX_EPOCH_SECONDS)
    text = F.exists("candles", lambda c: F.exists(c, lambda x: x.isNotNull() & cell_number(x).isNull()))
    return (F.size("candles") > 0) & (
        (widest != len(FIELDS)) | F.coalesce(out_of_range, F.lit(False)) | F.coalesce(text, F.lit(False))
    )


def parse_responses(responses: DataFrame) -> Responses:
    """Candle rows of the good responses, the (symbol, interval_min) of the bad ones, and the rejects.

    Rejects are lines that could not be read: (file, record). One whose symbol could still be read is
    a bad series too.

    A response without candles has no rows. Candles shorter than the others have null fields.
    `ord` is the place in the response; `landed`, if the responses have it, the place among all
    landed candles. Candles without a time cannot be placed and are left out.
    """
    rejects = None
    unread = F.lit(False)
    if "_corrupt_record" in responses.columns:
        unread = F.col("_corrupt_record").isNotNull()
        # The symbol is looked at too, since Spark refuses to read nothing but unreadable records.
        rejects = responses.select("symbol", "file", F.col("_corrupt_record").alias("record"))
        rejects = rejects.where("record is not null and coalesce(symbol, '') >= ''")
    whole = responses.withColumn("candles", F.coalesce("candles", F.array())).withColumn(
        "bad", F.coalesce(response_is_bad(), F.lit(False)) | unread
    )
    bad_series = whole.where("bad and symbol is not null").select("symbol", "interval_min").distinct()
    kept = ["landed"] if "landed" in responses.columns else []
    rows = whole.where("not bad").select(
        "symbol", "interval_min", *kept, F.posexplode("candles").alias("ord", "candle")
    )
    field = {name: nan_to_null(cell_number(F.get("candle", i))) for i, name in enumerate(FIELDS)}
    candles = rows.select(
        "symbol",
        "interval_min",
        F.timestamp_seconds(field["ts"]).alias("ts"),
        *[field[v].alias(v) for v in VALUES if v != "volume"],
        field["volume"].try_cast("bigint").alias("volume"),
        "ord",
        *[F.struct("landed.*", "ord").alias("landed") for _ in kept],
    ).where(F.col("ts").isNotNull())
    return Responses(candles, bad_series, rejects)

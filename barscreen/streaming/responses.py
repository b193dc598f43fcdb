"""Landed candle responses as a stream: every response is parsed once, when its file first lands.

A batch is parsed into scratch storage, merged into the candle table, and its rejected lines and bad series
are written as version `<batch>` of their own tables. A batch that is repeated after a failure merges the same bars
into the same days and overwrites its own versions, so nothing changes. Where a history table is kept, it follows in the same batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barscreen.schemas import CANDLE_RESPONSE
from barscreen.sources.candles import parse_responses
from barscreen.sources.history import update_history
from barscreen.sources.sinks import write_candles
from barscreen.sources.storage import committed_versions, shared_dir, version_path


def stream_responses(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Response lines of files as they land, with the place of each file."""
    reader = spark.readStream.schema(CANDLE_RESPONSE)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    meta = F.col("_metadata")
    return reader.json(path).select(
        "*",
        meta["file_modification_time"].alias("at"),
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("block"),
    )


def rejects_root(out: str) -> str:
    return f"{out.rstrip('/')}/rejects"


def bad_series_root(out: str) -> str:
    return f"{out.rstrip('/')}/bad_series"


def read_rejects(spark: SparkSession, out: str) -> DataFrame:
    """(symbol, file, record) of every line that could not be read."""
    return _all_versions(spark, rejects_root(out))


def read_bad_series(spark: SparkSession, out: str) -> DataFrame:
    """(symbol, interval_min) of the series that any response was bad for."""
    return _all_versions(spark, bad_series_root(out)).distinct()


def _all_versions(spark: SparkSession, root: str) -> DataFrame:
    paths = [version_path(root, v) for v in committed_versions(spark, root)]
    if not paths:
        raise ValueError(f"no responses have landed in {root}")
    return spark.read.parquet(*paths)


def start_response_stream(
    responses: DataFrame, candles: str, out: str, checkpoint: str, history: str | None = None, **trigger
) -> StreamingQuery:
    """Merge responses into the candle table `candles`; rejects and bad series go below `out`.

    Of several candles of one bar the one stands whose response landed last.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        staged = shared_dir(spark, "landed-responses")
        landed = F.struct("at", "file", "block", F.monotonically_increasing_id().alias("row"))
        batch.withColumn("landed", landed).drop("at", "block").write.parquet(staged)
        parsed = parse_responses(spark.read.parquet(staged))
        write_candles(parsed.candles, candles, landed="landed")
        if history is not None:
            update_history(spark, candles, history, parsed.candles)
        parsed.rejects.write.mode("overwrite").parquet(version_path(rejects_root(out), batch_id))
        parsed.bad_series.write.mode("overwrite").parquet(version_path(bad_series_root(out), batch_id))

    writer = responses.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()

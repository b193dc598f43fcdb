"""Rolling signals over a stream of closed bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barscreen.operators.signals import (
    BACKWARD,
    BREAK_LOOKBACK,
    SERIES,
    signal_columns,
    with_neighbours,
)
from barscreen.sources.storage import committed_versions, drop_versions, version_path

BAR = [*SERIES, "ts", "open", "high", "low", "close", "volume"]
KEPT_VERSIONS = 3


def recent_bars(bars: DataFrame, n: int = BREAK_LOOKBACK) -> DataFrame:
    """The last `n` bars of every series."""
    newest_first = W.partitionBy(*SERIES).orderBy(F.desc("ts"))
    ranked = bars.withColumn("_rn", F.row_number().over(newest_first))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


def signals_of_batch(batch: DataFrame, recent: DataFrame | None) -> DataFrame:
    """The new bars with their signals, given the last bars before them."""
    rows = batch.select(*BAR, F.lit(True).alias("is_new"))
    if recent is not None:
        rows = rows.unionByName(recent.select(*BAR, F.lit(False).alias("is_new")))
    return (
        with_neighbours(rows, names=BACKWARD)
        .where("is_new")
        .select(*BAR, *[col.alias(name) for name, col in signal_columns().items()])
    )


def start_signal_stream(bars: DataFrame, out: str, state: str, checkpoint: str,
                        **trigger) -> StreamingQuery:
    """Write every new bar with its signals to `out/version=<batch>`.

    The last five bars of each series are kept in `state/version=<batch>`. A batch reads the state
    of an earlier batch and overwrites its own two directories, so a repeated batch after a failure
    gives the same result.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        known = [v for v in committed_versions(spark, state) if v < batch_id]
        begun = any(v < batch_id for v in committed_versions(spark, out))
        if begun and (not known or known[-1] != batch_id - 1):
            raise RuntimeError(f"the state below {state} that batch {batch_id} needs is gone")
        recent = spark.read.parquet(version_path(state, known[-1])) if known else None
        written = version_path(out, batch_id)
        signals_of_batch(batch, recent).write.mode("overwrite").parquet(written)
        # Read back what was written, so that the stream's own state is evaluated once per batch.
        bars_now = spark.read.parquet(written).select(*BAR)
        if recent is not None:
            bars_now = bars_now.unionByName(recent)
        recent_bars(bars_now).write.mode("overwrite").parquet(version_path(state, batch_id))
        drop_versions(spark, state, batch_id - KEPT_VERSIONS)

    writer = bars.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()

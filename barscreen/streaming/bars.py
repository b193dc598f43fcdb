"""Ticks to closed bars on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barscreen.functions.instants import Instant, instant
from barscreen.operators.candles import KEYS, VALUES, ohlcv, resample_ticks
from barscreen.sources.barstates import land_ticks


def stream_bars(
    ticks: DataFrame, interval_min: int, delay: str = "1 hour", offset_minutes: int = 0
) -> DataFrame:
    """Tumbling OHLCV bars; use append mode, which emits a bar once the watermark has passed it.

    Bars follow the wall clock of the session's zone, as in `resample_ticks`: event times are shifted
    by the zone's offset, which a watermark can follow, and back again. Where clocks are set back,
    `delay` must exceed the step. State is one row per (symbol, open bar). Ticks later than `delay`
    are not in the bars; `missed_bars` finds the bars that these touch.
    """
    zone = ticks.sparkSession.conf.get("spark.sql.session.timeZone")
    bar = F.window("wall", f"{interval_min} minutes", startTime=f"{offset_minutes} minutes")
    return (
        ticks.withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("wall", F.from_utc_timestamp("ts", zone))
        .withWatermark("wall", delay)
        .groupBy("symbol", bar.alias("bar"))
        .agg(*ohlcv())
        .select("symbol", F.lit(interval_min).alias("interval_min"),
                F.to_utc_timestamp("bar.start", zone).alias("ts"), *VALUES)
    )


def start_bar_state_stream(
    ticks: DataFrame, root: str, checkpoint: str, interval_min: int, offset_minutes: int = 0, **trigger
) -> StreamingQuery:
    """Land every batch of ticks as bar states in `root`, however late its ticks are.

    There is no watermark and no state: a batch writes the states of its own ticks as version `<batch>`, and
    readers merge them. `sources.barstates.touched_states` gives the bars to land in the candle table
    after a batch; its cost follows the batch. `missed_bars` finds the same by reading all ticks again.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        land_ticks(batch, root, batch_id, interval_min, offset_minutes)

    writer = ticks.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def missed_bars(
    ticks: DataFrame, streamed: DataFrame, interval_min: int, up_to: Instant, offset_minutes: int = 0
) -> DataFrame:
    """Bars that ended by `up_to` and that the stream lacks or made without ticks that came late.

    `ticks` are all landed ticks, `streamed` what the stream wrote. Landed with `write_candles`, these
    bars replace the streamed ones, and the table equals that of a batch over all ticks.
    """
    bars = resample_ticks(ticks, interval_min, offset_minutes)
    end = F.col("ts") + F.make_dt_interval(mins=F.lit(interval_min))
    ended = bars.where(end <= instant(up_to, bars.schema["ts"].dataType))
    same = [ended[c].eqNullSafe(streamed[c]) for c in [*KEYS, *VALUES]]
    return ended.join(streamed, same, "left_anti")

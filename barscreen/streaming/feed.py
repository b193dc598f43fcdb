"""Repeated polls of the announcement feed as a stream of new announcements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barscreen.operators.news import classify, shape_items
from barscreen.sources.feed import is_readable, item_fields, split_documents
from barscreen.sources.keyindex import unseen
from barscreen.sources.storage import version_path


def stream_feed(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Items of documents as they land; a broken item is left out, `read_feed_rejects` lists it."""
    reader = spark.readStream
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    documents = reader.text(path, wholetext=True).select(F.col("_metadata.file_modification_time").alias("landed_at"), "value")
    return split_documents(documents).where(is_readable()).select(*item_fields(), "landed_at")


KEY = ["link", "title", "date"]


def announcements_of(items: DataFrame) -> DataFrame:
    """Landed items shaped and classified, with `landed_at`."""
    order = F.lit(None).cast("bigint").alias("feed_ord")
    landed = items.select(order, "title", "link", "pubDate", "landed_at")
    return classify(shape_items(landed, ["landed_at"])).drop("feed_ord")


def start_announcement_stream(
    items: DataFrame, out: str, checkpoint: str, merge_every: int = 16, bucket_keys: int = 50_000, **trigger
) -> StreamingQuery:
    """Write every announcement once, when it first lands, to `out/version=<batch>`.

    An announcement is what has the same link, title and date; how old its date is plays no part.
    Each batch is compared with the keys of all announcements written before it, so a poll may repeat
    an item after any time. The keys lie in an index in `out/_keys`, so a batch reads what its own keys' buckets hold and the
    batches since the last merge. A repeated batch overwrites its own folder and gives the same rows.
    """
    index = f"{out.rstrip('/')}/_keys"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        first = F.min_by(F.struct(*[c for c in batch.columns if c not in KEY]), "landed_at").alias("first")
        polled = batch.groupBy(*KEY).agg(first).select(*KEY, "first.*").persist()
        new = unseen(polled, KEY, out, index, batch_id, merge_every, bucket_keys)
        new.select(*batch.columns).write.mode("overwrite").parquet(version_path(out, batch_id))
        polled.unpersist()

    writer = announcements_of(items).writeStream.foreachBatch(write_batch)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()

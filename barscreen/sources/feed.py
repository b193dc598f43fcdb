"""Landed announcement feeds (RSS documents), what of them cannot be read, and when they landed first.

A document is read as text and cut where an item begins; each item is parsed for itself. So a broken item costs
itself alone: the items after it are read, and it is listed in the rejects with its document. A document that does not end
with a closing tag was cut off; it is listed too.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.functions.instants import Instant, instant
from barscreen.schemas import FEED_ITEM
from barscreen.sources.storage import committed_versions, next_version, version_path

ROW_TAG = "item"
#: In front of every item.
ITEM_BEGIN = rf"(?=<{ROW_TAG}[\s>])"
#: What follows `</` at the end of a whole document: the closing tag of something other than an item.
DOCUMENT_END = rf"^(?!{ROW_TAG}>)[^<>/]+>\s*$"


def split_documents(documents: DataFrame) -> DataFrame:
    """Documents with their text in `value`, as one row per item: `pos`, `record` and the parsed `item`.

    A document that was cut off has one more row, without an item, for its last characters.
    """
    # The closing tag that a whole document ends with is the last one.
    ended = F.col("value").contains("</") & F.substring_index("value", "</", -1).rlike(DOCUMENT_END)
    cut = F.when(~ended, F.right("value", F.lit(200)))
    begins = F.substring("value", 1, len(ROW_TAG) + 2).rlike(rf"^<{ROW_TAG}[\s>]")
    # Place 0 is the end of a document that was cut off, place 1 what stands before the first item, if anything.
    every = F.posexplode(F.concat(F.array(cut), F.split("value", ITEM_BEGIN))).alias("place", "record")
    rows = documents.withColumn("begins", begins).select(*[c for c in documents.columns if c != "value"], "begins", every)
    place = F.col("place")
    rows = rows.where(F.col("record").isNotNull() & ((place != 1) | F.col("begins")))
    pos = F.when(place == 0, 0).otherwise(place - 1 + F.col("begins").cast("int"))
    rows = rows.withColumns({"pos": pos, "is_item": place > 0}).drop("begins", "place")
    # A document is cut by one task; its items are parsed by many, and once: as a generator's output the parsed
    # item is neither evaluated again for a filter on it, nor is that filter moved in front of the exchange.
    rows = rows.repartition("pos")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FEED_ITEM) + ", _corrupt_record string"
    parsed = F.from_xml("record", F.lit(schema), {"rowTag": ROW_TAG})
    return rows.withColumn("item", F.explode(F.array(F.when(F.col("is_item"), parsed))))


def is_readable() -> Column:
    return F.col("is_item") & F.col("item").isNotNull() & F.col("item._corrupt_record").isNull()


def item_fields() -> list[Column]:
    return [F.col(f"item.{f.name}").alias(f.name) for f in FEED_ITEM]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, landed_at, value) of every landed document; `landed_at` is the file's time."""
    documents = spark.read.text(path, wholetext=True)
    return documents.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("landed_at"), "value"
    )


def _as_of(documents: DataFrame, listed: DataFrame, as_of: Instant, since: timedelta) -> DataFrame:
    """The newest of `documents` landed by then, and those that landed up to `since` before it; `listed` are their times."""
    known = listed.where(F.col("landed_at") <= instant(as_of))
    newest = known.agg(F.unix_micros(F.max("landed_at")).alias("at")).first()["at"] or 0
    low = newest - since // timedelta(microseconds=1)
    return documents.where(
        (F.col("landed_at") >= F.timestamp_micros(F.lit(low))) & (F.col("landed_at") <= F.timestamp_micros(F.lit(newest)))
    )


def read_feed(
    spark: SparkSession,
    path: str,
    as_of: Instant | None = None,
    since: timedelta = timedelta(0),
    ledger: str | None = None,
) -> DataFrame:
    """Items of the landed documents with their order: latest document first, then as written.

    With `as_of`, the news of that moment: the newest document landed by then, and those that landed
    up to `since` before it. When a document landed is told by the ledger, brought up to date with `update_ledger`, and
    without one by the time of its file, which copying changes. Without a ledger other files are not opened.
    """
    if ledger is not None:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        seen = _seen(spark, ledger, path, listed)
        documents = read_documents(spark, path).drop("landed_at").join(seen.select("file", "landed_at"), "file")
    else:
        documents = read_documents(spark, path)
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        seen = listed.select(F.col("modificationTime").alias("landed_at"))
    if as_of is not None:
        documents = _as_of(documents, seen, as_of, since)
    items = split_documents(documents).where(is_readable())
    newest_first = (-F.unix_micros("landed_at")).alias("landed")
    return items.select(F.struct(newest_first, "file", "pos").alias("feed_ord"), *item_fields())


def read_feed_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, record) of the items that could not be read; `pos` 0 and the last characters for documents that were cut off."""
    rows = split_documents(read_documents(spark, path)).where(~is_readable())
    return rows.select("file", "pos", "record")


# The ledger -----------------------------------------------------------------------------------

LEDGER = "document string, size bigint, modified timestamp, digest string, landed_at timestamp"


def _documents(path: str, listed: DataFrame) -> DataFrame:
    """Listed files with their place below the landing folder, which stays when the folder is copied."""
    root = listed.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(listed.sparkSession._jsc.hadoopConfiguration())
    base = fs.getFileStatus(root).getPath().toString().rstrip("/") + "/"
    below = F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))
    return listed.select(
        F.col("path").alias("file"), below.alias("document"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content"
    )


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    versions = committed_versions(spark, ledger)
    if not versions:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(*[version_path(ledger, v) for v in versions])


def update_ledger(spark: SparkSession, path: str, ledger: str) -> None:
    """Enter the documents below `path` that the ledger has not seen, with the time at which they landed.

    A document is its place below `path` and its content. Files are opened only where size or time differ from those
    seen before. A copy with another time is entered as seen, with the landing time of its first sight. A crashed
    update leaves an uncommitted version that nobody reads.
    """
    listed = _documents(path, spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
    held = read_ledger(spark, ledger)
    new = listed.join(held.select("document", "size", "modified"), ["document", "size", "modified"], "left_anti")
    new = new.withColumn("digest", F.sha2("content", 256)).drop("content", "file")
    first = held.groupBy("document", "digest").agg(F.min("landed_at").alias("landed_at"))
    new = new.join(first, ["document", "digest"], "left").withColumn("landed_at", F.coalesce("landed_at", "modified"))
    new = new.select("document", "size", "modified", "digest", "landed_at")
    new.write.mode("overwrite").parquet(version_path(ledger, next_version(spark, ledger)))


def _seen(spark: SparkSession, ledger: str, path: str, listed: DataFrame) -> DataFrame:
    """(file, landed_at) of the files below `path`; one that the ledger lacks is an error."""
    key = ["document", "size", "modified"]
    held = read_ledger(spark, ledger).groupBy(*key).agg(F.min("landed_at").alias("landed_at"))
    seen = _documents(path, listed.drop("content").withColumn("content", F.lit(None))).join(held, key, "left")
    lacking = seen.where("landed_at is null").select("document").head(1)
    if lacking:
        raise ValueError(f"{lacking[0].document} is not in the ledger {ledger}; update it first")
    return seen.select("file", "landed_at")

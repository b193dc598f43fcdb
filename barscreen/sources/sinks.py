"""Writers of the validated table, the candle table, the company master and the shortlist."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barscreen.functions.instants import utc_day
from barscreen.operators.master import incoming_companies, upsert
from barscreen.operators.candles import KEYS, VALUES
from barscreen.schemas import MASTER, REQUIRED_HEADERS, snake
from barscreen.sources.storage import (
    committed_versions,
    drop_versions,
    next_version,
    shared_dir,
    version_path,
)

HELPERS = ["ord", "non_numeric", "unparsed_dates"]


def write_validated(frame: DataFrame, path: str, csv_path: str | None = None) -> None:
    """Overwrite the validated table, row order included; optionally a CSV copy without it.

    The copy has the headers of the landed file, so `read_fundamentals` reads it again.
    """
    frame.write.mode("overwrite").parquet(path)
    if csv_path is not None:
        stored = frame.sparkSession.read.parquet(path)
        headers = {snake(h): h for h in REQUIRED_HEADERS}
        # A place is ordered by its fields, which is faster than as a whole.
        place = stored.schema["ord"].dataType
        order = [f"ord.{name}" for name in place.names] if isinstance(place, T.StructType) else ["ord"]
        named = stored.orderBy(*order).drop(*HELPERS)
        named = named.toDF(*[headers.get(c, c) for c in named.columns])
        named.write.mode("overwrite").csv(csv_path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss", escape='"')


def write_candles(bars: DataFrame, path: str, landed: str | None = None) -> None:
    """Land bars in the candle table: one bar per (symbol, interval, time), the last landed standing.

    Only the days that `bars` touch are rewritten, merged with what they hold; all others stay. Name
    the landing order in `landed` where a bar may occur twice in `bars`; without it the choice among
    such bars is by their values. Days are those of UTC, whatever the session's zone. The merged days
    go to scratch storage first, since a day cannot be overwritten while it is read. The rebalance
    hint merges small days and splits large ones.
    """
    write_by_day(bars, path, VALUES, landed)


def write_by_day(bars: DataFrame, path: str, columns: list[str], landed: str | None = None) -> None:
    """`write_candles` for any `columns` that belong to a bar."""
    spark = bars.sparkSession
    values = F.struct(*columns)
    order = F.struct(F.lit(1), F.col(landed) if landed else F.lit(0), values)
    new = bars.select(*KEYS, values.alias("bar"), order.alias("place"))
    new = new.groupBy(*KEYS).agg(F.max_by("bar", "place").alias("bar")).withColumn("day", utc_day(F.col("ts")))
    staged = shared_dir(spark, "candles-new")
    new.write.parquet(staged)
    new = spark.read.parquet(staged)
    if table_exists(spark, path):
        held = spark.read.parquet(path).join(new.select("interval_min", "day").distinct(), ["interval_min", "day"], "left_semi")
        held = held.select(*KEYS, values.alias("bar"), "day", F.lit(0).alias("turn"))
        both = held.unionByName(new.withColumn("turn", F.lit(1)))
        merged = shared_dir(spark, "candles-merged")
        both.groupBy(*KEYS, "day").agg(F.max_by("bar", "turn").alias("bar")).write.parquet(merged)
        new = spark.read.parquet(merged)
    (
        new.select(*KEYS, "bar.*", "day")
        .hint("rebalance", "interval_min", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("interval_min", "day")
        .parquet(path)
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to `path`; an empty one has no partition to read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(root) and any(s.isDirectory() for s in fs.listStatus(root))


def read_master(spark: SparkSession, root: str) -> DataFrame:
    """The latest committed company master; empty before the first write."""
    versions = committed_versions(spark, root)
    if not versions:
        return spark.createDataFrame([], MASTER)
    return spark.read.schema(MASTER).parquet(version_path(root, versions[-1]))


def update_master(fundamentals: DataFrame, root: str, keep: int | None = None) -> DataFrame:
    """Upsert the fundamentals rows into the master below `root` and return the new master.

    A table cannot be overwritten while it is read, so every update is a new version directory.
    Its `_SUCCESS` marker commits it; a second writer of the same version fails, and what a crashed
    write left is passed over. With `keep` only so many committed versions stay.
    """
    spark = fundamentals.sparkSession
    merged = upsert(read_master(spark, root), incoming_companies(fundamentals))
    merged.write.mode("error").parquet(version_path(root, next_version(spark, root)))
    if keep is not None:
        versions = committed_versions(spark, root)
        drop_versions(spark, root, below=versions[-min(keep, len(versions))])
    return read_master(spark, root)


def shortlist_lines(shortlist: DataFrame) -> Iterator[str]:
    """The report lines in symbol order, fetched partition by partition."""
    for row in shortlist.select("ord", "line").orderBy("ord").toLocalIterator():
        yield row["line"]

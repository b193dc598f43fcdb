"""An index of the keys seen so far, in hash buckets, for streams that write each key once.

The keys of a table whose batches are versions (`version=<batch>`) are merged into buckets every few batches. A
bucket is the first bits of the key's hash; a merge reads and writes anew only the buckets that its keys fall into. The
manifest of a merge names for each bucket the merge that wrote it last, and its commit makes the merge valid; a crashed
merge leaves files that no manifest names and that the next attempt overwrites. Buckets become finer as keys grow, so a
bucket holds about `bucket_keys` at most, and what a batch reads does not depend on how much came before it: the
buckets of its own keys and the batches since the last merge.

The index holds nothing that the table does not; where it is missing, the next merge makes it from all batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.sources.storage import committed_versions, delete_path, is_committed, version_path

#: Buckets at first, as bits of the hash, and the bits that are added when they hold too much.
FIRST_BITS = 4
STEP_BITS = 2
MANIFEST = "bits int, bucket bigint, version int, n_keys bigint"


def bucket_of(key: list[str], bits: int) -> Column:
    """The first `bits` bits of the key's hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - bits)


def _manifests(index: str) -> str:
    return f"{index}/manifest"


def _bucket_path(index: str, version: int, bucket: int | None = None) -> str:
    root = version_path(f"{index}/keys", version)
    return root if bucket is None else f"{root}/bucket={bucket}"


def _manifest(spark: SparkSession, index: str, before: int) -> tuple[int, int, DataFrame]:
    """Last batch merged, bits and manifest of the newest merge of batches below `before`; -1 where there is none."""
    found = [v for v in committed_versions(spark, _manifests(index)) if v < before]
    if not found:
        return -1, FIRST_BITS, spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(version_path(_manifests(index), found[-1]))
    first = rows.first()
    return found[-1], first.bits if first else FIRST_BITS, rows


def _batches(spark: SparkSession, table: str, after: int, before: int) -> list[str]:
    """Committed batches between the two; each is asked for by name, so older ones cost nothing."""
    return [version_path(table, v) for v in range(after + 1, before) if is_committed(spark, version_path(table, v))]


def unseen(rows: DataFrame, key: list[str], table: str, index: str, batch: int, merge_every: int = 16, bucket_keys: int = 50_000) -> DataFrame:
    """The `rows` whose key no batch of `table` below `batch` holds. Keys are without nulls.

    `rows` is read twice, so persist what is costly. Batches below `batch` are taken as final, as a stream's are; a batch that is
    repeated compares with those below it only, since merges leave out the batch at work.
    """
    spark = rows.sparkSession
    merged, bits, manifest = _manifest(spark, index, batch)
    recent = _batches(spark, table, merged, batch)
    if len(recent) >= merge_every:
        merge(spark, key, table, index, batch, bucket_keys)
        merged, bits, manifest = _manifest(spark, index, batch)
        recent = []
    if recent:
        rows = rows.join(spark.read.parquet(*recent).select(*key), key, "left_anti")
    # At most one row a bucket, and at most one a key of the batch.
    touched = rows.select(bucket_of(key, bits).alias("bucket")).distinct()
    held = [_bucket_path(index, r.version, r.bucket) for r in manifest.join(touched, "bucket").collect()]
    if held:
        rows = rows.join(spark.read.parquet(*held).select(*key), key, "left_anti")
    return rows


def merge(spark: SparkSession, key: list[str], table: str, index: str, before: int, bucket_keys: int = 50_000) -> None:
    """Enter the keys of all batches of `table` below `before`."""
    merged, bits, manifest = _manifest(spark, index, before)
    version = before - 1
    recent = _batches(spark, table, merged, before)
    if not recent:
        return
    new = spark.read.parquet(*recent).select(*key)
    total = (manifest.agg(F.sum("n_keys").alias("n")).first().n or 0) + new.count()
    finer = bits
    while total > bucket_keys << finer:
        finer += STEP_BITS
    touched = new.select(bucket_of(key, bits).alias("bucket")).distinct()
    # Finer buckets are made from all keys; that happens once for four times as many keys.
    rewritten = manifest if finer > bits else manifest.join(touched, "bucket", "left_semi")
    held = [_bucket_path(index, r.version, r.bucket) for r in rewritten.collect()]
    keys = new.unionByName(spark.read.parquet(*held).select(*key)) if held else new
    out = _bucket_path(index, version)
    keys = keys.withColumn("bucket", bucket_of(key, finer))
    keys.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)

    stored = spark.read.schema(keys.schema).parquet(out)
    counts = stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_keys"))
    written = counts.select(F.lit(finer).alias("bits"), "bucket", F.lit(version).alias("version"), "n_keys")
    kept = manifest.limit(0) if finer > bits else manifest.join(touched, "bucket", "left_anti").select(*written.columns)
    written.unionByName(kept).write.mode("overwrite").parquet(version_path(_manifests(index), version))
    _drop_old(spark, index)


def _drop_old(spark: SparkSession, index: str) -> None:
    """Delete manifests older than the last two, and the buckets that only they name."""
    versions = committed_versions(spark, _manifests(index))
    if len(versions) < 3:
        return
    kept = spark.read.schema(MANIFEST).parquet(*[version_path(_manifests(index), v) for v in versions[-2:]])
    for old in versions[:-2]:
        path = version_path(_manifests(index), old)
        gone = spark.read.schema(MANIFEST).parquet(path).join(kept, ["bucket", "version"], "left_anti")
        for row in gone.select("bucket", "version").collect():
            delete_path(spark, _bucket_path(index, row.version, row.bucket))
        delete_path(spark, path)

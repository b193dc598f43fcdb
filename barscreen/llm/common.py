"""What several of the text operators share: scratch tables, components, words, document batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.sources.storage import shared_dir

#: ASCII white space, as the contracts of the operators define it.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: the lineage ends at files all executors see."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(id_column: str | Column, modulus: int) -> Column:
    """CRC-32 of an id's decimal text, modulo `modulus`; a null id counts as empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected `links`: (node, component), component the smallest node.

    Alternates the large-star and small-star steps: every node tells its larger (then its smaller)
    neighbours of the smallest node it knows, until the links no longer change. Each step is one
    aggregation and one join on the node, so a hub's links are never gathered in one group. Each
    round's links are written to the shared folder. Nodes without a link to another are not returned.
    """
    pairs = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    pairs = stored(pairs.where("low < high").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = pairs.union(pairs.select("high", "low")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high"))
        large = large.where("low < high").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high").select(F.col("m").alias("low"), F.col("low").alias("high"))
        small = small.union(least.select("m", "high")).where("low < high").distinct()
        pairs = stored(small, "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        pairs.select("low", "low").distinct()
    )


def text_batches(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = 4 << 20) -> Iterator[tuple]:
    """(batch, texts as bytes) with about `most` bytes of text each; a null text counts as empty."""
    for batch in batches:
        sizes = np.diff(_offsets(batch.column(column)))
        begin = 0
        while begin < batch.num_rows:
            end, total = begin, 0
            while end < batch.num_rows and (end == begin or total + sizes[end] <= most):
                total += sizes[end]
                end += 1
            part = batch.slice(begin, end - begin)
            yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]
            begin = end


def _offsets(strings: pa.Array) -> np.ndarray:
    lengths = pa.compute.binary_length(strings).fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)])


#: What a worker keeps from one task of a job to the next: the job's mark and its caches.
_KEPT: list = ["", None]


def kept(mark: str, make):
    """The caches of the job `mark`, made once per worker; those of any other job are let go first."""
    if _KEPT[0] != mark:
        _KEPT[:] = ["", None]
        pa.default_memory_pool().release_unused()
        _KEPT[:] = [mark, make()]
    return _KEPT[1]


class Numbered:
    """Numbers for words, given as they first appear; all forgotten once `most` are known.

    A worker's own cache: `values` holds one row per known word, computed once by
    `compute(words, first)`; `first` tells that all earlier words were forgotten.
    """

    def __init__(self, compute, most: int = 400_000, most_bytes: int = 1 << 25):
        self.compute, self.most, self.most_bytes = compute, most, most_bytes
        self.ids: dict[bytes, int] = {}
        self.bytes = 0
        self.values: np.ndarray | None = None

    def of(self, words: list[bytes]) -> np.ndarray:
        """Index of each word into `values`, which is grown first where needed."""
        found = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if len(self.ids) > self.most or self.bytes > self.most_bytes:
                self.ids, self.bytes, missing = {}, 0, np.arange(len(words))
            ids, base = self.ids, len(self.ids)
            unknown = [words[k] for k in missing.tolist()]
            new = list(dict.fromkeys(unknown))
            rows = self.compute(new, base == 0)
            ids.update(zip(new, range(base, base + len(new))))
            self.bytes += sum(map(len, new))
            if self.values is None or base + len(new) > len(self.values):
                grown = np.zeros((max(1024, 2 * (base + len(new))), *rows.shape[1:]), rows.dtype)
                grown[:base] = self.values[:base] if base else 0
                self.values = grown
            self.values[base : base + len(new)] = rows
            found[missing] = np.fromiter(map(ids.__getitem__, unknown), np.int64, len(unknown))
        return found

"""A table of bar states that grows by increments.

Every landing of ticks writes the states of those ticks alone, as version `n` below the table; no tick or
state that landed before is read. A landing that is repeated overwrites its own version, so it counts once.
Readers merge the versions. `compact` replaces all versions up to one by a single base, which bounds what readers merge.
States lie by interval and (UTC) day, so a read of some days, or of the bars that a landing touched, skips all other folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.functions.instants import utc_day
from barscreen.operators.barstates import bar_states, merge_states
from barscreen.operators.candles import KEYS
from barscreen.sources.storage import committed_versions, drop_versions, version_path

PLACE = ["interval_min", "day"]


def _base(root: str) -> str:
    return f"{root.rstrip('/')}/base"


def _increments(root: str) -> str:
    return f"{root.rstrip('/')}/landed"


def _write(states: DataFrame, path: str) -> None:
    placed = states.withColumn("day", utc_day(F.col("ts")))
    placed.hint("rebalance", *PLACE).write.mode("overwrite").partitionBy(*PLACE).parquet(path)


def land_ticks(ticks: DataFrame, root: str, version: int, interval_min: int, offset_minutes: int = 0) -> None:
    """Write the states of newly landed ticks as version `version`; a repeated landing overwrites it.

    A version that a base already holds is not written again: its landing was done.
    """
    bases = committed_versions(ticks.sparkSession, _base(root))
    if not bases or version > bases[-1]:
        _write(bar_states(ticks, interval_min, offset_minutes), version_path(_increments(root), version))


def _landed(spark: SparkSession, root: str) -> dict[int, str]:
    """Paths whose union is the table: the newest base and the versions after it, by their number."""
    bases = committed_versions(spark, _base(root))[-1:]
    paths = {n: version_path(_base(root), n) for n in bases}
    after = [n for n in committed_versions(spark, _increments(root)) if not bases or n > bases[0]]
    return paths | {n: version_path(_increments(root), n) for n in after}


def _read(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The states in some versions; those without any row have no file to read."""
    found = None
    for path in paths:
        part = spark.read.parquet(path) if _has_rows(spark, path) else None
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return found


def _has_rows(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return any(s.isDirectory() for s in fs.listStatus(folder))


def read_states(spark: SparkSession, root: str) -> DataFrame:
    """One merged state per bar, with its `day`; filters on `interval_min` and `day` prune folders."""
    found = _read(spark, list(_landed(spark, root).values()))
    if found is None:
        raise ValueError(f"no ticks have landed in {root}")
    return _merged(found)


def _merged(states: DataFrame) -> DataFrame:
    """The day follows from the bar's time; as a key it lets filters on it reach the scan."""
    return merge_states(states, [*KEYS, "day"])


def touched_states(spark: SparkSession, root: str, after: int) -> DataFrame | None:
    """Merged states of the bars that versions later than `after` touched; None where there are none.

    Only the folders of days in which such bars lie are read of the rest.
    """
    paths = _landed(spark, root)
    new = _read(spark, [p for n, p in paths.items() if n > after])
    if new is None:
        return None
    days = [r.day for r in new.select("day").distinct().collect()]  # a row a day
    bars = new.select(*KEYS, "day").distinct()
    every = _read(spark, list(paths.values())).where(F.col("day").isin(days))
    return _merged(every.join(bars, [*KEYS, "day"], "left_semi"))


def compact(spark: SparkSession, root: str, up_to: int) -> None:
    """Merge all versions up to `up_to`, which are complete, into one base and drop them.

    The base is committed before anything is dropped; what a crash leaves behind is passed over by
    readers and dropped by the next call.
    """
    paths = {n: p for n, p in _landed(spark, root).items() if n <= up_to}
    if len(paths) > 1:
        states = _read(spark, list(paths.values()))
        if states is not None:
            _write(_merged(states).drop("day"), version_path(_base(root), max(paths)))
    bases = committed_versions(spark, _base(root))
    if bases:
        drop_versions(spark, _base(root), bases[-1])
        drop_versions(spark, _increments(root), bases[-1] + 1)

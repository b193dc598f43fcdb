"""Paths on the session's file system: shared scratch space and versioned directories."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VERSION = "version="


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder path below the cluster's checkpoint folder.

    A machine-local folder is used only where the session names none and runs on one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors see, for {name}")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_order_fields() -> list[Column]:
    """Sortable place of a row among the rows of its source: file, block, row.

    The row number depends on how the files are split, so persist it before using it twice.
    """
    return [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ]


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def next_version(spark: SparkSession, root: str) -> int:
    """A number above that of every version folder, also of one that a crashed write left behind."""
    return max(_versions(spark, root, committed=False), default=0) + 1


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions below `root` whose write was committed, ascending."""
    return _versions(spark, root, committed=True)


def _versions(spark: SparkSession, root: str, committed: bool) -> list[int]:
    fs, path = _file_system(spark, root)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(VERSION) and (not committed or fs.exists(done)):
            found.append(int(name[len(VERSION):]))
    return sorted(found)


def is_committed(spark: SparkSession, path: str) -> bool:
    fs, folder = _file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(folder)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, folder = _file_system(spark, path)
    fs.delete(folder, True)


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/{VERSION}{version:08d}"


def drop_versions(spark: SparkSession, root: str, below: int) -> None:
    """Delete the versions of `root` that are older than `below`."""
    for version in committed_versions(spark, root):
        if version < below:
            delete_path(spark, version_path(root, version))

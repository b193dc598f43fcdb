"""The submitter's session for runs, and a local one for tests and the bench.

`running_session` sets nothing: master, shuffle partitions, memory, time zone and checkpoint folder are
those of the submitter or of the session that runs already. Every operator works on any session.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def running_session(app_name: str = "barscreen") -> SparkSession:
    """The session of this process, or a new one with the submitter's settings."""
    return SparkSession.builder.appName(app_name).getOrCreate()


def build_session(app_name: str = "barscreen", cores: int | None = None) -> SparkSession:
    """A local session with the settings the operators are tested with."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.appName(app_name)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("BARSCREEN_DRIVER_MEMORY", "8g"))
        # Call sites are recorded per column otherwise, at several gateway calls each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

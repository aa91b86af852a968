"""Session defaults shared by scripts, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A panel already partitioned by symbol joins (symbol, date) tables without
    # being shuffled again; symbols hold at most one row per day, so the coarser
    # key stays balanced.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(app: str = "eventlab", cores: int | None = None) -> SparkSession:
    """A session with the defaults above.

    ``cores`` asks for local mode. Without it the master comes from spark-submit,
    and the number of shuffle partitions is left to the cluster's own settings.
    """
    builder = SparkSession.builder.appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
            .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="eventlab-"))
        )
    return builder.getOrCreate()

"""Places for intermediate tables: shared storage on a cluster, a temp folder in local mode."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_local_base: list[str] = []


def scratch_base(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder, with a warning; on a cluster that
    is an error, because executors could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if not _local_base:
        warnings.warn("spark.checkpoint.dir is not set: intermediate tables go to a temporary folder", stacklevel=2)
        _local_base.append(tempfile.mkdtemp(prefix="eventlab-"))
    return _local_base[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A path nobody else uses."""
    return f"{scratch_base(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """The table, written as Parquet to the session's shared folder and read again.

    It cuts the lineage like a checkpoint and survives lost executors like one, but keeps columns
    apart and statistics, by which later joins are planned.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

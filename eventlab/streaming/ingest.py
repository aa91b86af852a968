"""Incremental ingestion with file-source streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest_new_files(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: T.StructType,
    file_format: str = "parquet",
    options: dict | None = None,
) -> None:
    """Append the rows of files not ingested yet, then stop.

    The checkpoint remembers finished files, so a repeated or interrupted run neither
    skips nor repeats one. Folder and checkpoint must be on shared storage.
    """
    stream = spark.readStream.format(file_format).schema(schema).options(**(options or {})).load(source)
    (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def ingest_price_files(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """As above for ``<symbol>.csv`` price files, with the symbol taken from the file name."""
    from ..schemas import RAW_PRICES

    stem = F.regexp_replace(F.col("_metadata.file_name"), "[.]csv$", "")
    stream = spark.readStream.schema(RAW_PRICES).option("header", True).csv(source).withColumn("symbol", stem)
    (
        stream.where(F.col("date").isNotNull())
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )

"""Earnings calendars, metadata, memberships and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_ticker, nan_to_null
from ..schemas import MEMBERSHIP_CHANGES, METADATA, RAW_EARNINGS
from .csvfiles import read_by_name


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSVs with headers, their columns found by name, NaN as NULL; a column that a file lacks is null."""
    return nan_to_null(read_by_name(spark, path, schema))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, METADATA)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MEMBERSHIP_CHANGES)


def read_raw_earnings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RAW_EARNINGS)


def earnings_clean(raw: DataFrame) -> DataFrame:
    """Calendar rows with the UTC day of their timestamp.

    ``earnings_date`` may be text with an offset or a timestamp; both are instants.
    """
    instant = F.col("earnings_date").cast("timestamp")
    utc = F.to_date(F.to_utc_timestamp(instant, F.current_timezone()))
    columns = ["eps_estimate", "reported_eps", "surprise_pct"]
    return raw.select("symbol", utc.alias("date"), *[c for c in columns if c in raw.columns])


def cik_lookup(raw: DataFrame) -> DataFrame:
    """Ticker to CIK from texts that hold an object of ``{ticker, cik_str}`` entries."""
    entry = "map<string,struct<ticker:string,cik_str:bigint>>"
    return raw.select(F.explode(F.from_json("value", entry)).alias("_k", "_v")).select(
        F.col("_v.ticker").alias("symbol"), F.col("_v.cik_str").alias("cik")
    )


def sec_submissions(raw: DataFrame) -> DataFrame:
    """Industry description and name of each company's submission document, as fallback metadata."""
    parsed = raw.select("cik", F.from_json("value", "name string, sicDescription string").alias("_d"))
    blank = F.coalesce(F.trim("_d.sicDescription"), F.lit("")) == ""
    return parsed.where(~blank).select(
        "cik",
        F.col("_d.sicDescription").alias("sector"),
        F.lit(None).cast("string").alias("industry"),
        F.col("_d.name").alias("name"),
    )


def normalise_ticker(df: DataFrame, column: str = "symbol") -> DataFrame:
    """Rows with a usable ticker, in the notation of the price files."""
    return df.withColumn(column, clean_ticker(F.col(column))).where(F.col(column).isNotNull())


def feature_sink(features: DataFrame, path: str) -> None:
    """Store event features by year, ordered inside each file; the files are ranges of the order."""
    (
        features.withColumn("year", F.year("date"))
        .repartitionByRange("year", "date", "symbol")
        .sortWithinPartitions("year", "date", "symbol")
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )


def feature_csv(features: DataFrame, path: str) -> None:
    """Export in (date, symbol) order; the sort is by ranges, so files follow one another."""
    features.orderBy("date", "symbol").write.mode("overwrite").option("header", True).csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("year")

"""Daily price files and panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import nan_to_null
from ..operators.panel import adjust_ohlc
from ..schemas import RAW_PRICES, RAW_PRICES_JSON
from .csvfiles import FILE, files_without, scans, together


#: What a price file must have; others are left out, and `unread_price_files` names them.
REQUIRED = ("date",)


def _with_symbol(scan: DataFrame) -> DataFrame:
    folder = F.regexp_extract(FILE, "/symbol=([^/]+)/", 1)
    stem = F.regexp_extract(FILE, "([^/]+)[.]csv$", 1)
    symbol = F.coalesce(F.nullif(folder, F.lit("")), stem)
    # The path is a URI, in which some signs are escaped.
    return nan_to_null(scan.withColumn("symbol", F.url_decode(F.replace(symbol, F.lit("+"), F.lit("%2B")))).where(F.col("date").isNotNull()))


def raw_price_files(spark: SparkSession, path: str) -> DataFrame:
    """All price CSVs below ``path`` as one table, their columns found by name.

    The symbol is the file name of ``<symbol>.csv``, or the folder of ``symbol=<symbol>/...``.
    Columns that a file lacks are null. Empty files and files without a date column have no rows, and rows without a
    date are dropped.
    """
    parts = [_with_symbol(s) for s in scans(spark, path, RAW_PRICES, REQUIRED, "*.csv")]
    whole = together(spark, parts, T.StructType([*RAW_PRICES.fields, T.StructField("symbol", T.StringType())]))
    return whole.drop(FILE)


def unread_price_files(spark: SparkSession, path: str) -> DataFrame:
    """Price files without a date column: ``file, header, missing``."""
    return files_without(spark, path, REQUIRED, "*.csv")


def to_panel(raw: DataFrame) -> DataFrame:
    """Adjusted bars: the adjusted close is the close, the other prices are scaled to it.

    Without a raw or an adjusted close nothing is scaled; without an adjusted one the close is null.
    """
    have = set(raw.columns)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in RAW_PRICES if f.name not in have}
    adjusted = adjust_ohlc(raw).withColumns(missing) if missing else adjust_ohlc(raw)
    return adjusted.select("date", "symbol", "open", "high", "low", F.col("adjusted_close").alias("close"), "volume")


def price_panel(spark: SparkSession, path: str) -> DataFrame:
    """The panel of all price files; those with the same columns in the same places are one scan."""
    parts = [to_panel(_with_symbol(s)) for s in scans(spark, path, RAW_PRICES, REQUIRED, "*.csv")]
    if not parts:
        return to_panel(raw_price_files(spark, path))
    return reduce(DataFrame.unionByName, parts)


def landed_prices_json(spark: SparkSession, path: str) -> DataFrame:
    """Bars of landed JSON arrays, with the provider's ``warning`` where there is one."""
    return spark.read.schema(RAW_PRICES_JSON).option("multiLine", True).json(path)


def duplicate_bars(panel: DataFrame) -> DataFrame:
    """(symbol, date) pairs that occur more than once; a panel must have none."""
    return panel.groupBy("symbol", "date").agg(F.count("*").alias("bars")).where(F.col("bars") > 1)


def require_unique_bars(panel: DataFrame) -> DataFrame:
    """The panel itself, or an error that names a duplicate."""
    found = duplicate_bars(panel).limit(1).collect()
    if found:
        raise ValueError(f"several bars for {found[0]['symbol']} on {found[0]['date']}")
    return panel


def missing_symbols(wanted: DataFrame, loaded: DataFrame) -> DataFrame:
    """Symbols that still have to be loaded: those without a row yet."""
    return wanted.select("symbol").distinct().join(loaded.select("symbol"), "symbol", "left_anti")


def ingest_progress(wanted: DataFrame, loaded: DataFrame) -> DataFrame:
    """How many of the wanted symbols are there."""
    done = loaded.select("symbol").distinct().withColumn("_done", F.lit(True))
    return (
        wanted.select("symbol")
        .distinct()
        .join(done, "symbol", "left")
        .agg(F.count("*").alias("wanted"), F.count("_done").alias("loaded"))
    )


def write_panel(panel: DataFrame, path: str) -> None:
    """Store a panel by year of the bar, so date ranges prune files; the files are ranges of the order."""
    ordered = panel.withColumn("year", F.year("date")).repartitionByRange("year", "date", "symbol")
    ordered.sortWithinPartitions("year", "date", "symbol").write.mode("overwrite").partitionBy("year").parquet(path)

"""Price panel operators.

A panel has one row per (symbol, date). The date type has no more than 3.7 million
values and real calendars a few thousand, so a window over one symbol is bounded
however large the panel grows; `sources.prices.duplicate_bars` checks the key. A
(date, sector) group has no such bound, so ranks go through `percent_ranks`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions.ordering import percent_ranks
from ..functions.scalars import change, to_places
from ..schemas import target


def by_symbol() -> WindowSpec:
    """Rows of one symbol in order of date."""
    return W.partitionBy("symbol").orderBy("date")


def adjust_ohlc(df: DataFrame) -> DataFrame:
    """Bring open, high and low to the scale of the adjusted close."""
    if not {"adjusted_close", "close"} <= set(df.columns):
        return df
    factor = F.try_divide(F.col("adjusted_close"), F.col("close"))
    return df.withColumns({c: F.col(c) * factor for c in ("open", "high", "low") if c in df.columns})


def unique_sectors(metadata: DataFrame) -> DataFrame:
    """One sector per symbol: the last by ``seq`` where the metadata carries one."""
    if "seq" not in metadata.columns:
        return metadata.select("symbol", "sector")
    return metadata.groupBy("symbol").agg(
        F.max_by(F.struct("sector"), "seq").getField("sector").alias("sector")
    )


def sector_join(panel: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attach the sector and drop rows without a known sector or a close.

    The join hashes both sides by symbol, the key the windows need next, so the panel is
    shuffled once for the join and all windows, and metadata of any size will do.
    """
    sectors = unique_sectors(metadata).where(F.col("sector").isNotNull())
    return panel.where(F.col("close").isNotNull()).join(sectors.hint("shuffle_hash"), "symbol")


def momentum(panel: DataFrame, windows: Sequence[int] = (14, 60)) -> DataFrame:
    """``return_<n>d``: change of the close over n rows of the same symbol."""
    close = F.col("close")
    return panel.withColumns(
        {f"return_{n}d": F.try_divide(close, F.lag(close, n).over(by_symbol())) - 1 for n in windows}
    )


def _rank_value(window: int) -> Column:
    """Returns equal to nine decimals tie."""
    return to_places(F.col(f"return_{window}d"), 9)


def sector_ranks(universe: DataFrame, window: int = 60) -> DataFrame:
    """Percentile of every return among its sector on the same day: ``(date, sector, _value, rank)``."""
    pool = universe.select("date", "sector", _rank_value(window).alias("_value"))
    return percent_ranks(pool, ["date", "sector"], "_value", f"sector_rank_{window}d")


def attach_sector_rank(rows: DataFrame, ranks: DataFrame, window: int = 60, how: str = "left") -> DataFrame:
    """Join the ranks to rows of the ranked panel. An inner join loses rows without a return."""
    keyed = rows.withColumn("_value", _rank_value(window))
    return keyed.join(ranks, ["date", "sector", "_value"], how).drop("_value")


def sector_rank(panel: DataFrame, window: int = 60) -> DataFrame:
    """``sector_rank_<n>d`` for every row of a panel; NULL without a return."""
    return attach_sector_rank(panel, sector_ranks(panel, window), window)


def forward_returns(panel: DataFrame, horizon: int = 1) -> DataFrame:
    """Open, high, low and close ``horizon`` rows ahead, relative to today's close."""
    return panel.withColumns(
        {
            target(horizon, price): change(F.lead(price, horizon).over(by_symbol()), F.col("close"))
            for price in ("open", "high", "low", "close")
        }
    )


def last_known(column: str, order: str) -> Column:
    """Last non-null value of a column."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def latest_snapshot(panel: DataFrame, window: int = 60) -> DataFrame:
    """Per symbol the last non-null value of every column, over rows with a return."""
    others = [c for c in panel.columns if c not in ("symbol", "date")]
    return (
        panel.where(F.col(f"return_{window}d").isNotNull())
        .groupBy("symbol")
        .agg(F.max("date").alias("date"), *[last_known(c, "date").alias(c) for c in others])
    )

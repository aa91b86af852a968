"""Earnings events: joins to the panel, surprises, upcoming dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import lookup_ticker


def first_per_day(earnings: DataFrame) -> DataFrame:
    """One event per (symbol, date): the first by ``seq``, or by its own values without one."""
    keys = ("symbol", "date")
    payload = [c for c in earnings.columns if c not in (*keys, "seq")]
    order = F.col("seq") if "seq" in earnings.columns else F.struct(*payload)
    picked = earnings.groupBy(*keys).agg(F.min_by(F.struct(*payload), order).alias("_event"))
    return picked.select(*keys, "_event.*")


def event_join(panel: DataFrame, earnings: DataFrame) -> DataFrame:
    """Panel rows of announcement days with a reported surprise.

    Duplicates go before events without a surprise, so a first duplicate that lacks one
    hides the others.
    """
    events = first_per_day(earnings).where(F.col("surprise_pct").isNotNull())
    return panel.join(events, ["symbol", "date"])


def standardised_surprise(events: DataFrame, window: int = 8, min_periods: int = 4) -> DataFrame:
    """``sue``: surprise over the deviation of the symbol's earlier surprises."""
    prior = W.partitionBy("symbol").orderBy("date").rowsBetween(-window, -1)
    spread = F.when(F.count("surprise_pct").over(prior) >= min_periods, F.stddev_samp("surprise_pct").over(prior))
    return events.withColumn("sue", F.try_divide(F.col("surprise_pct"), F.nullif(spread, F.lit(0.0))))


def pead_rule(events: DataFrame) -> DataFrame:
    """Predict a spike after any positive surprise; the score is 1.0 or 0.0."""
    positive = F.coalesce(F.col("surprise_pct") > 0, F.lit(False))
    return events.withColumns({"y_pred": positive.cast("int"), "y_pred_proba": positive.cast("double")})


def is_upcoming(as_of: Column) -> Column:
    """Scheduled after ``as_of``, estimated, not reported yet."""
    return (F.col("date") > as_of) & F.col("reported_eps").isNull() & F.col("eps_estimate").isNotNull()


def _as_column(as_of: Column | dt.date | None) -> Column:
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def upcoming(earnings: DataFrame, as_of: Column | dt.date | None = None) -> DataFrame:
    return earnings.where(is_upcoming(_as_column(as_of)))


def upcoming_earnings(earnings: DataFrame, snapshot: DataFrame, as_of: Column | dt.date | None = None) -> DataFrame:
    """Upcoming events of symbols with a snapshot, with their sector. Sort at the sink."""
    sectors = snapshot.select("symbol", "sector")
    return upcoming(earnings, as_of).select("symbol", "date", "eps_estimate").join(sectors, "symbol")


def next_upcoming(earnings: DataFrame, snapshot: DataFrame, as_of: Column | dt.date | None = None) -> DataFrame:
    """The soonest upcoming event of each symbol beside its latest snapshot."""
    soonest = (
        upcoming(earnings, as_of)
        .groupBy("symbol")
        .agg(F.min_by(F.struct("date", "eps_estimate"), F.struct("date", "eps_estimate")).alias("_next"))
        .select("symbol", F.col("_next.date").alias("event_date"), F.col("_next.eps_estimate"))
    )
    return soonest.join(snapshot.withColumnRenamed("date", "snapshot_date"), "symbol")


def latest_event(features: DataFrame) -> DataFrame:
    """The most recent event row of each symbol, for all symbols in one pass."""
    payload = [c for c in features.columns if c != "symbol"]
    last = features.groupBy("symbol").agg(F.max_by(F.struct(*payload), "date").alias("_last"))
    return last.select("symbol", "_last.*")


def for_ticker(df: DataFrame, ticker: str) -> DataFrame:
    """Rows of one ticker as a user would type it."""
    return df.where(F.col("symbol").cast("string") == lookup_ticker(F.lit(ticker)))


def scenario_grid(upcoming_rows: DataFrame, low: int = -100, high: int = 100, step: int = 5) -> DataFrame:
    """Hypothetical surprises and the earnings they imply, for every upcoming event."""
    grid = F.sequence(F.lit(low), F.lit(high), F.lit(step)).cast("array<double>")
    return upcoming_rows.withColumn("surprise_pct", F.explode(grid)).withColumn(
        "reported_eps", F.col("eps_estimate") * (1 + F.col("surprise_pct") / 100)
    )

"""Index membership and symbol metadata.

Changes are ``(seq, date, added_ticker, removed_ticker)`` with the newest change at the
lowest ``seq``; current members are a table with a ``symbol`` column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def change_events(changes: DataFrame) -> DataFrame:
    """One row per ticker and operation: ``(symbol, date, seq, step, op)``."""
    added = F.struct(F.col("added_ticker").alias("symbol"), F.lit(0).alias("step"), F.lit("add").alias("op"))
    removed = F.struct(F.col("removed_ticker").alias("symbol"), F.lit(1).alias("step"), F.lit("remove").alias("op"))
    return (
        changes.select("date", "seq", F.explode(F.array(added, removed)).alias("_e"))
        .select("_e.symbol", "date", "seq", "_e.step", "_e.op")
        .where(F.coalesce(F.col("symbol").cast("string"), F.lit("")) != "")
    )


#: Days in a bin of the interval join.
BIN_DAYS = 32


def membership_intervals(current: DataFrame, changes: DataFrame) -> DataFrame:
    """When each ticker was a member: ``(symbol, valid_from, valid_to)``, from the first day on, before the second.

    A null start is since ever, a null end is open. The state on a day follows from undoing every later change from the
    current set in ``seq`` order: the last one undone decides, or the current state if none is later. So
    the state before a change's day is the last undone among the changes of that day and later ones, a running maximum
    from the newest day back. Changes of a ticker and day are summed up first, so a ticker has at most one row per day. Changes
    without a date cannot be undone and are ignored.
    """
    member = (F.col("op") == "remove").alias("member")
    days = change_events(changes).where(F.col("date").isNotNull()).groupBy("symbol", "date").agg(F.max(F.struct("seq", "step", member)).alias("undone"))
    back = W.partitionBy("symbol").orderBy(F.desc("date"))
    before = days.select(
        "symbol",
        F.lead("date").over(back).alias("valid_from"),
        F.col("date").alias("valid_to"),
        F.max("undone").over(back.rowsBetween(W.unboundedPreceding, 0))["member"].alias("member"),
    )
    last = days.groupBy("symbol").agg(F.max("date").alias("valid_from"))
    now = current.select("symbol").distinct().join(last, "symbol", "left").select("symbol", "valid_from", F.lit(None).cast("date").alias("valid_to"))
    pieces = before.where("member").drop("member").unionByName(now)
    # Pieces that touch are one interval.
    forth = W.partitionBy("symbol").orderBy(F.asc_nulls_first("valid_from"))
    starts = ~F.coalesce(F.col("valid_from") == F.lag("valid_to").over(forth), F.lit(False))
    numbered = pieces.withColumn("_starts", starts.cast("int")).withColumn("_run", F.sum("_starts").over(forth.rowsBetween(W.unboundedPreceding, 0)))
    end = F.max(F.struct(F.col("valid_to").isNull().alias("open"), "valid_to"))["valid_to"]
    return numbered.groupBy("symbol", "_run").agg(F.min(F.struct("valid_from"))["valid_from"].alias("valid_from"), end.alias("valid_to")).drop("_run")


def _holds(day: Column) -> Column:
    """Whether a day lies in an interval."""
    return F.coalesce(F.col("valid_from") <= day, F.lit(True)) & F.coalesce(day < F.col("valid_to"), F.lit(True))


def membership_asof(current: DataFrame, changes: DataFrame, dates: DataFrame | Sequence[dt.date]) -> DataFrame:
    """Members on each date, by undoing every later change from the current set: ``(as_of, symbol)``.

    ``dates`` is a list, or a table with an ``as_of`` column of any length; repeated and missing dates count once and not
    at all. Intervals and dates are cut into bins of `BIN_DAYS` days, so that the interval join is an equality join on
    the bin, whose pairs nearly all hold.
    """
    if not isinstance(dates, DataFrame):
        dates = current.sparkSession.createDataFrame([(d,) for d in dates], "as_of date")
    asked = dates.select(F.col("as_of").cast("date").alias("as_of")).where(F.col("as_of").isNotNull()).distinct()
    span = asked.agg(F.min("as_of").alias("low"), F.max("as_of").alias("high")).first()
    if span["low"] is None:
        return asked.join(current.select("symbol"), F.lit(False))

    def bin_of(day: Column) -> Column:
        return F.floor(F.unix_date(day) / BIN_DAYS).cast("int")

    low, high = F.lit(span["low"]), F.lit(span["high"])
    reached = membership_intervals(current, changes).where(F.coalesce(F.col("valid_from") <= high, F.lit(True)) & F.coalesce(F.col("valid_to") > low, F.lit(True)))
    # `greatest` and `least` pass over nulls, that is over open ends.
    bins = F.explode(F.sequence(bin_of(F.greatest("valid_from", low)), bin_of(F.least(F.date_sub("valid_to", 1), high))))
    found = asked.withColumn("_bin", bin_of(F.col("as_of"))).join(reached.withColumn("_bin", bins), "_bin")
    return found.where(_holds(F.col("as_of"))).select("as_of", "symbol")


def universe_point_in_time(features: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows whose symbol was a member on the row's own date: the universe without survivorship bias."""
    intervals = membership_intervals(current, changes).withColumnRenamed("symbol", "_symbol")
    return features.join(intervals, (F.col("symbol") == F.col("_symbol")) & _holds(F.col("date")), "left_semi")


def ticker_lifespans(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Per ticker ever seen: first addition, last removal, and whether it is a member now.

    A current member has no removal date.
    """
    events = change_events(changes).select(
        "symbol",
        F.when(F.col("op") == "add", F.col("date")).alias("added"),
        F.when(F.col("op") == "remove", F.col("date")).alias("removed"),
        F.lit(False).alias("now"),
    )
    none = F.lit(None).cast("date")
    members = current.select("symbol", none.alias("added"), none.alias("removed"), F.lit(True).alias("now"))
    return (
        events.unionByName(members)
        .groupBy("symbol")
        .agg(
            F.min("added").alias("date_added"),
            F.max("removed").alias("_removed"),
            F.max("now").alias("is_current"),
        )
        .select(
            "symbol",
            "date_added",
            F.when(~F.col("is_current"), F.col("_removed")).alias("date_removed"),
            "is_current",
        )
    )


def master_list(lifespans: DataFrame) -> DataFrame:
    """Lifespans as they are published, with the word ``present`` for current members."""
    removed = F.when(F.col("is_current"), F.lit("present")).otherwise(F.col("date_removed").cast("string"))
    return lifespans.select("symbol", "date_added", removed.alias("date_removed"))


def ticker_universe(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Every ticker that is or ever was mentioned."""
    return current.select("symbol").union(change_events(changes).select("symbol")).distinct()


def universe_current(features: DataFrame, lifespans: DataFrame) -> DataFrame:
    """Rows of current members only: the survivorship-biased universe."""
    return features.join(lifespans.where("is_current").select("symbol"), "symbol", "left_semi")


def survivorship_delta(features: DataFrame, lifespans: DataFrame) -> DataFrame:
    """Rows the current-members universe leaves out."""
    return features.join(lifespans.where("is_current").select("symbol"), "symbol", "left_anti")


def is_blank(column: Column) -> Column:
    return F.coalesce(F.trim(column.cast("string")), F.lit("")) == ""


def metadata_build(tickers: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Metadata per ticker, the fallback only for tickers absent from the primary map.

    A ticker without a sector from its source is marked invalid for manual review.
    """
    info = ["sector", "industry", "name"]

    def source(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("symbol", F.struct(*info).alias(prefix))

    chosen = (
        tickers.join(source(primary, "_primary"), "symbol", "left")
        .join(source(fallback, "_fallback"), "symbol", "left")
        .withColumn("_info", F.coalesce("_primary", "_fallback"))
    )
    return classify_metadata(chosen.select("symbol", "date_added", "date_removed", "_info.*"))


def classify_metadata(rows: DataFrame) -> DataFrame:
    """Mark rows valid or rejected and fill in the display name."""
    valid = ~is_blank(F.col("sector"))
    name = F.when(~is_blank(F.col("name")), F.col("name"))
    missing = F.when(valid, F.col("symbol").cast("string")).otherwise(F.lit("Unknown / Missing Sector"))
    return rows.select(
        "symbol",
        F.coalesce(name, missing).alias("official_name"),
        F.when(valid, F.col("sector")).alias("sector"),
        F.when(valid, F.col("industry")).alias("industry"),
        "date_added",
        "date_removed",
        valid.alias("is_valid"),
    )


def valid_metadata(classified: DataFrame) -> DataFrame:
    return classified.where("is_valid").drop("is_valid")


def rejected_metadata(classified: DataFrame) -> DataFrame:
    return classified.where(~F.col("is_valid")).select("symbol", "official_name", "date_added", "date_removed")

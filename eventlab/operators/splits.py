"""Chronological splits and walk-forward folds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import FEATURES, LABEL


def complete_rows(df: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL) -> DataFrame:
    return df.na.drop(subset=[*features, label])


def chrono_split(
    df: DataFrame,
    split_date: dt.date,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    embargo_days: int = 0,
) -> DataFrame:
    """Complete rows marked ``train`` before the date and ``test`` from it on.

    ``embargo_days`` leaves out training rows whose label may reach into the test period.
    """
    boundary = F.lit(split_date)
    rows = complete_rows(df, features, label)
    if embargo_days:
        inside = (F.col("date") < boundary) & (F.col("date") >= F.date_sub(boundary, embargo_days))
        rows = rows.where(~inside)
    return rows.withColumn("split", F.when(F.col("date") < boundary, "train").otherwise("test"))


def validation_slice(train: DataFrame, validation_date: dt.date) -> DataFrame:
    """Mark the training rows held out for early stopping."""
    return train.withColumn("is_validation", F.col("date") >= F.lit(validation_date))


def fold_index(date: Column, start: dt.date, months: int) -> Column:
    """0-based window of ``months`` months since ``start``; negative before it."""
    if start.day > 28:
        raise ValueError("folds must start on day 28 or earlier")
    whole = (F.year(date) - start.year) * 12 + F.month(date) - start.month
    whole = whole - (F.dayofmonth(date) < start.day).cast("int")
    return F.floor(whole / months).cast("int")


def walk_forward_folds(df: DataFrame, start: dt.date, months: int = 6) -> DataFrame:
    """Expanding folds: window bounds, training rows before them, test rows in them.

    Empty windows are skipped and folds are numbered from 1. The counts are aggregated
    first, so the ordering below sees one row per window.
    """
    index = F.greatest(fold_index(F.col("date"), start, months), F.lit(-1))
    sizes = df.groupBy(index.alias("_index")).agg(F.count("*").alias("n_test"))
    order = W.orderBy("_index")
    before = F.sum("n_test").over(order.rowsBetween(W.unboundedPreceding, -1))
    return (
        sizes.withColumn("n_train", F.coalesce(before, F.lit(0)))
        .where(F.col("_index") >= 0)
        .select(
            F.row_number().over(order).alias("fold"),
            F.add_months(F.lit(start), F.col("_index") * months).alias("test_start"),
            F.add_months(F.lit(start), (F.col("_index") + 1) * months).alias("test_end"),
            "n_train",
            "n_test",
        )
    )


def fold_assign(df: DataFrame, folds: DataFrame, start: dt.date, months: int = 6) -> DataFrame:
    """Each row's test fold; rows before the first window are left out.

    The window follows from the date by arithmetic, so the fold is looked up by equality.
    """
    keyed = df.withColumn("test_start", F.add_months(F.lit(start), fold_index(F.col("date"), start, months) * months))
    return keyed.join(folds.select("test_start", "fold"), "test_start")

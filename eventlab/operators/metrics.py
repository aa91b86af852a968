"""Scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_edges, probability_bin
from ..schemas import LABEL, target


def classification_metrics(
    predictions: DataFrame, keys: Sequence[str] = (), label: str = LABEL, pred: str = "y_pred"
) -> DataFrame:
    """Accuracy, and precision on the positive class (0 without positive predictions)."""
    hits = F.count_if((F.col(pred) == 1) & (F.col(label) == 1))
    return predictions.groupBy(*keys).agg(
        F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(hits, F.count_if(F.col(pred) == 1)), F.lit(0.0)).alias("precision"),
        F.count("*").alias("rows"),
    )


def brier_score(
    predictions: DataFrame, keys: Sequence[str] = (), label: str = LABEL, score: str = "y_pred_proba"
) -> DataFrame:
    error = F.col(score) - F.col(label)
    return predictions.groupBy(*keys).agg(F.avg(error * error).alias("brier_score"))


def calibration_curve(
    predictions: DataFrame,
    bins: int = 10,
    keys: Sequence[str] = (),
    label: str = LABEL,
    score: str = "y_pred_proba",
) -> DataFrame:
    """Mean prediction against observed rate per non-empty probability bin."""
    edges = F.array(*[F.lit(e) for e in bin_edges(bins)])
    return (
        predictions.withColumn("bin", probability_bin(F.col(score), bins))
        .groupBy(*keys, "bin")
        .agg(
            F.avg(score).alias("mean_predicted"),
            F.avg(F.col(label).cast("double")).alias("fraction_positive"),
            F.count("*").alias("count"),
        )
        .select(
            *keys,
            edges[F.col("bin")].alias("bin_low"),
            edges[F.col("bin") + 1].alias("bin_high"),
            "mean_predicted",
            "fraction_positive",
            "count",
        )
    )


def class_weight(train: DataFrame, keys: Sequence[str] = (), label: str = LABEL) -> DataFrame:
    """Negatives per positive, the weight a positive row gets in training."""
    positives, negatives = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return train.groupBy(*keys).agg(
        positives.alias("positives"),
        negatives.alias("negatives"),
        F.try_divide(negatives, positives).alias("scale_pos_weight"),
    )


def spike_rate(df: DataFrame, thresholds: Sequence[float], ret: str = target(1, "high")) -> DataFrame:
    """Share of positive labels at each threshold, in one pass."""
    thr: Column = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    hit = F.coalesce(F.col(ret) > F.col("threshold"), F.lit(False))
    return (
        df.select(ret, thr.alias("threshold"))
        .groupBy("threshold")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(hit).alias("positives"),
            F.avg(hit.cast("double")).alias("positive_rate"),
        )
    )


def fold_summary(per_fold: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, minimum and maximum of each metric over the folds."""
    named = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    )
    return (
        per_fold.select(*keys, named.alias("_m"))
        .select(*keys, "_m.*")
        .groupBy(*keys, "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )

"""What a front end asks for, computed for all symbols in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import pivot_struct, to_places
from ..schemas import FEATURES, RETURN, target
from ..storage import scratch
from .events import latest_event, next_upcoming, scenario_grid
from .models import CalibratedModel, Model, score
from .panel import last_known

CLASS_LABELS = ("No Spike", "Spike")


def class_label(pred: Column) -> Column:
    return F.when(pred == 1, CLASS_LABELS[1]).otherwise(CLASS_LABELS[0])


def dataset_health(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count("*").alias("rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date")
    )


def ticker_list(features: DataFrame) -> DataFrame:
    """Each symbol with its last known sector. Sort at the sink."""
    return features.groupBy("symbol").agg(last_known("sector", "date").alias("sector"))


def describe_predictions(
    scored: DataFrame, features: Sequence[str] = FEATURES, spike_threshold: float | None = None
) -> DataFrame:
    """Scored rows as recommendations; the realised outcome stays apart from the prediction."""
    confidence = F.when(F.col("y_pred") == 1, F.col("y_pred_proba")).otherwise(1 - F.col("y_pred_proba"))
    return scored.select(
        F.col("symbol").alias("ticker"),
        F.col("date").alias("as_of_date"),
        "sector",
        F.col("y_pred").alias("predicted_class"),
        class_label(F.col("y_pred")).alias("predicted_label"),
        confidence.alias("confidence"),
        F.lit(spike_threshold).cast("double").alias("spike_threshold"),
        pivot_struct(list(features), [F.col(c) for c in features]).alias("feature_values"),
        F.struct(
            F.col(RETURN).cast("double").alias("close_ret"), F.col(target(1, "high")).cast("double").alias("high_ret")
        ).alias("historical_outcome"),
    )


def recommendation(
    features: DataFrame,
    model: Model,
    names: Sequence[str] = FEATURES,
    spike_threshold: float | None = None,
) -> DataFrame:
    """The model's view of every ticker's latest event."""
    return describe_predictions(score(model, latest_event(features)), names, spike_threshold)


def scenario_rows(earnings: DataFrame, snapshot: DataFrame, as_of, low=-100, high=100, step=5) -> DataFrame:
    """Model input for every hypothetical surprise of every ticker's next event."""
    return scenario_grid(next_upcoming(earnings, snapshot, as_of), low, high, step)


def scenario_analysis(
    earnings: DataFrame,
    snapshot: DataFrame,
    model: Model,
    as_of=None,
    low: int = -100,
    high: int = 100,
    step: int = 5,
) -> DataFrame:
    """Predicted class and probability over the surprise grid, other features held."""
    scored = score(model, scenario_rows(earnings, snapshot, as_of, low, high, step))
    return scored.select(
        F.col("symbol").alias("ticker"),
        F.col("event_date").alias("upcoming_earnings_date"),
        F.col("snapshot_date").alias("as_of_date"),
        "sector",
        "eps_estimate",
        "surprise_pct",
        "reported_eps",
        class_label(F.col("y_pred")).alias("predicted_label"),
        F.col("y_pred_proba").alias("spike_probability"),
    )


def linear_attribution(
    df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float]
) -> DataFrame:
    """Contribution of each feature to a linear score, against its mean."""
    parts = [(F.col(name) - means[name]) * weight for name, weight in coefficients.items()]
    return df.withColumn("attribution", pivot_struct(list(coefficients), parts))


def feature_attribution(
    df: DataFrame,
    model: Model,
    background: DataFrame,
    features: Sequence[str] = FEATURES,
    keys: Sequence[str] = ("symbol", "date"),
) -> DataFrame:
    """Exact Shapley values of the model's log-odds: ``(keys, attribution, base)``.

    The contributions and the base add up to a row's log-odds. A linear model compares with the
    means of all background rows. Boosted trees compare with the rows they were fitted on, which
    are in the trees: where a feature is unknown, both branches count by the rows that took them.
    Every path is a rule of a few features, so the work grows with the paths, however many features there are.
    A calibrated model is explained by the mean log-odds of its trees.
    """
    features, keys = list(features), list(keys)
    if isinstance(model, CalibratedModel):
        forests = [base for base, _ in model.folds]
    elif isinstance(model.stages[-1], GBTClassificationModel):
        forests = [model]
    else:
        return _linear_model_attribution(df, model, background, features, keys)
    # Spark's boosted trees model half of the log-odds.
    trees = [(2 * w / len(forests), tree) for forest in forests for w, tree in tree_nodes(forest.stages[-1], df.sparkSession)]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    kinds += ", base double, " + ", ".join(f"`_phi_{f}` double" for f in features)
    told = df.select(*keys, *[F.col(f).cast("double").alias(f"_in_{f}") for f in features]).mapInPandas(_explain(trees, features, keys), kinds)
    return told.select(*keys, pivot_struct(features, [F.col(f"_phi_{f}") for f in features]).alias("attribution"), "base")


def _linear_model_attribution(df: DataFrame, model: Model, background: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    scaler, logistic = model.stages[1], model.stages[-1]
    slope = [c / s if s else 0.0 for c, s in zip(logistic.coefficients.toArray().tolist(), scaler.std.toArray().tolist(), strict=True)]
    known = background.na.drop(subset=features).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
    if known[0] is None:
        raise ValueError("the background table has no complete row")
    base = logistic.intercept + sum(w * (known[f] - m) for w, f, m in zip(slope, features, scaler.mean.toArray().tolist(), strict=True))
    told = linear_attribution(df, dict(zip(features, slope, strict=True)), known.asDict())
    return told.select(*keys, "attribution", F.lit(base).alias("base"))


def tree_nodes(forest: GBTClassificationModel, spark: SparkSession) -> list[tuple[float, np.ndarray]]:
    """Weight and nodes of every tree, read from the saved model.

    A node is (feature or -1, threshold, left, right, prediction, rows). Their number is bounded
    by the depth and the number of trees, not by the data.
    """
    path = scratch(spark, "forest")
    forest.save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID",
        node["id"].alias("id"),
        node["split"]["featureIndex"].alias("feature"),
        F.try_element_at(node["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["prediction"].alias("prediction"),
        node["rawCount"].cast("double").alias("rows"),
    )
    nodes = rows.toPandas().sort_values(["treeID", "id"])
    weights = forest.treeWeights
    return [(weights[int(i)], own.drop(columns=["treeID", "id"]).fillna(0.0).to_numpy()) for i, own in nodes.groupby("treeID")]


@dataclass(frozen=True)
class LeafRule:
    """A path to a leaf: one interval per feature on it, and the share of the rows that its cuts on the feature keep."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    shares: tuple[float, ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        """Which intervals rows lie in, low excluded. A missing value goes right at every cut."""
        own = x[:, self.features]
        low, high = np.array(self.low), np.array(self.high)
        return (np.isneginf(low) | ~(own <= low)) & (np.isposinf(high) | (own <= high))


def leaf_rules(weight: float, tree: np.ndarray) -> list[LeafRule]:
    """The paths of a tree. Their number is bounded by the tree, not by the data or its features."""
    out: list[LeafRule] = []

    def walk(node: int, path: dict[int, tuple[float, float, float]]) -> None:
        feature, threshold, left, right, prediction, rows = tree[node]
        if left < 0:
            low, high, shares = zip(*path.values(), strict=True) if path else ((), (), ())
            out.append(LeafRule(weight * prediction, tuple(path), low, high, shares))
            return
        low, high, share = path.get(int(feature), (-np.inf, np.inf, 1.0))
        taken = tree[int(left), 5] / rows
        walk(int(left), path | {int(feature): (low, min(high, threshold), share * taken)})
        walk(int(right), path | {int(feature): (max(low, threshold), high, share * (1 - taken))})

    walk(0, {})
    return out


def rule_shares(known: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """Shapley values of the features of a rule of value one, for rows of which intervals hold.

    A known feature counts 1 or 0, an unknown one its share. For each feature the other ones make the
    polynomial of factors (share + known z); its coefficient of z to the s sums up all sets of s known features, which
    count s! (d - s - 1)! / d! each.
    """
    rows, d = known.shape
    out = np.empty((rows, d))
    order = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
    for i in range(d):
        sets = np.zeros((rows, d))
        sets[:, 0] = 1.0
        for j in (j for j in range(d) if j != i):
            further = sets * shares[j]
            further[:, 1:] += sets[:, :-1] * known[:, j, None]
            sets = further
        out[:, i] = (known[:, i] - shares[i]) * (sets @ order)
    return out


#: Features of a rule up to which its values are kept for all patterns of intervals.
PATTERN_FEATURES = 10


def _explain(trees: list[tuple[float, np.ndarray]], features: list[str], keys: list[str]) -> Callable:
    rules = [rule for weight, tree in trees for rule in leaf_rules(weight, tree)]
    base = sum(rule.value * float(np.prod(rule.shares)) for rule in rules)

    def patterns(d: int) -> np.ndarray:
        return ((np.arange(2**d)[:, None] >> np.arange(d)) & 1).astype(np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [rule.value * rule_shares(patterns(len(rule.features)), rule.shares) if 0 < len(rule.features) <= PATTERN_FEATURES else None for rule in rules]
        for whole in batches:
            for at in range(0, len(whole), 1000):
                rows = whole.iloc[at : at + 1000]
                x = rows[[f"_in_{f}" for f in features]].to_numpy(np.float64)
                told = np.zeros((len(rows), len(features)))
                for rule, table in zip(rules, tables, strict=True):
                    if not rule.features:
                        continue
                    holds = rule.holds(x)
                    if table is None:
                        part = rule.value * rule_shares(holds.astype(np.float64), rule.shares)
                    else:
                        part = table[holds @ (1 << np.arange(len(rule.features)))]
                    told[:, rule.features] += part
                shown = pd.DataFrame(told, columns=[f"_phi_{f}" for f in features], index=rows.index)
                yield pd.concat([rows[keys], pd.Series(base, name="base", index=rows.index), shown], axis=1)

    return run


def attribution_rank(df: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Features of each row by the size of their contribution."""
    long = df.select(*keys, F.explode("attribution").alias("feature", "contribution"))
    order = W.partitionBy(*keys).orderBy(F.abs("contribution").desc_nulls_last(), "feature")
    return long.withColumn("place", F.row_number().over(order))


def _percent(value: Column) -> Column:
    return F.concat(F.floor(value * 100 + 0.5).cast("string"), F.lit("%"))


def _number(value: Column) -> Column:
    """Plain decimal notation with six places, or ``unknown``."""
    text = F.format_string("%.6f", to_places(value, 6))
    return F.when(value.isNotNull(), text).otherwise(F.lit("unknown"))


#: What a prompt asks for, above its facts.
RULES = (
    "TASK: write a short paragraph, in everyday words, on why the class below fits the facts.",
    "RULES: repeat figures only as they stand here and do not add others.",
    "RULES: the past_ facts describe what already happened; do not turn them into an outlook.",
    "RULES: the class says whether, never how far, a price moves; do not name a coming change.",
    "FACTS:",
)


def render_prompt(recommendations: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``prompt``: every value of a recommendation as ``key=value`` facts, and what a text may do with them."""
    outcome = F.col("historical_outcome")
    facts = {
        "symbol": F.col("ticker").cast("string"),
        "sector": F.coalesce("sector", F.lit("unknown")),
        "event_day": F.col("as_of_date").cast("string"),
        **{f: _number(F.element_at("feature_values", F.lit(f))) for f in features},
        "spike_means_above": _number(F.col("spike_threshold")),
        "class": F.col("predicted_label"),
        "certainty": _percent(F.col("confidence")),
        "past_close_move": _number(outcome["close_ret"]),
        "past_high_move": _number(outcome["high_ret"]),
    }
    listed = [F.concat(F.lit(f"{name}="), value) for name, value in facts.items()]
    return recommendations.withColumn("prompt", F.concat_ws("\n", *[F.lit(r) for r in RULES], *listed))


def render_fallback(recommendations: DataFrame) -> DataFrame:
    """``explanation``: a fixed sentence for when nothing can write one."""
    text = F.concat(
        F.col("predicted_label"),
        F.lit(" is what the model gives "),
        F.col("ticker").cast("string"),
        F.lit(" ("),
        _percent(F.col("confidence")),
        F.lit(" certain), judging by its report of "),
        F.col("as_of_date").cast("string"),
        F.lit("; nothing newer went into this."),
    )
    return recommendations.withColumn("explanation", text)

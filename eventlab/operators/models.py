"""Classifiers on event features, with Spark ML.

Fitting is eager: every call is a series of distributed jobs. Pass a checkpointed table
if several models are fitted on it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import number_rows
from ..functions.scalars import hash_int
from ..schemas import FEATURES, LABEL
from ..storage import stored
from .boosting import BoostedModel, fit_boosted, fit_boosted_each
from .metrics import class_weight, classification_metrics

SEED = 42
#: Ranges of the hash in which rows are numbered for folds.
FOLD_BUCKETS = 4096

# Config names users of boosted trees know, and the Spark parameter each one sets.
GBT_PARAMETERS = {
    "max_depth": "maxDepth",
    "n_estimators": "maxIter",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
    "min_child_weight": "minInstancesPerNode",
    "min_split_loss": "minInfoGain",
    "max_bin": "maxBins",
}
GBT_DEFAULTS = {"maxDepth": 6, "maxIter": 100, "stepSize": 0.3}


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def gbt_classifier(config: Mapping[str, object] | None = None, label: str = LABEL) -> GBTClassifier:
    """A boosted tree classifier from a config; unknown keys are an error.

    ``early_stopping_rounds`` is left to `fit_gbt`: Spark's own stop has a tolerance but no
    patience. Spark has no L1/L2 penalty for trees, so ``reg_alpha`` and ``reg_lambda`` are
    refused rather than ignored; `boosting.fit_boosted` has them.
    """
    config = dict(config or {})
    params: dict[str, object] = dict(GBT_DEFAULTS)
    weighted = config.pop("scale_pos_weight", None) is not None
    config.pop("early_stopping_rounds", None)
    columns = config.pop("colsample_bytree", None)
    unknown = set(config) - set(GBT_PARAMETERS)
    if unknown:
        raise ValueError(f"unsupported model parameters: {sorted(unknown)}")
    params.update({GBT_PARAMETERS[k]: v for k, v in config.items()})
    if columns is not None:
        params["featureSubsetStrategy"] = str(float(columns)) if columns < 1 else "all"
    if weighted:
        params["weightCol"] = "_weight"
    return GBTClassifier(featuresCol="features", labelCol=label, seed=SEED, **params)


def _weighted(train: DataFrame, config: Mapping[str, object], label: str) -> DataFrame:
    weight = config.get("scale_pos_weight")
    if weight is None:
        return train
    if weight == "balanced":
        weight = class_weight(train, label=label).first()["scale_pos_weight"]
    return train.withColumn("_weight", F.when(F.col(label) == 1, float(weight)).otherwise(1.0))


def fit_gbt(
    train: DataFrame,
    config: Mapping[str, object] | None = None,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
) -> PipelineModel:
    """``scale_pos_weight`` may be a number or ``"balanced"`` for negatives per positive.

    With ``early_stopping_rounds``, rows marked ``is_validation`` are left out of the fit, and
    boosting ends at the best validation loss after which that many trees brought nothing better.
    Boosting is sequential and seeded: a fit of fewer trees has the first trees of a longer one. So
    the number of trees is doubled until the rule stops, and the best number is fitted at last.
    """
    config = config or {}
    rows = _weighted(train, config, label).withColumn(label, F.col(label).cast("double"))
    patience = config.get("early_stopping_rounds")
    if patience is None:
        return Pipeline(stages=[_assembler(features), gbt_classifier(config, label)]).fit(rows)
    fitted_on, held_out = rows.where(~F.col("is_validation")), rows.where(F.col("is_validation"))
    most = gbt_classifier(config, label).getMaxIter()
    trees = min(most, 2 * int(patience))
    while True:
        model = Pipeline(stages=[_assembler(features), gbt_classifier({**config, "n_estimators": trees}, label)]).fit(fitted_on)
        best = best_round(model.stages[-1].evaluateEachIteration(model.stages[0].transform(held_out)), int(patience)) + 1
        if best + int(patience) <= trees or trees == most:
            break
        trees = min(most, 2 * trees)
    if best == trees:
        return model
    return Pipeline(stages=[_assembler(features), gbt_classifier({**config, "n_estimators": best}, label)]).fit(fitted_on)


def best_round(losses: Sequence[float], patience: int) -> int:
    """The round with the least loss before ``patience`` rounds in a row are no better."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best


def fit_logistic(
    train: DataFrame,
    config: Mapping[str, object] | None = None,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
) -> PipelineModel:
    """Standardised features and a logistic regression with penalty 1/(C n)."""
    config = dict(config or {})
    c = float(config.pop("C", 1.0))
    max_iter = int(config.pop("max_iter", 1000))
    if config:
        raise ValueError(f"unsupported model parameters: {sorted(config)}")
    rows = train.withColumn(label, F.col(label).cast("double"))
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    logistic = LogisticRegression(
        featuresCol="scaled",
        labelCol=label,
        maxIter=max_iter,
        regParam=1.0 / (c * max(rows.count(), 1)),
        standardization=False,
    )
    return Pipeline(stages=[_assembler(features), scaler, logistic]).fit(rows)


@dataclass
class CalibratedModel:
    """Per fold a boosted tree model and the map from its margin to a probability."""

    folds: list[tuple[PipelineModel, LogisticRegressionModel | IsotonicRegressionModel]]
    label: str = LABEL

    def transform(self, df: DataFrame) -> DataFrame:
        out, columns = df, df.columns
        probabilities: list[Column] = []
        for i, (base, calibrator) in enumerate(self.folds):
            name = f"_p{i}"
            scored = _with_margin(base.transform(out), "_margin")
            if isinstance(calibrator, LogisticRegressionModel):
                value = vector_to_array("_calibrated")[1]
            else:
                value = F.col("_calibrated")
            out = calibrator.transform(scored).withColumn(name, value).select(*columns, *[f"_p{j}" for j in range(i)], name)
            probabilities.append(F.col(name))
        mean = sum(probabilities[1:], probabilities[0]) / len(probabilities)
        return out.withColumn("y_pred_proba", mean).drop(*[f"_p{i}" for i in range(len(self.folds))])


def _with_margin(scored: DataFrame, out: str) -> DataFrame:
    margin = vector_to_array("rawPrediction")[1]
    return scored.withColumn(out, array_to_vector(F.array(margin))).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def stratified_folds(rows: DataFrame, cv: int, label: str = LABEL) -> DataFrame:
    """The rows with ``_fold``, 0 to ``cv - 1``: each class dealt in turn, whatever its size and the partitioning."""
    bucket = hash_int(F.lit(SEED), F.col("symbol"), F.col("date")) % FOLD_BUCKETS
    ranked = number_rows(rows, [label], bucket, ["symbol", "date"], "_rank")
    return ranked.withColumn("_fold", ((F.col("_rank") - 1) % cv).cast("int")).drop("_rank")


def smoothed(rows: DataFrame, label: str = LABEL) -> DataFrame:
    """Each row as two weighted ones, a positive and a negative, with the smoothed target as their shares in ``_part``.

    With P positive and N negative rows a positive counts (P + 1) / (P + 2) and a negative 1 / (N + 2), so that a
    probability fitted to few rows stays away from 0 and 1.
    """
    counts = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    target = F.when(F.col(label) == 1, (counts["p"] + 1) / (counts["p"] + 2)).otherwise(1 / (counts["n"] + 2))
    both = F.array(*[F.struct(F.lit(y).alias("y"), w.alias("w")) for y, w in ((1.0, target), (0.0, 1 - target))])
    split = rows.withColumn("_both", F.explode(both))
    return split.withColumns({label: F.col("_both.y"), "_part": F.col("_both.w")}).drop("_both")


def fit_calibrated_each(
    train: DataFrame,
    methods: Sequence[str],
    cv: int = 3,
    base_config: Mapping[str, object] | None = None,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
) -> list[CalibratedModel]:
    """`fit_calibrated` by several methods. They share their folds and each fold's trees, which are fitted once."""
    if not set(methods) <= {"sigmoid", "isotonic"}:
        raise ValueError("method must be 'sigmoid' or 'isotonic'")
    rows = stored(stratified_folds(train.withColumn(label, F.col(label).cast("double")), cv, label), "folds")
    fold = F.col("_fold")

    def calibrator(method: str, held_out: DataFrame) -> LogisticRegressionModel | IsotonicRegressionModel:
        if method == "sigmoid":
            estimator = LogisticRegression(
                featuresCol="_margin",
                labelCol=label,
                weightCol="_part",
                probabilityCol="_calibrated",
                rawPredictionCol="_raw",
                predictionCol="_class",
            )
            return estimator.fit(smoothed(held_out, label))
        estimator = IsotonicRegression(featuresCol="_margin", labelCol=label, predictionCol="_calibrated")
        return estimator.fit(held_out)

    def fit_fold(k: int) -> list[tuple]:
        base = fit_gbt(rows.where(fold != k), base_config, features, label)
        held_out = _with_margin(base.transform(rows.where(fold == k)), "_margin").select("_margin", label).persist()
        fitted = [(base, calibrator(method, held_out)) for method in methods]
        held_out.unpersist()
        return fitted

    with ThreadPoolExecutor(cv) as pool:
        folds = list(pool.map(fit_fold, range(cv)))
    return [CalibratedModel([fitted[i] for fitted in folds], label) for i in range(len(methods))]


def fit_calibrated(
    train: DataFrame,
    method: str = "sigmoid",
    cv: int = 3,
    base_config: Mapping[str, object] | None = None,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
) -> CalibratedModel:
    """Cross-fitted calibration: each fold's map is fitted on rows its trees did not see.

    Folds are stratified: rows are numbered within their class, in the order of a hash of symbol and date, and dealt in
    turn, so every fold has its share of each class to within a row. The sigmoid is fitted to smoothed targets, see
    `smoothed`, the isotonic map to the labels.
    """
    return fit_calibrated_each(train, [method], cv, base_config, features, label)[0]


Model = PipelineModel | CalibratedModel | BoostedModel


def score(model: Model, df: DataFrame) -> DataFrame:
    """Add the predicted class and the probability of the positive class."""
    columns = [c for c in df.columns if c not in ("y_pred", "y_pred_proba")]
    scored = model.transform(df.select(*columns))
    if "y_pred_proba" not in scored.columns:
        scored = scored.withColumn("y_pred_proba", vector_to_array("probability")[1])
    return scored.select(*columns, (F.col("y_pred_proba") > 0.5).cast("int").alias("y_pred"), "y_pred_proba")


def fit(kind: str, train: DataFrame, config: Mapping[str, object] | None, features: Sequence[str], label: str) -> Model:
    """Fit a model by kind: ``gbt``, ``boosted`` (penalised second-order trees), ``logistic`` or ``calibrated``."""
    if kind == "boosted":
        return fit_boosted(train, config, features, label)
    if kind == "gbt":
        return fit_gbt(train, config, features, label)
    if kind == "logistic":
        return fit_logistic(train, config, features, label)
    if kind == "calibrated":
        return fit_calibrated(train, features=features, label=label, **dict(config or {}))
    raise ValueError(f"unknown model kind {kind!r}")


#: Models that are fitted side by side; each fit is a long series of short jobs.
SIDE_BY_SIDE = 4


def fit_each(
    kind: str, runs: Sequence[tuple[DataFrame, Mapping[str, object] | None]], features: Sequence[str] = FEATURES, label: str = LABEL
) -> list[Model]:
    """`fit` of several (training rows, config). Boosted trees grow in the same jobs, other models side by side."""
    if kind == "boosted":
        return fit_boosted_each(runs, features, label)
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return list(pool.map(lambda run: fit(kind, run[0], run[1], features, label), runs))


def score_split(model: Model, split: DataFrame) -> DataFrame:
    """All scored rows; with an ``is_validation`` column only those fitted on and the test rows."""
    scored = score(model, split)
    if "is_validation" in split.columns:
        scored = scored.where((F.col("split") == "test") | ~F.col("is_validation"))
    return scored


def train_event_model(
    split: DataFrame,
    kind: str = "gbt",
    config: Mapping[str, object] | None = None,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
) -> tuple[Model, DataFrame, DataFrame]:
    """Fit on the ``train`` rows; return the model, all scored rows and metrics per split.

    With an ``is_validation`` column the train metrics cover only the rows fitted on.
    """
    train = split.where(F.col("split") == "train")
    model = fit(kind, train, config, features, label)
    scored = score_split(model, split)
    return model, scored, classification_metrics(scored, ["split"], label)


def save_bundle(model: Model, path: str, metadata: Mapping[str, object], spark: SparkSession) -> None:
    """Store the model and a one-row JSON sidecar with everything else."""
    if isinstance(model, CalibratedModel):
        for i, (base, calibrator) in enumerate(model.folds):
            base.write().overwrite().save(f"{path}/fold-{i}/base")
            calibrator.write().overwrite().save(f"{path}/fold-{i}/calibrator")
        kind = type(model.folds[0][1]).__name__
        extra = {"model_kind": kind, "folds": len(model.folds)}
    elif isinstance(model, BoostedModel):
        spark.createDataFrame([(model.to_json(),)], "value string").write.mode("overwrite").text(f"{path}/model")
        extra = {"model_kind": "BoostedModel", "folds": 0}
    else:
        model.write().overwrite().save(f"{path}/model")
        extra = {"model_kind": "PipelineModel", "folds": 0}
    text = json.dumps({**metadata, **extra}, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/metadata")


def load_bundle(path: str, spark: SparkSession) -> tuple[Model, dict]:
    """The model and its metadata; an error that says what to do if there is none."""
    try:
        metadata = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    except Exception as error:
        raise FileNotFoundError(f"no model bundle at {path}: train one and call save_bundle first") from error
    if metadata["model_kind"] == "BoostedModel":
        return BoostedModel.from_json(spark.read.text(f"{path}/model").first()["value"]), metadata
    if metadata["folds"] == 0:
        return PipelineModel.load(f"{path}/model"), metadata
    loader = LogisticRegressionModel if metadata["model_kind"] == "LogisticRegressionModel" else IsotonicRegressionModel
    folds = [
        (PipelineModel.load(f"{path}/fold-{i}/base"), loader.load(f"{path}/fold-{i}/calibrator"))
        for i in range(metadata["folds"])
    ]
    return CalibratedModel(folds), metadata

"""Queries that fit models, and return what they found.

SQL cannot fit a model. It checks the first levels of a boosted tree, whose sums and cuts it can state, and
three queries of the logistic model, whose probabilities have a closed form; the others return their figures and are held
against plain Python on small tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.operators import boosting as BO
from eventlab.operators import membership as MB
from eventlab.operators import models as M
from eventlab.operators import serving as S
from eventlab.operators import splits as SP
from eventlab.operators import textcheck as C
from eventlab.operators.events import latest_event
from eventlab.operators.metrics import class_weight
from eventlab.operators.resample import seeded_ticker_sample
from eventlab.plans import experiments as X
from eventlab.schemas import FEATURES, LABEL
from eventlab.sources import market as K
from eventlab.storage import scratch, stored

from .ctes import with_ctes
from .panel import AS_OF, _snapshot
from .shape import r6, tidy

DEFAULT: dict = {}  # the library's own defaults: 100 trees of depth 6
# The configurations of the study, as it names them.
REGULARISED = {"reg_alpha": 0.1, "reg_lambda": 1.0, "scale_pos_weight": "balanced"}
TREE_COMPLEXITY = {"max_depth": 3, "min_child_weight": 5, "subsample": 0.7, "colsample_bytree": 0.7}
EARLY_STOPPING = {"n_estimators": 500, "early_stopping_rounds": 20}
LOW_GAP = {**REGULARISED, **TREE_COMPLEXITY, **EARLY_STOPPING}
CONFIGS = {
    "baseline": DEFAULT,
    "regularised": REGULARISED,
    "tree_complexity": TREE_COMPLEXITY,
    "regularised+tree_complexity": {**REGULARISED, **TREE_COMPLEXITY},
    "regularised+tree_complexity+early_stopping": LOW_GAP,
}
#: Cuts for the checked levels of a tree, away from values that features take exactly.
EDGES = {
    "eps_estimate": [0.5 * i + 0.0123 for i in range(24)],
    "reported_eps": [0.5 * i + 0.0123 for i in range(24)],
    "surprise_pct": [5.0 * i + 0.0123 for i in range(-16, 17)],
    "return_60d": [0.01 * i + 0.00123 for i in range(-15, 16)],
    "sector_rank_60d": [0.05 * i + 0.0123 for i in range(20)],
}


def _split(spark, sf):
    return stored(SP.chrono_split(K.features(spark, sf), K.SPLIT_DATE))


def _fitted(spark, sf, kind="gbt", config=None):
    split = _split(spark, sf)
    return split, M.fit(kind, split.where(F.col("split") == "train"), config, FEATURES, LABEL)


def _agrees():
    """The class follows from the probability, which is one."""
    p = F.col("y_pred_proba")
    return ((F.col("y_pred") == (p > 0.5).cast("int")) & p.between(0, 1)).alias("agrees")


def _closed_form(model):
    """The logistic model's probability, computed again from its coefficients."""
    scaler, logistic = model.stages[1], model.stages[2]
    parts = zip(FEATURES, logistic.coefficients.toArray(), scaler.mean.toArray(), scaler.std.toArray(), strict=True)
    margin = sum(((F.col(f) - float(m)) / float(s) * float(c) for f, c, m, s in parts), F.lit(float(logistic.intercept)))
    return (F.abs(1 / (1 + F.exp(-margin)) - F.col("y_pred_proba")) < 1e-9).alias("closed_form")


def _scored(spark, sf, kind, config, *shown):
    split, model = _fitted(spark, sf, kind, config)
    return tidy(M.score(model, split).select("symbol", "date", "split", LABEL, *[f(model) for f in shown]))


def _class(model):
    return F.col("y_pred")


def _probability(model):
    return F.col("y_pred_proba")


def gbt_train(spark, sf):
    return _scored(spark, sf, "gbt", DEFAULT, _class, _probability)


def boosted_train(spark, sf):
    """Penalised trees with the production parameters, stopped on the validation rows."""
    split = SP.validation_slice(_split(spark, sf), K.VALIDATION_DATE)
    marked = split.withColumn("is_validation", F.col("is_validation") & (F.col("split") == "train"))
    model = M.fit("boosted", marked.where(F.col("split") == "train"), LOW_GAP, FEATURES, LABEL)
    return tidy(M.score(model, marked).select("symbol", "date", "split", "is_validation", LABEL, "y_pred", "y_pred_proba"))


def boosted_levels(spark, sf):
    """The first two levels of a penalised tree: sums of gradients, and the best cut of every node and feature."""
    train = _split(spark, sf).where(F.col("split") == "train")
    config = BO.BoostConfig.of({**CONFIGS["regularised"], **TREE_COMPLEXITY})
    weight = class_weight(train, label=LABEL).first()["scale_pos_weight"]
    edges = [EDGES[f] for f in FEATURES]
    rows = BO.blocks(stored(BO.binned(train, FEATURES, LABEL, edges, weight, F.lit(0).cast("bigint"), F.lit(False)), "binned"))
    tree, nodes, found = BO.Tree(), [0], []
    for _ in range(2):
        growing = BO.Growth(2 + max(map(len, edges)), tree, nodes, range(len(FEATURES)))
        level = BO.best_cuts(BO.gradient_histogram(rows, {0: growing}), {0: config}, growing.sums)
        found += level
        nodes = BO.split_nodes(tree, level, edges, config)
    unit = float(BO.UNIT)
    name = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("feature") + 1)
    shown = ["node", name.alias("feature"), "n", "bin", "gain", *[(F.col(c) / unit).alias(c) for c in ("g", "h", "gl", "hl")]]
    return tidy(spark.createDataFrame(found, BO.CUTS).select(*shown))


def logistic_train(spark, sf):
    return _scored(spark, sf, "logistic", None, lambda model: _agrees(), _closed_form)


def calibrated_train(spark, sf):
    return _scored(spark, sf, "calibrated", {"method": "sigmoid", "cv": 3, "base_config": DEFAULT}, _class, _probability)


def score(spark, sf):
    """The logistic model's predictions for every ticker's latest event."""
    split, model = _fitted(spark, sf, "logistic")
    return tidy(M.score(model, latest_event(split)).select("symbol", "date", _agrees(), _closed_form(model)))


def train_event_model(spark, sf):
    """Accuracy and precision per split of the default trees."""
    return tidy(M.train_event_model(_split(spark, sf), config=DEFAULT)[2])


def model_bundle(spark, sf):
    """Save, load and score again: both scores must agree."""
    split, model = _fitted(spark, sf, "logistic")
    path = scratch(spark, "bundle")
    M.save_bundle(model, path, {"features": FEATURES, "config": {}, "run_id": "logistic"}, spark)
    loaded, metadata = M.load_bundle(path, spark)
    keys = ["symbol", "date"]
    before = M.score(model, split).select(*keys, F.col("y_pred_proba").alias("before"))
    after = M.score(loaded, split.select(*keys, *metadata["features"])).select(*keys, F.col("y_pred_proba").alias("after"))
    return before.join(after, keys).select(*keys, (F.col("before") == F.col("after")).alias("same"))


def recommendation(spark, sf):
    split, model = _fitted(spark, sf, "gbt", DEFAULT)
    rows = S.recommendation(split, model, spike_threshold=K.THRESHOLD)
    features = [F.element_at("feature_values", F.lit(f)).alias(f) for f in FEATURES]
    outcome = [F.col(f"historical_outcome.{c}").alias(c) for c in ("close_ret", "high_ret")]
    shown = ["ticker", "as_of_date", "sector", "predicted_class", "predicted_label", "confidence", "spike_threshold"]
    return tidy(rows.select(*shown, *features, *outcome))


def scenario_analysis(spark, sf):
    _, model = _fitted(spark, sf, "gbt", DEFAULT)
    rows = S.scenario_analysis(K.earnings(spark, sf), _snapshot(spark, sf), model, AS_OF)
    shown = ["ticker", "upcoming_earnings_date", "as_of_date", "sector", "surprise_pct", "reported_eps"]
    return tidy(rows.select(*shown, "spike_probability", "predicted_label"))


def feature_attribution(spark, sf):
    """The ranked contributions of each feature to the log-odds of each ticker's latest event."""
    split, model = _fitted(spark, sf, "gbt", DEFAULT)
    told = stored(S.feature_attribution(latest_event(split), model, split.where(F.col("split") == "train")), "attribution")
    ranked = S.attribution_rank(told).select("symbol", "date", "feature", "contribution", "place")
    return tidy(ranked.join(told.select("symbol", "base"), "symbol"))


def overfitting_sweep(spark, sf):
    return tidy(X.overfitting_sweep(K.features(spark, sf), K.SPLIT_DATE, K.VALIDATION_DATE, CONFIGS))


def baseline_compare(spark, sf):
    return tidy(X.baseline_compare(K.features(spark, sf), K.SPLIT_DATE, DEFAULT))


def walk_forward(spark, sf):
    """Metrics, gap and KPIs of every fold's own model."""
    return tidy(X.walk_forward(K.features(spark, sf), K.SPLIT_DATE, 6, DEFAULT)[0])


def walk_forward_summary(spark, sf):
    """Mean, spread, least and largest value of each metric over the folds."""
    return tidy(X.walk_forward(K.features(spark, sf), K.SPLIT_DATE, 6, DEFAULT)[1])


def calibration_compare(spark, sf):
    """Three scores with their Brier score and KPIs, one row for each filled reliability bin."""
    table, curve = X.calibration_compare(K.features(spark, sf), K.SPLIT_DATE, DEFAULT, cv=5)
    return tidy(table.join(curve.withColumnRenamed("count", "binned"), "run_id"))


def gap_robustness(spark, sf):
    return tidy(X.gap_robustness(K.features(spark, sf), K.SPLIT_DATE, K.VALIDATION_DATE, LOW_GAP))


def horizon_alignment(spark, sf):
    daily, long = K.features_each(spark, sf, [(1, "high"), (20, "close")])
    return tidy(X.horizon_alignment(daily, long, 20, K.SPLIT_DATE, DEFAULT))


def sue_compare(spark, sf):
    return tidy(X.sue_compare(K.features(spark, sf, with_sue=True), K.SPLIT_DATE, DEFAULT))


def survivorship_models(spark, sf):
    life = MB.ticker_lifespans(*K.membership(spark, sf))
    return tidy(X.survivorship_models(K.features(spark, sf), life, K.SPLIT_DATE, DEFAULT))


def alignment_models(spark, sf):
    """Each label's own model; the limit order trades the high label's signals."""
    high, close = K.features_each(spark, sf, [(1, "high"), (1, "close")])
    return tidy(X.alignment_models(high, close, K.SPLIT_DATE, K.THRESHOLD, DEFAULT))


def advice_model(spark, sf):
    """Explanations of the fitted model's recommendations for sampled tickers, checked: the fixed text invents nothing."""
    split, model = _fitted(spark, sf, "logistic")
    sampled = latest_event(split).join(seeded_ticker_sample(split, 30), "symbol", "left_semi")
    told = S.render_fallback(S.render_prompt(S.recommendation(sampled, model, spike_threshold=K.THRESHOLD)))
    checked = C.check_explanations(told)
    return tidy(checked.select("ticker", "as_of_date", *[F.size(F.col(c)).cast("bigint").alias(n) for n, c in C.CHECKS.items()]))


QUERIES = {
    f.__name__: f
    for f in (
        gbt_train, boosted_train, boosted_levels, logistic_train, calibrated_train, score, train_event_model, model_bundle, recommendation,
        scenario_analysis, feature_attribution, overfitting_sweep, baseline_compare, walk_forward,
        walk_forward_summary, calibration_compare, gap_robustness, horizon_alignment, sue_compare, survivorship_models, alignment_models,
        advice_model,
    )
}

LATEST = "SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1"
ROWS = "SELECT symbol, date, split, CAST(target_spike_class AS BIGINT) AS target_spike_class, true AS agrees"

_ALPHA, _LAMBDA, _LEAST = REGULARISED["reg_alpha"], REGULARISED["reg_lambda"], TREE_COMPLEXITY["min_child_weight"]


def _score(g, h):
    """What a leaf of these sums gains."""
    return f"pow(greatest(abs(({g})::DOUBLE / {BO.UNIT}) - {_ALPHA}, 0), 2) / (({h})::DOUBLE / {BO.UNIT} + {_LAMBDA})"


def _level(rows):
    """Sums and best cut of every (node, feature), from long rows with a bin."""
    gain = f"{_score('gl', 'hl')} + {_score('ga - gl', 'ha - hl')} - {_score('ga', 'ha')}"
    least = _LEAST * BO.UNIT
    return f"""SELECT node, feature, max(ga) AS g, max(ha) AS h, max(na) AS n, arg_max(bin, (gain, -bin)) FILTER (WHERE ok) AS bin,
        arg_max(gl, (gain, -bin)) FILTER (WHERE ok) AS gl, arg_max(hl, (gain, -bin)) FILTER (WHERE ok) AS hl, max(gain) FILTER (WHERE ok) AS gain
    FROM (SELECT *, {gain} AS gain, nl < na AND hl >= {least} AND ha - hl >= {least} AND {gain} > {BO.LEAST_GAIN} AS ok
        FROM (SELECT node, feature, bin, sum(g) OVER run AS gl, sum(h) OVER run AS hl, sum(n) OVER run AS nl,
                sum(g) OVER whole AS ga, sum(h) OVER whole AS ha, sum(n) OVER whole AS na
            FROM (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {rows} GROUP BY node, feature, bin)
            WINDOW run AS (PARTITION BY node, feature ORDER BY bin), whole AS (PARTITION BY node, feature)))
    GROUP BY node, feature"""


_BINS = " UNION ALL ".join(
    f"SELECT symbol, date, {i} AS feature, 1 + len(list_filter({EDGES[f]}, lambda e: e < {f}))::INTEGER AS bin, g, h FROM graded"
    for i, f in enumerate(FEATURES)
)
LEVELS = {
    "graded": f"""SELECT t.*, round(w * (0.5 - target_spike_class) * {BO.UNIT})::BIGINT AS g, round(w * 0.25 * {BO.UNIT})::BIGINT AS h
        FROM (SELECT *, CASE WHEN target_spike_class = 1 THEN (SELECT (count(*) FILTER (WHERE target_spike_class = 0))::DOUBLE
            / count(*) FILTER (WHERE target_spike_class = 1) FROM scored WHERE split = 'train') ELSE 1 END AS w
        FROM scored WHERE split = 'train') t""",
    "cells": _BINS,
    "rooted": "SELECT *, 0 AS node FROM cells",
    "first_level": _level("rooted"),
    "root_cut": "SELECT feature, bin FROM first_level WHERE bin IS NOT NULL ORDER BY gain DESC, feature LIMIT 1",
    "sided": """SELECT c.* EXCLUDE (node), CASE WHEN o.bin <= r.bin THEN 1 ELSE 2 END AS node FROM rooted c
        JOIN rooted o USING (symbol, date) JOIN root_cut r ON o.feature = r.feature""",
    "second_level": _level("sided"),
}
_NAMED = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "][feature + 1]"

SQL = {
    "model_bundle": with_ctes("SELECT symbol, date, true AS same FROM scored"),
    "boosted_levels": with_ctes(
        f"""SELECT CAST(node AS BIGINT) AS node, {_NAMED} AS feature, CAST(n AS BIGINT) AS n, CAST(bin AS BIGINT) AS bin, {r6('gain')},
        {", ".join(r6(f"{c}::DOUBLE / {BO.UNIT}", c) for c in ("g", "h", "gl", "hl"))}
        FROM (SELECT * FROM first_level UNION ALL SELECT * FROM second_level)""",
        LEVELS,
    ),
    "logistic_train": with_ctes(f"{ROWS}, true AS closed_form FROM scored"),
    "score": with_ctes("SELECT symbol, date, true AS agrees, true AS closed_form FROM latest", {"latest": LATEST}),
    "advice_model": with_ctes(
        """SELECT symbol AS ticker, date AS as_of_date, 0::BIGINT AS faithful, 0::BIGINT AS no_leak, 0::BIGINT AS no_confusion FROM latest
        WHERE symbol IN (SELECT symbol FROM (SELECT DISTINCT symbol FROM scored) ORDER BY md5(concat_ws('|', 42, symbol)), symbol LIMIT 30)""",
        {"latest": LATEST},
    ),
}

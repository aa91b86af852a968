"""Studies that fit models. Each fit is a distributed job; the loop is over configurations."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators.metrics import brier_score, calibration_curve, classification_metrics, fold_summary
from ..operators.membership import universe_current
from ..operators.models import SIDE_BY_SIDE, fit_calibrated_each, fit_each, score_split, train_event_model
from ..operators.portfolio import RUN, backtest_kpis, exclude_top_each, limit_order_returns, payoff_stats
from ..operators.splits import chrono_split, complete_rows, validation_slice, walk_forward_folds
from ..schemas import FEATURES, KPIS, LABEL, RETURN, SUE_FEATURES, target
from ..storage import stored
from .backtests import CAP, event_backtest, signals, tranche_backtest


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _fit_all(fits: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The scored rows of independent fits, stored once so that no model scores twice."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return stored(_stack(list(pool.map(lambda fit: fit(), fits))), "scored")


def _gap(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test and train metrics side by side with their gap."""
    wide = metrics.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("split") == split, F.col(m))).alias(name)
            for split, m, name in (
                ("test", "accuracy", "accuracy"),
                ("test", "precision", "precision"),
                ("train", "accuracy", "train_accuracy"),
                ("train", "precision", "train_precision"),
            )
        ],
        F.max(F.when(F.col("split") == "train", F.col("rows"))).alias("n_train"),
        F.max(F.when(F.col("split") == "test", F.col("rows"))).alias("n_test"),
    )
    return wide.withColumn("gap", F.col("train_precision") - F.col("precision"))


def run_config(
    split: DataFrame,
    label: str,
    kind: str = "gbt",
    config: Mapping[str, object] | None = None,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Fit one configuration and return its scored rows under ``run_id = label``."""
    _, scored, _ = train_event_model(split, kind, config, features)
    return scored.withColumn("run_id", F.lit(label))


def compare(runs: DataFrame, cap: float = CAP, ret: str = RETURN) -> DataFrame:
    """Metrics, gap and KPIs of several scored runs in one job."""
    metrics = _gap(classification_metrics(runs, [*RUN, "split"]), RUN)
    kpis = event_backtest(runs.where(F.col("split") == "test"), cap=cap, ret=ret)
    return metrics.join(kpis, list(RUN))


def overfitting_sweep(
    features: DataFrame,
    split_date: dt.date,
    validation_date: dt.date,
    configs: Mapping[str, Mapping[str, object]],
    kind: str = "boosted",
) -> DataFrame:
    """Train/test gap, metrics and KPIs of each configuration against the ``baseline`` one.

    All configurations are fitted by the same booster, so they differ in their parameters alone; their trees
    grow in the same jobs.
    """
    split = stored(chrono_split(features, split_date))

    def rows_of(config: Mapping[str, object]) -> DataFrame:
        rows = validation_slice(split, validation_date) if "early_stopping_rounds" in config else split
        if "is_validation" in rows.columns:
            rows = rows.withColumn("is_validation", F.col("is_validation") & (F.col("split") == "train"))
        return rows

    parts = [rows_of(config) for config in configs.values()]
    models = fit_each(kind, [(rows.where(F.col("split") == "train"), config) for rows, config in zip(parts, configs.values(), strict=True)])
    scored = [
        score_split(model, rows).withColumn("run_id", F.lit(label)).drop("is_validation")
        for label, model, rows in zip(configs, models, parts, strict=True)
    ]
    runs = stored(_stack(scored), "scored")
    table = stored(compare(runs), "sweep")
    base = table.where(F.col("run_id") == "baseline").select(F.col("gap").alias("_base")).first()
    return table.withColumn("gap_vs_baseline", F.col("gap") - F.lit(base["_base"]))


def baseline_compare(features: DataFrame, split_date: dt.date, config: Mapping[str, object] | None = None) -> DataFrame:
    """Boosted trees against the logistic model: metrics, KPIs, payoff and trimmed returns."""
    split = stored(chrono_split(features, split_date))
    runs = [lambda: run_config(split, "gbt", "gbt", config), lambda: run_config(split, "logistic", "logistic")]
    return robust_compare(_fit_all(runs))


def robust_compare(runs: DataFrame, ns: Sequence[int] = (5, 10), cap: float = CAP) -> DataFrame:
    """`compare` with payoff statistics and the return after trimming the best trades."""
    trades = signals(runs.where(F.col("split") == "test"))
    trimmed = backtest_kpis(exclude_top_each(trades, ns), [*RUN, "excluded"], cap=cap)
    wide = trimmed.groupBy(*RUN).agg(
        *[F.max(F.when(F.col("excluded") == n, F.col("total_return"))).alias(f"return_excl_top{n}") for n in ns]
    )
    return compare(runs, cap).join(payoff_stats(trades), list(RUN), "left").join(wide, list(RUN), "left")


def walk_forward(
    features: DataFrame,
    start: dt.date,
    months: int = 6,
    config: Mapping[str, object] | None = None,
    kind: str = "gbt",
    cap: float = CAP,
) -> tuple[DataFrame, DataFrame]:
    """A fresh model per fold on all earlier rows, and the summary over folds."""
    rows = stored(features.na.drop(subset=[*FEATURES, LABEL]))
    folds = walk_forward_folds(rows, start, months)

    def fit(fold: Row) -> DataFrame:
        date = F.col("date")
        split = F.when(date < F.lit(fold["test_start"]), "train").when(date < F.lit(fold["test_end"]), "test")
        part = rows.withColumn("split", split).where(F.col("split").isNotNull())
        return run_config(part, f"fold {fold['fold']:03d}", kind, config)

    # One row per fold; folds are months apart, so there are few.
    known = folds.where(F.col("n_train") > 0).orderBy("fold").collect()
    per_fold = stored(compare(_fit_all([lambda fold=fold: fit(fold) for fold in known]), cap), "folds")
    return per_fold, fold_summary(per_fold, ["precision", "gap", *KPIS])


def calibration_compare(
    features: DataFrame,
    split_date: dt.date,
    config: Mapping[str, object] | None = None,
    cv: int = 5,
    bins: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Uncalibrated, sigmoid and isotonic scores: Brier score and KPIs, and reliability per bin.

    Both calibrations are fitted on the same trees of each fold.
    """
    split = stored(chrono_split(features, split_date))
    methods = ("sigmoid", "isotonic")

    def calibrated() -> DataFrame:
        models = fit_calibrated_each(split.where(F.col("split") == "train"), methods, cv, config)
        return _stack([score_split(model, split).withColumn("run_id", F.lit(m)) for m, model in zip(methods, models, strict=True)])

    scored = _fit_all([lambda: run_config(split, "uncalibrated", "gbt", config), calibrated])
    test = scored.where(F.col("split") == "test")
    table = compare(scored).join(brier_score(test, RUN), list(RUN))
    return table, calibration_curve(test, bins, RUN)


def sue_compare(features: DataFrame, split_date: dt.date, config: Mapping[str, object] | None = None) -> DataFrame:
    """The raw surprise against the standardised one as a feature. Needs a ``sue`` column.

    The rows that are complete for either model are stored once, and each model takes its own of them.
    """
    own = [f for f in (*FEATURES, *SUE_FEATURES) if (f in FEATURES) != (f in SUE_FEATURES)]
    shared = [f for f in FEATURES if f in SUE_FEATURES]
    split = stored(chrono_split(features.na.drop("all", subset=own), split_date, shared))

    def fit(label: str, names: Sequence[str]) -> DataFrame:
        return run_config(complete_rows(split, names), label, "gbt", config, names)

    return robust_compare(_fit_all([lambda: fit("raw_surprise", FEATURES), lambda: fit("sue", SUE_FEATURES)]))


def gap_robustness(
    features: DataFrame,
    split_date: dt.date,
    validation_date: dt.date,
    config: Mapping[str, object],
    ns: Sequence[int] = (5, 10, 20),
    kind: str = "boosted",
) -> DataFrame:
    """The low-gap configuration with its return after each trim."""
    split = validation_slice(chrono_split(features, split_date), validation_date)
    split = split.withColumn("is_validation", F.col("is_validation") & (F.col("split") == "train"))
    runs = run_config(stored(split), "lowest_gap", kind, config).drop("is_validation")
    return robust_compare(stored(runs), ns)


def horizon_alignment(
    daily: DataFrame,
    long: DataFrame,
    horizon: int,
    split_date: dt.date,
    config: Mapping[str, object] | None = None,
) -> DataFrame:
    """One-day trades on the high label against ``horizon``-day tranches on the close label."""
    ret = target(horizon, "close")

    def fit(rows: DataFrame, label: str) -> DataFrame:
        return stored(run_config(stored(chrono_split(rows, split_date)), label, "gbt", config))

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        one, far = pool.map(fit, (daily, long), ("t1", f"t{horizon}"))
    known = far.where((F.col("split") == "test") & F.col(ret).isNotNull())
    metrics = _gap(
        classification_metrics(one, [*RUN, "split"]).unionByName(classification_metrics(far, [*RUN, "split"])), RUN
    )
    test = one.where(F.col("split") == "test")
    kpis = event_backtest(test, cap=CAP).unionByName(tranche_backtest(known, horizon, ret=ret))
    return metrics.join(kpis, list(RUN))


def survivorship_models(
    features: DataFrame, lifespans: DataFrame, split_date: dt.date, config: Mapping[str, object] | None = None
) -> DataFrame:
    """A model fitted and traded on every symbol, and one on current members only."""
    everyone = stored(chrono_split(features, split_date), "universe")
    survivors = stored(universe_current(everyone, lifespans), "universe")
    fits = [lambda: run_config(everyone, "all_incl_delisted", "gbt", config), lambda: run_config(survivors, "current_only", "gbt", config)]
    return compare(_fit_all(fits))


def alignment_models(
    high: DataFrame,
    close: DataFrame,
    split_date: dt.date,
    threshold: float,
    config: Mapping[str, object] | None = None,
    cap: float = CAP,
) -> DataFrame:
    """A model of the high label, sold at the close or by a limit order, and one of the close label.

    ``high`` and ``close`` are the same features under both labels.
    """
    fits = [
        lambda: run_config(stored(chrono_split(high, split_date)), "mismatched", "gbt", config),
        lambda: run_config(stored(chrono_split(close, split_date)), "close_aligned", "gbt", config),
    ]
    runs = _fit_all(fits)
    of_high = runs.where(F.col("run_id") == "mismatched").withColumn("run_id", F.lit("limit_order_aligned"))
    limited = limit_order_returns(of_high.where(F.col("split") == "test"), threshold)
    metrics = _gap(classification_metrics(of_high, [*RUN, "split"]), RUN)
    limit = metrics.join(event_backtest(limited, cap=cap, ret="realized_return"), list(RUN))
    return compare(runs, cap).unionByName(limit)

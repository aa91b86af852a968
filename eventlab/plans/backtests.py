"""Backtests and the parameter studies around them.

A study's parameter is an extra key of the trades, so each study is one job over one
set of trades. Plans that read their trades several times take them checkpointed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import pead_rule
from ..operators.membership import universe_current
from ..operators.metrics import classification_metrics, fold_summary, spike_rate
from ..operators.portfolio import (
    RUN,
    backtest_kpis,
    fill_runs,
    filter_signals,
    limit_order_returns,
    payoff_stats,
    robustness_table,
    tranche_kpis,
    tranche_trades,
    with_parameter,
)
from ..operators.resample import bootstrap_kpis, confidence_interval, exposure_matched_random
from ..operators.splits import fold_assign, walk_forward_folds
from ..schemas import KPIS, RETURN, target

CAP = 0.2


def signals(predictions: DataFrame, threshold: float = 0.5, ret: str = RETURN) -> DataFrame:
    """Trades the strategy places and whose outcome is known."""
    return filter_signals(predictions.where(F.col(ret).isNotNull()), threshold)


def event_backtest(
    predictions: DataFrame,
    keys: Sequence[str] = RUN,
    threshold: float = 0.5,
    cost: float = 0.001,
    cap: float | None = None,
    ret: str = RETURN,
) -> DataFrame:
    """KPIs per run; a run whose predictions give no trade has zeros."""
    runs = predictions.select(*keys).distinct()
    return fill_runs(backtest_kpis(signals(predictions, threshold, ret), keys, ret, cost, cap), runs, keys)


def tranche_backtest(
    predictions: DataFrame,
    horizon: int,
    keys: Sequence[str] = RUN,
    threshold: float = 0.5,
    tranches: int | None = None,
    cost: float = 0.001,
    ret: str = RETURN,
) -> DataFrame:
    runs = predictions.select(*keys).distinct()
    trades = signals(predictions, threshold, ret)
    return fill_runs(tranche_kpis(trades, horizon, tranches, keys, ret, cost), runs, keys)


def cost_sweep(trades: DataFrame, costs: Sequence[float] = (0.001, 0.003, 0.006, 0.015), cap: float | None = CAP):
    swept = with_parameter(trades, "cost", [float(c) for c in costs])
    return backtest_kpis(swept, [*RUN, "cost"], cost=F.col("cost"), cap=cap)


def position_sizing(trades: DataFrame, caps: Sequence[float] = (0.05, 0.1, 0.2, 0.33, 0.5, 1.0)) -> DataFrame:
    swept = with_parameter(trades, "max_position_weight", [float(c) for c in caps])
    return backtest_kpis(swept, [*RUN, "max_position_weight"], cap=F.col("max_position_weight"))


def threshold_sweep(
    predictions: DataFrame, thresholds: Sequence[float] = (0.02, 0.05, 0.07, 0.10), cap: float | None = CAP
) -> DataFrame:
    """Share of positive labels, and KPIs when trades exit at the label's threshold."""
    rates = spike_rate(predictions, thresholds)
    trades = with_parameter(signals(predictions), "threshold", [float(t) for t in thresholds])
    limited = limit_order_returns(trades, F.col("threshold"))
    kpis = backtest_kpis(limited, [*RUN, "threshold"], "realized_return", cap=cap)
    return kpis.join(rates.select("threshold", "positive_rate"), "threshold")


def target_execution_alignment(predictions: DataFrame, threshold: float = 0.07, cap: float = CAP) -> DataFrame:
    """High label with close exit, close label, and high label with a limit order exit."""
    high_hit = (F.col(target(1, "high")) > threshold).cast("int")
    close_hit = (F.col(RETURN) > threshold).cast("int")
    scored = limit_order_returns(predictions.where(F.col(RETURN).isNotNull()), threshold)
    variant = F.explode(
        F.array(
            F.struct(F.lit("mismatched").alias("variant"), high_hit.alias("_label"), F.col(RETURN).alias("_ret")),
            F.struct(F.lit("close_aligned").alias("variant"), close_hit.alias("_label"), F.col(RETURN).alias("_ret")),
            F.struct(
                F.lit("limit_order_aligned").alias("variant"),
                high_hit.alias("_label"),
                F.col("realized_return").alias("_ret"),
            ),
        )
    )
    variants = scored.select("date", "symbol", "y_pred", "y_pred_proba", variant.alias("_v")).select(
        "date", "symbol", "y_pred", "y_pred_proba", "_v.*"
    )
    metrics = classification_metrics(variants, ["variant"], "_label").drop("rows")
    kpis = backtest_kpis(filter_signals(variants), ["variant"], "_ret", cap=cap)
    return metrics.join(kpis, "variant")


def survivorship_compare(predictions: DataFrame, lifespans: DataFrame, cap: float = CAP) -> DataFrame:
    """The same score on current members only and on every symbol."""
    everyone = predictions.withColumn("universe", F.lit("all_incl_delisted"))
    survivors = universe_current(predictions, lifespans).withColumn("universe", F.lit("current_only"))
    both = everyone.unionByName(survivors)
    metrics = classification_metrics(both, ["universe"])
    return metrics.join(backtest_kpis(signals(both), ["universe"], cap=cap), "universe")


def robustness(predictions: DataFrame, ns: Sequence[int] = (5, 10, 20), cap: float = CAP) -> DataFrame:
    return robustness_table(signals(predictions), ns, cap=cap)


def baseline_rules(predictions: DataFrame, seeds: int = 20, cap: float = CAP) -> DataFrame:
    """The positive surprise rule, and random trades with the exposure of the scored run."""
    known = predictions.where(F.col(RETURN).isNotNull())
    rule = signals(pead_rule(known))
    rule_kpis = backtest_kpis(rule, cap=cap).select(F.lit("pead_rule").alias("config"), *KPIS)
    random_kpis = exposure_matched_random(known, signals(known), seeds, cap=cap)
    return rule_kpis.unionByName(random_kpis.select(F.lit("exposure_matched_random").alias("config"), *KPIS))


def kpi_intervals(
    trades: DataFrame, reps: int = 2000, seed: int = 42, level: float = 0.95, cap: float | None = CAP
) -> DataFrame:
    """Each KPI with its bootstrap interval."""
    samples = bootstrap_kpis(trades, reps, seed, cap=cap)
    bounds = confidence_interval(samples, KPIS, level)
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("point_estimate")) for k in KPIS]))
    point = backtest_kpis(trades, cap=cap).select(*RUN, named.alias("_p")).select(*RUN, "_p.*")
    return point.join(bounds, [*RUN, "metric"])


def walk_forward_rule(
    scored: DataFrame, start: dt.date, months: int = 6, cap: float = CAP
) -> tuple[DataFrame, DataFrame]:
    """Metrics and KPIs per fold for a score that needs no training, and their summary."""
    folds = walk_forward_folds(scored, start, months)
    assigned = fold_assign(scored, folds, start, months)
    metrics = classification_metrics(assigned, ["fold"]).select("fold", "precision")
    kpis = backtest_kpis(signals(assigned), ["fold"], cap=cap)
    per_fold = fill_runs(kpis, folds.where(F.col("n_train") > 0).join(metrics, "fold"), ["fold"])
    return per_fold, fold_summary(per_fold, ["precision", *KPIS])


def horizon_rule(predictions: DataFrame, horizon: int, ns: Sequence[int] = (5, 10)) -> DataFrame:
    """Tranche backtest of a longer horizon with the payoff of the accepted trades."""
    ret = target(horizon, "close")
    trades = signals(predictions, ret=ret)
    accepted = tranche_trades(trades, horizon)
    kpis = tranche_backtest(predictions, horizon, ret=ret)
    return kpis.join(payoff_stats(accepted, ret=ret), list(RUN))

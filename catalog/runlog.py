"""Queries on the experiment log."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.operators import runlog as R
from eventlab.schemas import KPIS, LOG_METRICS
from eventlab.sources import market as K
from eventlab.sources.runlog import RunLog
from eventlab.storage import scratch

from .ctes import with_ctes
from .shape import r6, r6_all, tidy


def run_labels(spark, sf):
    rows = R.run_labels(K.run_log(spark, sf))
    return tidy(rows.select("run_id", "experiment", "run_number", "run_label", "accuracy"))


def config_expand(spark, sf):
    rows = R.config_expand(K.run_log(spark, sf), ["k"])
    return tidy(rows.select("run_id", "config_k"))


def config_long(spark, sf):
    return R.config_long(K.run_log(spark, sf))


def report_table(spark, sf):
    rows = R.report_table(K.run_log(spark, sf), ["k"])
    return tidy(rows.select("experiment", "run_label", "config_k", *LOG_METRICS))


def config_diff(spark, sf):
    rows = R.config_diff(K.run_log(spark, sf))
    shown = F.transform(
        F.array_sort(F.map_keys("config_changed")),
        lambda k: F.concat_ws(
            "",
            k,
            F.lit(":"),
            F.element_at("config_changed", k)["old"],
            F.lit("->"),
            F.element_at("config_changed", k)["new"],
        ),
    )
    return tidy(
        rows.select(
            "experiment",
            "run_label",
            "prev_run_label",
            F.array_join(shown, ";").alias("changed"),
            *[f"{m}_delta" for m in LOG_METRICS],
        )
    )


def train_test_gap(spark, sf):
    return tidy(R.train_test_gap(K.run_log(spark, sf)))


def gap_vs_backtest(spark, sf):
    return tidy(R.gap_vs_backtest(K.run_log(spark, sf)))


def run_counts(spark, sf):
    return tidy(R.run_counts(K.run_log(spark, sf)))


def gap_correlation(spark, sf):
    return tidy(R.gap_correlation(R.complete_gaps(K.run_log(spark, sf)), ["experiment"]))


def gap_correlation_all(spark, sf):
    return tidy(R.gap_correlation(R.complete_gaps(K.run_log(spark, sf))))


def top_runs(spark, sf):
    return tidy(R.top_runs(K.run_log(spark, sf), "total_return", 10).select("run_id", *LOG_METRICS))


def lowest_gap(spark, sf):
    rows = R.with_gap(K.run_log(spark, sf)).na.drop(subset=["gap", "total_return"])
    return tidy(R.lowest_gap(rows.select("run_id", "gap", *KPIS), 5))


def _log(spark, sf) -> RunLog:
    log = RunLog(spark, scratch(spark, "runlog"))
    log.append_training(K.run_log(spark, sf))
    return log


def run_log_append(spark, sf):
    """All runs appended in two batches, read back without KPIs."""
    log = RunLog(spark, scratch(spark, "runlog"))
    runs = K.run_log(spark, sf)
    log.append_training(runs.where(F.col("total_return").isNull()))
    log.append_training(runs.where(F.col("total_return").isNotNull()))
    return tidy(log.load().drop("timestamp"))


def run_log_upsert(spark, sf):
    """KPIs of backtested runs, then a correction of the return of profitable ones."""
    log = _log(spark, sf)
    runs = K.run_log(spark, sf).where(F.col("total_return").isNotNull())
    log.append_backtest(runs.withColumn("logged_at", F.col("timestamp")))
    later = F.col("timestamp") + F.expr("INTERVAL 1 DAY")
    fixed = runs.where(F.col("total_return") > 0).select(
        "run_id", later.alias("logged_at"), (F.col("total_return") / 2).alias("total_return")
    )
    log.append_backtest(fixed)
    return tidy(log.load().select("run_id", *KPIS))


def run_log_load(spark, sf):
    log = _log(spark, sf)
    runs = K.run_log(spark, sf).where(F.col("total_return").isNotNull())
    log.append_backtest(runs.withColumn("logged_at", F.col("timestamp")))
    return tidy(log.load().select("run_id", "config_json", "accuracy", "precision", "train_precision", *KPIS))


def run_log_compact(spark, sf):
    """KPIs, a correction logged for the same time, a compaction, a later Sharpe ratio, a late fact that counts no more."""
    log = _log(spark, sf)
    runs = K.run_log(spark, sf).where(F.col("total_return").isNotNull()).withColumn("logged_at", F.col("timestamp"))
    log.append_backtest(runs)
    log.append_backtest(runs.where("total_return > 0").select("run_id", "logged_at", (F.col("total_return") / 2).alias("total_return")))
    log.compact()
    later = F.col("timestamp") + F.expr("INTERVAL 1 HOUR")
    log.append_backtest(runs.where("win_rate > 0.5").select("run_id", later.alias("logged_at"), (F.col("sharpe") + 1).alias("sharpe")))
    earlier = F.col("timestamp") - F.expr("INTERVAL 1 HOUR")
    log.append_backtest(runs.select("run_id", earlier.alias("logged_at"), F.lit(-9.0).alias("max_drawdown")))
    log.compact()
    return tidy(log.load().select("run_id", *KPIS))


QUERIES = {
    f.__name__: f
    for f in (
        run_labels, config_expand, config_long, report_table, config_diff, train_test_gap, gap_vs_backtest,
        run_counts, gap_correlation, gap_correlation_all, top_runs, lowest_gap, run_log_append, run_log_upsert,
        run_log_load, run_log_compact,
    )
}

CONFIG_K = "json_extract_string(config_json, '$.k')"
LAGGED = "WINDOW w AS (PARTITION BY experiment ORDER BY timestamp, run_id)"
CORRELATIONS = ", ".join(
    r6(f"CASE WHEN isnan(corr(gap, {c})) THEN NULL ELSE corr(gap, {c}) END", f"gap_{c}")
    for c in ("win_rate", "total_return", "sharpe")
)

SQL = {
    "run_labels": with_ctes(f"SELECT run_id, experiment, run_number, run_label, {r6('accuracy')} FROM labelled"),
    "config_expand": with_ctes(f"SELECT run_id, {CONFIG_K} AS config_k FROM runs"),
    "config_long": with_ctes(f"SELECT run_id, 'k' AS key, {CONFIG_K} AS value FROM runs"),
    "report_table": with_ctes(
        f"SELECT experiment, run_label, {CONFIG_K} AS config_k, {r6_all(*LOG_METRICS)} FROM labelled"
    ),
    "config_diff": with_ctes(
        f"""SELECT experiment, run_label, 'Run ' || (run_number - 1) AS prev_run_label,
        CASE WHEN k IS DISTINCT FROM old_k THEN 'k:' || coalesce(old_k, '') || '->' || coalesce(k, '') ELSE '' END AS changed,
        {', '.join(r6(f'{m}_d', f'{m}_delta') for m in LOG_METRICS)} FROM (
            SELECT *, {CONFIG_K} AS k, lag({CONFIG_K}) OVER w AS old_k,
            {', '.join(f'{m} - lag({m}) OVER w AS {m}_d' for m in LOG_METRICS)} FROM labelled {LAGGED})
        WHERE run_number > 1"""
    ),
    "train_test_gap": with_ctes(
        f"SELECT experiment, run_label, {r6_all('train_precision', 'precision', 'gap')} FROM gaps"
    ),
    "gap_vs_backtest": with_ctes(
        f"""SELECT experiment, run_label, {r6_all('train_precision', 'precision', *KPIS, 'gap')} FROM gaps
        WHERE gap IS NOT NULL AND total_return IS NOT NULL"""
    ),
    "run_counts": with_ctes(
        "SELECT experiment, count(*) AS total_runs, count(total_return) AS backtested_runs FROM runs GROUP BY experiment"
    ),
    "gap_correlation": with_ctes(
        f"""SELECT experiment, {CORRELATIONS} FROM gaps WHERE gap IS NOT NULL AND total_return IS NOT NULL GROUP BY experiment"""
    ),
    "gap_correlation_all": with_ctes(
        f"SELECT {CORRELATIONS} FROM gaps WHERE gap IS NOT NULL AND total_return IS NOT NULL"
    ),
    "top_runs": with_ctes(
        f"""SELECT run_id, {r6_all(*LOG_METRICS)} FROM
        (SELECT * FROM runs ORDER BY total_return DESC NULLS LAST, run_id LIMIT 10)"""
    ),
    "lowest_gap": with_ctes(
        f"""SELECT run_id, {r6_all('gap', *KPIS)} FROM (SELECT *, train_precision - precision AS gap FROM runs
        WHERE train_precision IS NOT NULL AND total_return IS NOT NULL ORDER BY gap, run_id LIMIT 5)"""
    ),
    "run_log_append": with_ctes(
        f"""SELECT run_id, config_json, {r6_all('accuracy', 'precision', 'train_accuracy', 'train_precision')},
        {', '.join(f'NULL::DOUBLE AS {k}' for k in KPIS)} FROM runs"""
    ),
    "run_log_upsert": with_ctes(
        f"""SELECT run_id, {r6('CASE WHEN total_return > 0 THEN total_return / 2 ELSE total_return END', 'total_return')},
        {', '.join(r6(f'CASE WHEN total_return IS NOT NULL THEN {k} END', k) for k in KPIS[1:])} FROM runs"""
    ),
    "run_log_load": with_ctes(
        f"""SELECT run_id, config_json, {r6_all('accuracy', 'precision', 'train_precision', 'total_return')},
        {', '.join(r6(f'CASE WHEN total_return IS NOT NULL THEN {k} END', k) for k in KPIS[1:])} FROM runs"""
    ),
    "run_log_compact": with_ctes(
        f"""SELECT run_id, {r6('CASE WHEN total_return > 0 THEN total_return / 2 ELSE total_return END', 'total_return')},
        {r6('CASE WHEN total_return IS NOT NULL THEN win_rate END', 'win_rate')},
        {r6('CASE WHEN total_return IS NOT NULL THEN coalesce(max_drawdown, -9) END', 'max_drawdown')},
        {r6('CASE WHEN total_return IS NOT NULL THEN CASE WHEN win_rate > 0.5 THEN sharpe + 1 ELSE sharpe END END', 'sharpe')} FROM runs"""
    ),
}

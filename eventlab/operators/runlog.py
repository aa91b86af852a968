"""Analytics over the log of experiment runs.

A log row is one run: ``run_id, timestamp, config_json``, its metrics and KPIs. ``keys``
name the columns that separate independent histories (none for a single history).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import number_sorted
from ..schemas import KPIS, LOG_METRICS

HISTORY = ("experiment",)
CONFIG = "map<string,string>"


def config_map() -> Column:
    return F.from_json(F.coalesce("config_json", F.lit("{}")), CONFIG)


def run_labels(log: DataFrame, keys: Sequence[str] = HISTORY) -> DataFrame:
    """``Run 1``, ``Run 2``, ... in order of time within each history."""
    numbered = number_sorted(log, keys, ["timestamp", "run_id"], "run_number")
    return numbered.withColumn("run_label", F.concat(F.lit("Run "), F.col("run_number").cast("string")))


def config_long(log: DataFrame) -> DataFrame:
    """One row per run and config key."""
    return log.select("run_id", F.explode(config_map()).alias("key", "value"))


def config_keys(log: DataFrame) -> DataFrame:
    """The distinct config keys, one row each."""
    return log.select(F.explode(F.map_keys(config_map())).alias("key")).distinct()


def config_expand(log: DataFrame, names: Sequence[str]) -> DataFrame:
    """The log with a ``config_<name>`` column for each of the named config keys.

    The columns of a table must be known before it is computed; `config_keys` lists the keys of a
    log, and `config_long` has all of them, however many there are.
    """
    parsed = log.withColumn("_config", config_map())
    columns = {f"config_{n}": F.try_element_at("_config", F.lit(n)) for n in names}
    return parsed.withColumns(columns).drop("_config")


def report_table(log: DataFrame, names: Sequence[str], keys: Sequence[str] = HISTORY) -> DataFrame:
    """The expanded log under run labels, without run ids and times."""
    table = config_expand(run_labels(log, keys), names).drop("run_id", "timestamp", "run_number")
    return table.select("run_label", *[c for c in table.columns if c != "run_label"])


def config_diff(log: DataFrame, keys: Sequence[str] = HISTORY) -> DataFrame:
    """Per run after the first: changed config keys (old, new) and the metrics' moves."""
    carried = ["config_json", *LOG_METRICS]
    rows = number_sorted(log, keys, ["timestamp", "run_id"], "run_number", carried)
    rows = rows.where(F.col("run_number") > 1)
    before = F.from_json(F.coalesce("prev.config_json", F.lit("{}")), CONFIG)
    both = F.map_zip_with(before, config_map(), lambda _, old, new: F.struct(old.alias("old"), new.alias("new")))
    changed = F.map_filter(both, lambda _, pair: ~pair["old"].eqNullSafe(pair["new"]))
    return rows.select(
        *keys,
        F.concat(F.lit("Run "), F.col("run_number").cast("string")).alias("run_label"),
        F.concat(F.lit("Run "), (F.col("run_number") - 1).cast("string")).alias("prev_run_label"),
        changed.alias("config_changed"),
        *[(F.col(m) - F.col(f"prev.{m}")).alias(f"{m}_delta") for m in LOG_METRICS],
    )


def with_gap(log: DataFrame, metric: str = "precision") -> DataFrame:
    return log.withColumn("gap", F.col(f"train_{metric}") - F.col(metric))


def train_test_gap(log: DataFrame, metric: str = "precision", keys: Sequence[str] = HISTORY) -> DataFrame:
    """Train minus test metric per run; NULL where the train metric was not logged."""
    return with_gap(run_labels(log, keys), metric).select(*keys, "run_label", f"train_{metric}", metric, "gap")


def complete_gaps(log: DataFrame, metric: str = "precision") -> DataFrame:
    """Runs with a gap and a return; enough for correlations, which need no labels."""
    return with_gap(log, metric).na.drop(subset=["gap", "total_return"])


def gap_vs_backtest(log: DataFrame, metric: str = "precision", keys: Sequence[str] = HISTORY) -> DataFrame:
    """The gap beside the KPIs, for runs that have both. `complete_gaps` has them without labels."""
    rows = complete_gaps(run_labels(log, keys), metric)
    return rows.select(*keys, "run_label", f"train_{metric}", metric, *KPIS, "gap")


def run_counts(log: DataFrame, keys: Sequence[str] = HISTORY) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count("*").alias("total_runs"), F.count("total_return").alias("backtested_runs")
    )


def gap_correlation(gaps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of the gap with win rate, total return and Sharpe ratio."""
    return gaps.groupBy(*keys).agg(
        *[F.corr("gap", c).alias(f"gap_{c}") for c in ("win_rate", "total_return", "sharpe")]
    )


def top_runs(log: DataFrame, metric: str, n: int) -> DataFrame:
    """The n best runs by a metric."""
    return log.orderBy(F.col(metric).desc_nulls_last(), "run_id").limit(n)


def lowest_gap(gaps: DataFrame, n: int = 5) -> DataFrame:
    """The n runs with the smallest gap."""
    ties = [c for c in gaps.columns if c != "gap"]
    return gaps.orderBy(F.col("gap").asc_nulls_last(), *ties).limit(n)

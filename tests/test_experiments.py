"""Figures of the studies that fit models, against plain Python on small tables."""

import datetime as dt
import math
import random
import statistics

import pytest
from conftest import day
from pyspark.sql import functions as F

from eventlab.operators import models as MO
from eventlab.operators import splits as SP
from eventlab.plans import experiments as X
from eventlab.schemas import FEATURES, LABEL, RETURN, SUE_FEATURES

SPLIT = day("2021-01-01")
VALIDATION = day("2020-09-01")
TINY = {"n_estimators": 3, "max_depth": 2}


def kpis(trades, cap=0.2, cost=0.001):
    """Total return, win rate, drawdown and Sharpe ratio of (date, return) rows."""
    days = {}
    for date, ret in trades:
        days.setdefault(date, []).append(ret - cost)
    daily = [sum(v) * min(1 / len(v), cap) for _, v in sorted(days.items())]
    if not daily:
        return 0.0, 0.0, 0.0, 0.0
    curve, value = [], 1.0
    for r in daily:
        value *= 1 + r
        curve.append(value)
    peak = [max(curve[: i + 1]) for i in range(len(curve))]
    spread = statistics.stdev(daily) if len(daily) > 1 else 0
    sharpe = statistics.mean(daily) / spread * math.sqrt(252) if spread else 0.0
    wins = sum(ret > 0 for _, ret in trades) / len(trades)
    return curve[-1] / curve[0] - 1, wins, min(c / p - 1 for c, p in zip(curve, peak, strict=True)), sharpe


def metrics(rows):
    """Accuracy and precision of (label, class) rows."""
    taken = [y for y, c in rows if c]
    return sum(y == c for y, c in rows) / len(rows), sum(taken) / len(taken) if taken else 0.0


def expected(scored, cap=0.2):
    """What `compare` shows for one run of scored rows."""
    by = {s: [(r[LABEL], r["y_pred"]) for r in scored if r["split"] == s] for s in ("train", "test")}
    (a, p), (ta, tp) = metrics(by["test"]), metrics(by["train"])
    trades = [(r["date"], r[RETURN]) for r in scored if r["split"] == "test" and r["y_pred_proba"] > 0.5]
    total, wins, drawdown, sharpe = kpis(trades, cap)
    figures = {"accuracy": a, "precision": p, "train_accuracy": ta, "train_precision": tp, "gap": tp - p}
    sizes = {"n_train": len(by["train"]), "n_test": len(by["test"]), "trades": len(trades)}
    return figures | sizes | {"total_return": total, "win_rate": wins, "max_drawdown": drawdown, "sharpe": sharpe}


def shown(row, wanted):
    return {k: row[k] for k in wanted}


@pytest.fixture(scope="module")
def features(spark):
    r = random.Random(11)
    rows = []
    for i in range(500):
        x = [r.gauss(0, 1) for _ in FEATURES]
        ret = 0.02 * x[2] + 0.01 * x[4] + r.gauss(0, 0.02)
        rows.append((f"s{i % 20}", day("2019-06-01") + dt.timedelta(2 * i), *x, int(ret > 0.01), ret))
    schema = "symbol string, date date, " + ", ".join(f"{f} double" for f in FEATURES) + f", {LABEL} int, {RETURN} double"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def runs(spark):
    """Scored rows of two runs, made up: no model stands between the figures and the rows."""
    r = random.Random(2)
    rows = []
    for run in ("one", "two"):
        for i in range(300):
            p, split = r.random(), "train" if i < 160 else "test"
            rows.append((run, f"s{i}", day("2021-03-01") + dt.timedelta(i % 40), split, int(r.random() < p), p, int(p > 0.5), r.gauss(0.002, 0.04)))
    return spark.createDataFrame(rows, f"run_id string, symbol string, date date, split string, {LABEL} int, y_pred_proba double, y_pred int, {RETURN} double").cache()


def test_compare(runs):
    found = {r["run_id"]: r for r in X.compare(runs).collect()}
    for run in ("one", "two"):
        wanted = expected(runs.where(F.col("run_id") == run).collect())
        assert shown(found[run], wanted) == pytest.approx(wanted)


def test_robust_compare(runs):
    found = {r["run_id"]: r for r in X.robust_compare(runs, (5, 10, 20)).collect()}
    for run in ("one", "two"):
        trades = [(r["date"], r["symbol"], r[RETURN]) for r in runs.where((F.col("run_id") == run) & (F.col("split") == "test") & (F.col("y_pred") == 1)).collect()]
        best = sorted(trades, key=lambda t: (-t[2], t[0], t[1]))
        for n in (5, 10, 20):
            assert found[run][f"return_excl_top{n}"] == pytest.approx(kpis([(d, x) for d, _, x in best[n:]])[0])
        wins, losses = [t[2] for t in trades if t[2] > 0], [t[2] for t in trades if t[2] <= 0]
        payoff = statistics.mean(wins) / abs(statistics.mean(losses))
        assert found[run]["payoff_ratio"] == pytest.approx(payoff)


def test_overfitting_sweep(features):
    configs = {"baseline": TINY, "penalised": {**TINY, "reg_alpha": 3.0, "reg_lambda": 9.0}, "stopped": {**TINY, "n_estimators": 9, "early_stopping_rounds": 2}}
    table = X.overfitting_sweep(features, SPLIT, VALIDATION, configs)
    found = {r["run_id"]: r for r in table.collect()}
    assert set(found) == set(configs)
    split = SP.chrono_split(features, SPLIT)
    for name, config in configs.items():
        rows = split
        if name == "stopped":
            marked = SP.validation_slice(split, VALIDATION).withColumn("is_validation", F.col("is_validation") & (F.col("split") == "train"))
            model = MO.fit("boosted", marked.where("split = 'train'"), config, FEATURES, LABEL)
            rows = marked.where("NOT is_validation")
        else:
            model = MO.fit("boosted", split.where("split = 'train'"), config, FEATURES, LABEL)
        wanted = expected(MO.score(model, rows).collect())
        assert shown(found[name], wanted) == pytest.approx(wanted)
        assert found[name]["gap_vs_baseline"] == pytest.approx(found[name]["gap"] - found["baseline"]["gap"])


def test_walk_forward_and_its_summary(features):
    per_fold, summary = X.walk_forward(features, SPLIT, 6, TINY)
    folds = {r["run_id"]: r for r in per_fold.collect()}
    assert len(folds) == 3
    rows = features.withColumn("split", F.when(F.col("date") < F.lit(SPLIT), "train").when(F.col("date") < F.lit(day("2021-07-01")), "test")).where("split IS NOT NULL")
    model = MO.fit("gbt", rows.where("split = 'train'"), TINY, FEATURES, LABEL)
    wanted = expected(MO.score(model, rows).collect())
    assert shown(folds["fold 001"], wanted) == pytest.approx(wanted)
    for r in summary.collect():
        values = [f[r["metric"]] for f in folds.values()]
        told = (r["mean"], r["std"], r["min"], r["max"])
        assert told == pytest.approx((statistics.mean(values), statistics.stdev(values), min(values), max(values)))


def test_calibration_compare(features):
    table, curve = X.calibration_compare(features, SPLIT, TINY, cv=2, bins=4)
    found = {r["run_id"]: r for r in table.collect()}
    split = SP.chrono_split(features, SPLIT)
    scored = MO.score(MO.fit("gbt", split.where("split = 'train'"), TINY, FEATURES, LABEL), split).collect()
    test = [(r["y_pred_proba"], r[LABEL]) for r in scored if r["split"] == "test"]
    assert found["uncalibrated"]["brier_score"] == pytest.approx(statistics.mean((p - y) ** 2 for p, y in test))
    bins = {}
    for p, y in test:
        bins.setdefault(min(int(p * 4), 3), []).append((p, y))
    told = {int(r["bin_low"] * 4): r for r in curve.where("run_id = 'uncalibrated'").collect()}
    assert set(told) == set(bins)
    for b, rows in bins.items():
        wanted = (statistics.mean(p for p, _ in rows), statistics.mean(y for _, y in rows), len(rows))
        assert (told[b]["mean_predicted"], told[b]["fraction_positive"], told[b]["count"]) == pytest.approx(wanted)
    assert {r["run_id"] for r in curve.collect()} == {"uncalibrated", "sigmoid", "isotonic"} == set(found)


def test_baseline_compare_and_gap_robustness(features):
    found = {r["run_id"]: r for r in X.baseline_compare(features, SPLIT, TINY).collect()}
    split = SP.chrono_split(features, SPLIT)
    wanted = expected(MO.score(MO.fit("logistic", split.where("split = 'train'"), None, FEATURES, LABEL), split).collect())
    assert set(found) == {"gbt", "logistic"} and shown(found["logistic"], wanted) == pytest.approx(wanted)
    config = {**TINY, "reg_alpha": 0.1, "n_estimators": 6, "early_stopping_rounds": 2}
    low = X.gap_robustness(features, SPLIT, VALIDATION, config).first()
    assert low["run_id"] == "lowest_gap" and None not in [low[f"return_excl_top{n}"] for n in (5, 10, 20)]


def test_calibrations_share_each_folds_trees(features, monkeypatch):
    fitted, fit_gbt = [], MO.fit_gbt
    monkeypatch.setattr(MO, "fit_gbt", lambda *a: fitted.append(1) or fit_gbt(*a))
    table, _ = X.calibration_compare(features, SPLIT, TINY, cv=2, bins=4)
    assert len(fitted) == 1 + 2  # the uncalibrated trees and those of each fold, not of each fold and method
    found = {r["run_id"]: r for r in table.collect()}
    split = SP.chrono_split(features, SPLIT)
    for method in ("sigmoid", "isotonic"):
        model = MO.fit_calibrated(split.where("split = 'train'"), method, 2, TINY)
        test = [(r["y_pred_proba"], r[LABEL]) for r in MO.score(model, split).collect() if r["split"] == "test"]
        assert found[method]["brier_score"] == pytest.approx(statistics.mean((p - y) ** 2 for p, y in test))


def test_sue_compare_reads_its_features_once(spark, features):
    made = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    x = F.col("surprise_pct")
    known = features.withColumns({"sue": F.when(F.dayofmonth("date") > 3, x * F.col("return_60d")), "surprise_pct": F.when(F.dayofmonth("date") < 28, x)})
    counted = known.mapInPandas(watched, known.schema)
    found = {r["run_id"]: r for r in X.sue_compare(counted, SPLIT, TINY).collect()}
    assert made.value == features.count()  # each model built them for itself
    assert set(found) == {"raw_surprise", "sue"}
    for run, names in (("raw_surprise", FEATURES), ("sue", SUE_FEATURES)):
        split = SP.chrono_split(known, SPLIT, names)
        wanted = expected(MO.score(MO.fit("gbt", split.where("split = 'train'"), TINY, names, LABEL), split).collect())
        assert shown(found[run], wanted) == pytest.approx(wanted)

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventlab.operators import runlog as R
from eventlab.sources.runlog import RunLog


def at(minute):
    return dt.datetime(2024, 1, 1, 12, 0) + dt.timedelta(minutes=minute)


def log(spark):
    return spark.createDataFrame(
        [
            ("c", at(95), '{"depth": 9, "eta": 0.02}', 0.875, 0.5, 0.96, 0.9, -0.25, 0.44, -0.3, -0.75),
            ("a", at(3), '{"depth": 2}', 0.5, 0.25, 0.66, 0.375, 0.5, 0.61, -0.05, 2.25),
            ("b", at(41), None, 0.61, 0.31, None, None, None, None, None, None),
        ],
        "run_id string, timestamp timestamp, config_json string, accuracy double, precision double, train_accuracy double, "
        "train_precision double, total_return double, win_rate double, max_drawdown double, sharpe double",
    )


def test_labels_follow_time(spark):
    got = {r["run_id"]: r["run_label"] for r in R.run_labels(log(spark), ()).collect()}
    assert got == {"a": "Run 1", "b": "Run 2", "c": "Run 3"}


def test_config_columns(spark):
    got = rows(R.config_expand(log(spark), ["depth", "eta"]).select("run_id", "config_depth", "config_eta"), "run_id")
    assert got == [("a", "2", None), ("b", None, None), ("c", "9", "0.02")]


def test_config_keys(spark):
    assert {r["key"] for r in R.config_keys(log(spark)).collect()} == {"depth", "eta"}
    many = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("run_id"), F.format_string('{"key%d": 1}', "id").alias("config_json"))
    assert R.config_keys(many).count() == 3000
    assert R.config_expand(many, ["key7"]).where("config_key7 = '1'").count() == 1


def test_report_hides_ids_and_times(spark):
    table = R.report_table(log(spark), ["depth"], ())
    assert table.columns[0] == "run_label"
    assert not {"run_id", "timestamp"} & set(table.columns)


def test_config_diff(spark):
    got = {r["run_label"]: r for r in R.config_diff(log(spark).where("run_id <> 'b'"), ()).collect()}
    assert set(got) == {"Run 2"}
    changed = {k: (v["old"], v["new"]) for k, v in got["Run 2"]["config_changed"].items()}
    assert changed == {"depth": ("2", "9"), "eta": (None, "0.02")}
    assert got["Run 2"]["accuracy_delta"] == pytest.approx(0.375)
    assert got["Run 2"]["total_return_delta"] == pytest.approx(-0.75)


def test_unchanged_absent_keys_are_not_reported(spark):
    both = log(spark).where("run_id <> 'b'").withColumn("config_json", F.lit('{"depth": 3}'))
    assert R.config_diff(both, ()).first()["config_changed"] == {}


def test_gaps(spark):
    got = {r["run_label"]: r["gap"] for r in R.train_test_gap(log(spark), keys=()).collect()}
    assert got == {"Run 1": pytest.approx(0.125), "Run 2": None, "Run 3": pytest.approx(0.4)}
    assert R.train_test_gap(log(spark), "accuracy", ()).columns[1] == "train_accuracy"
    complete = R.gap_vs_backtest(log(spark), keys=())
    assert [r["run_label"] for r in complete.orderBy("run_label").collect()] == ["Run 1", "Run 3"]
    assert R.gap_correlation(complete).first()["gap_sharpe"] == pytest.approx(-1.0)
    assert R.lowest_gap(complete, 1).first()["run_label"] == "Run 1"


def test_counts_and_top(spark):
    assert tuple(R.run_counts(log(spark), ()).first()) == (3, 2)
    assert [r["run_id"] for r in R.top_runs(log(spark), "precision", 2).collect()] == ["c", "b"]


def test_log_round_trip(spark, tmp_path):
    store = RunLog(spark, str(tmp_path / "log"))
    assert store.load().count() == 0
    assert {"run_id", "timestamp", "sharpe"} <= set(store.load().columns)
    with pytest.raises(FileNotFoundError):
        store.append_backtest(log(spark))
    training = log(spark).drop("total_return", "win_rate", "max_drawdown", "sharpe")
    store.append_training(training.where("run_id = 'a'"))
    store.append_training(training.where("run_id <> 'a'"))
    kpis = log(spark).where("run_id = 'a'").withColumn("logged_at", F.col("timestamp"))
    store.append_backtest(kpis)
    newer = kpis.select("run_id", (F.col("logged_at") + F.expr("INTERVAL 1 HOUR")).alias("logged_at"), F.lit(0.9).alias("sharpe"))
    store.append_backtest(newer)
    got = {r["run_id"]: (r["total_return"], r["sharpe"]) for r in store.load().collect()}
    assert got == {"a": (0.5, 0.9), "b": (None, None), "c": (None, None)}
    with pytest.raises(ValueError, match="ghost"):
        store.append_backtest(kpis.withColumn("run_id", F.lit("ghost")))


def kpi_rows(spark, data):
    return spark.createDataFrame(data, "run_id string, logged_at string, total_return double, sharpe double").withColumn(
        "logged_at", F.col("logged_at").cast("timestamp")
    )


def loaded(store):
    return {r["run_id"]: (r["total_return"], r["sharpe"]) for r in store.load().collect()}


def new_store(spark, path, runs):
    store = RunLog(spark, str(path))
    store.append_training(spark.createDataFrame([(r,) for r in runs], "run_id string"))
    return store


def test_equal_times_go_by_commit(spark, tmp_path):
    store = new_store(spark, tmp_path / "log", "ab")
    at = "2024-03-01 10:00:00"
    store.append_backtest(kpi_rows(spark, [("a", at, 0.9, 2.0), ("b", None, 0.1, None)]))
    store.append_backtest(kpi_rows(spark, [("a", at, 0.2, None), ("a", at, 0.3, None), ("b", "2024-02-01 00:00:00", None, 7.0)]))
    # A late commit of an earlier time changes nothing.
    store.append_backtest(kpi_rows(spark, [("a", "2024-01-01 00:00:00", 0.7, 0.7)]))
    want = {"a": (0.3, 2.0), "b": (0.1, 7.0)}
    assert loaded(store) == want
    assert store.compact() is not None and store.compact() is None
    assert loaded(store) == want and len(store.commits()) == 1
    store.append_backtest(kpi_rows(spark, [("a", at, 0.4, None)]))
    assert loaded(store) == {**want, "a": (0.4, 2.0)}
    store.compact()
    assert loaded(store) == {**want, "a": (0.4, 2.0)}
    # What counts no more is gone: two values of a, two of b.
    assert store.backtests.count() == 4


def test_a_compaction_is_bounded_by_the_runs(spark, tmp_path):
    store = new_store(spark, tmp_path / "log", "a")
    for i in range(6):
        store.append_backtest(kpi_rows(spark, [("a", f"2024-01-{i + 1:02d} 00:00:00", float(j), 1.0) for j in range(5)]))
    before = loaded(store)
    store.compact()
    assert loaded(store) == before == {"a": (4.0, 1.0)}
    assert store.backtests.count() == 1


def test_writers_and_compactions_side_by_side(spark, tmp_path):
    runs = [f"r{i}" for i in range(6)]
    store = new_store(spark, tmp_path / "log", runs)

    def write(run):
        own = RunLog(spark, str(tmp_path / "log"))
        for i in range(2):
            own.append_backtest(kpi_rows(spark, [(run, f"2024-01-0{i + 1} 00:00:00", float(i), None)]))

    def compact(_):
        RunLog(spark, str(tmp_path / "log")).compact()

    with ThreadPoolExecutor(4) as pool:
        for done in [*pool.map(write, runs[:3]), *pool.map(compact, range(2)), *pool.map(write, runs[3:]), *pool.map(compact, range(2))]:
            assert done is None
    assert loaded(store) == {r: (1.0, None) for r in runs}


def test_two_compactions_of_the_same_commits(spark, tmp_path, monkeypatch):
    store = new_store(spark, tmp_path / "log", "ab")
    for i, run in enumerate("aab"):
        store.append_backtest(kpi_rows(spark, [(run, f"2024-01-0{i + 1} 00:00:00", float(i), None)]))
    seen = store.commits()
    store.compact()
    slow = RunLog(spark, str(tmp_path / "log"))
    monkeypatch.setattr(slow, "commits", lambda: seen)
    slow.compact()
    assert len(store.commits()) == 2
    assert loaded(store) == {"a": (1.0, None), "b": (2.0, None)}
    store.compact()
    assert store.backtests.count() == 2 and loaded(store) == {"a": (1.0, None), "b": (2.0, None)}


def test_rows_without_a_commit_are_not_seen(spark, tmp_path):
    store = new_store(spark, tmp_path / "log", "a")
    store.append_backtest(kpi_rows(spark, [("a", "2024-01-01 00:00:00", 0.5, None)]))
    kpi_rows(spark, [("a", "2025-01-01 00:00:00", 0.9, None)]).write.parquet(f"{store.backtest_path}/commit=lost")
    assert loaded(store) == {"a": (0.5, None)}

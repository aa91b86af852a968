import datetime as dt
import hashlib
import random
from collections import Counter

import pandas as pd
import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from eventlab.operators import portfolio as PO
from eventlab.operators import resample as R
from eventlab.plans import backtests as B


def trades(spark, data, run="r"):
    return spark.createDataFrame(
        [(run, day(d), s, float(r)) for d, s, r in data],
        "run_id string, date date, symbol string, target_t1_close_ret double",
    )


def test_signals_are_strictly_above_the_threshold(spark):
    df = spark.createDataFrame([("p", 0.2501), ("q", 0.25), ("r", 1.0), ("s", 0.0), ("t", None)], "symbol string, y_pred_proba double")
    assert sorted(r["symbol"] for r in PO.filter_signals(df, 0.25).collect()) == ["p", "r"]


def test_limit_order(spark):
    df = spark.createDataFrame(
        [(1, 0.31, -0.2), (2, 0.1249, 0.11), (3, 0.125, 0.3)], "i int, target_t1_high_ret double, target_t1_close_ret double"
    )
    got = [r["realized_return"] for r in PO.limit_order_returns(df, 0.125).orderBy("i").collect()]
    assert got == [0.125, 0.11, 0.125]


def test_payoff(spark):
    df = trades(spark, [("2031-05-06", "a", 0.07), ("2031-05-06", "b", 0.01), ("2031-05-07", "a", 0.0), ("2031-05-08", "d", -0.16)])
    row = PO.payoff_stats(df).first()
    assert (row["avg_win"], row["avg_loss"], row["payoff_ratio"]) == (pytest.approx(0.04), pytest.approx(-0.08), pytest.approx(0.5))


def test_payoff_without_losses_is_null(spark):
    row = PO.payoff_stats(trades(spark, [("2031-05-06", "a", 0.33), ("2031-05-06", "b", 0.01)])).first()
    assert (row["avg_loss"], row["payoff_ratio"]) == (0.0, None)


def test_exclude_top_n(spark):
    returns = [0.07, -0.4, 0.22, 0.0, 0.21, -0.01, 0.22]
    df = trades(spark, [("2031-05-06", f"s{i}", r) for i, r in enumerate(returns)])
    assert sorted(r["target_t1_close_ret"] for r in PO.exclude_top_n(df, 3).collect()) == [-0.4, -0.01, 0.0, 0.07]
    assert PO.exclude_top_n(df, 99).count() == 0


def test_exactly_n_trades_go(spark):
    """Also if a symbol trades more than once a day, and in a run without a name."""
    twice = [("2031-05-06", "a", r) for r in (0.3, 0.2, 0.1)] + [("2031-05-06", "b", 0.25), ("2031-05-07", "a", -0.1)]
    df = trades(spark, twice, None).union(trades(spark, twice, "r"))
    left = PO.exclude_top_each(df, [1, 2, 4])
    got = {(r["run_id"], r["excluded"]): sorted(r["left"]) for r in left.groupBy("run_id", "excluded").agg(F.collect_list("target_t1_close_ret").alias("left")).collect()}
    expected = {1: [-0.1, 0.1, 0.2, 0.25], 2: [-0.1, 0.1, 0.2], 4: [-0.1]}
    assert got == {(run, n): rest for run in (None, "r") for n, rest in expected.items()}


def test_daily_returns(spark):
    df = trades(spark, [("2031-05-06", "a", 0.12), ("2031-05-06", "b", 0.0), ("2031-05-06", "c", -0.06), ("2031-05-07", "a", 0.4)])
    got = rows(PO.daily_returns(df, cost=0.005).select("date", "daily_return"), "date")
    assert [r[1] for r in got] == pytest.approx([0.02 - 0.005, 0.4 - 0.005])


def test_cap_leaves_capital_idle(spark):
    two = trades(spark, [("2031-05-06", "a", -0.5), ("2031-05-06", "b", 0.1)])
    assert PO.daily_returns(two, cost=0.0, cap=0.25).first()["daily_return"] == pytest.approx(-0.1)
    many = trades(spark, [("2031-05-06", f"s{i}", 0.03 * i - 0.05) for i in range(9)])
    capped, free = PO.daily_returns(many, cap=0.25).first(), PO.daily_returns(many).first()
    assert capped["daily_return"] == pytest.approx(free["daily_return"])


def test_equity_and_kpis(spark):
    returns = [0.5, -0.2, 0.25, -0.4, 0.1]
    df = trades(spark, [(f"2031-05-0{i + 5}", "a", r) for i, r in enumerate(returns)])
    curve = PO.equity_curve(PO.daily_returns(df, cost=0.0), capital=200.0)
    assert [r[-1] for r in rows(curve.select("date", "equity"), "date")] == pytest.approx([300.0, 240.0, 300.0, 180.0, 198.0])
    row = PO.backtest_kpis(df, cost=0.0).first()
    assert row["total_return"] == pytest.approx(198 / 300 - 1)
    assert row["win_rate"] == pytest.approx(0.6)
    assert row["max_drawdown"] == pytest.approx(-0.4)


def test_a_single_day_has_no_sharpe(spark):
    assert PO.backtest_kpis(trades(spark, [("2024-01-01", "a", 0.1)])).first()["sharpe"] == 0.0


def test_loss_beyond_all_capital_keeps_its_sign(spark):
    df = trades(spark, [("2024-01-01", "a", 0.1), ("2024-01-02", "a", -1.5), ("2024-01-03", "a", 0.2)])
    curve = PO.equity_curve(PO.daily_returns(df, cost=0.0), capital=1.0)
    assert [r[-1] for r in rows(curve.select("date", "equity"), "date")] == pytest.approx([1.1, -0.55, -0.66])


def test_runs_without_trades_have_zeros(spark):
    predictions = spark.createDataFrame(
        [("x", day("2024-01-01"), "a", 0.1, 0.9), ("y", day("2024-01-01"), "a", 0.1, 0.1)],
        "run_id string, date date, symbol string, target_t1_close_ret double, y_pred_proba double",
    )
    got = {r["run_id"]: (r["win_rate"], r["trades"]) for r in B.event_backtest(predictions).collect()}
    assert got == {"x": (1.0, 1), "y": (0.0, 0)}


def test_tranches_cap_a_day(spark):
    df = trades(spark, [("2031-05-05", s, 0.1) for s in ("z", "m", "b", "q")])
    assert sorted(r["symbol"] for r in PO.tranche_trades(df, 3, 3).collect()) == ["b", "m", "q"]


def test_tranche_is_free_exactly_in_time(spark):
    # From a Thursday, three business days end on Tuesday.
    df = trades(spark, [("2031-05-08", "a", 0.1), ("2031-05-12", "b", 0.1), ("2031-05-13", "c", 0.1), ("2031-05-15", "d", 0.1)])
    assert sorted(r["symbol"] for r in PO.tranche_trades(df, 3, 1).collect()) == ["a", "c"]


def test_tranche_weight_and_default_count(spark):
    df = trades(spark, [("2031-05-05", f"s{i}", 0.02 * i) for i in range(9)])
    accepted = PO.tranche_trades(df, 7)
    assert accepted.count() == 7
    daily = PO.tranche_daily_returns(accepted, 7, cost=0.0).first()
    assert daily["daily_return"] == pytest.approx(0.06)
    wide = PO.tranche_daily_returns(accepted, 7, 14, cost=0.01).first()
    assert wide["daily_return"] == pytest.approx(7 * (0.06 - 0.01) / 14)


def brute_force_tranches(pdf, horizon, n):
    free, taken = [pd.Timestamp.min] * n, []
    for r in pdf.sort_values(["date", "symbol"]).itertuples():
        at = pd.Timestamp(r.date)
        slot = next((i for i, t in enumerate(free) if t <= at), None)
        if slot is not None:
            free[slot] = at + pd.tseries.offsets.BDay(horizon)
            taken.append((r.date, r.symbol))
    return sorted(taken)


def test_tranches_equal_brute_force(spark):
    rng = random.Random(3)
    data = {(day("2024-01-01") + dt.timedelta(rng.randrange(90)), f"s{rng.randrange(40):02d}") for _ in range(300)}
    df = trades(spark, [(str(d), s, 0.01) for d, s in data])
    for horizon, n in ((1, 1), (5, 3), (20, 20), (7, 2)):
        got = sorted((r["date"], r["symbol"]) for r in PO.tranche_trades(df, horizon, n).collect())
        assert got == brute_force_tranches(df.toPandas(), horizon, n)


def test_sweep_keys_are_independent_runs(spark):
    df = trades(spark, [("2024-01-01", "a", 0.1), ("2024-01-02", "b", -0.1), ("2024-01-02", "c", 0.3)])
    swept = {r["cost"]: r["total_return"] for r in B.cost_sweep(df, (0.0, 0.01), cap=None).collect()}
    for cost, value in swept.items():
        assert value == pytest.approx(PO.backtest_kpis(df, cost=cost).first()["total_return"])


def sample_trades(spark, n=40):
    rng = random.Random(5)
    return trades(spark, [(str(day("2024-01-01") + dt.timedelta(i % 15)), f"s{i:02d}", rng.gauss(0.01, 0.05)) for i in range(n)])


def test_bootstrap_is_reproducible_whatever_the_partitioning(spark):
    df = sample_trades(spark)
    keys = ["rep"]
    a = rows(R.bootstrap_kpis(df, 20, seed=1), *keys)
    b = rows(R.bootstrap_kpis(df.repartition(7), 20, seed=1), *keys)
    c = rows(R.bootstrap_kpis(df, 20, seed=2), *keys)
    assert len(a) == 20
    assert [r[:2] for r in a] == [r[:2] for r in b]
    assert [x for r in a for x in r[2:]] == pytest.approx([x for r in b for x in r[2:]])
    assert a != c


def test_bootstrap_keeps_the_size_and_draws_with_replacement(spark):
    df = sample_trades(spark)
    drawn = R.bootstrap_trades(df, 30)
    sizes = drawn.groupBy("rep").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("d")).collect()
    assert {r["n"] for r in sizes} == {40}
    assert all(r["d"] < 40 for r in sizes)


def test_bootstrap_counts_a_reps_draws_where_they_arise(spark, monkeypatch):
    sizes = spark.createDataFrame([(("a",), 1001), (("b",), 3)], "_run struct<run_id:string>, _size bigint")
    found = R.block_draws(sizes, 5, 42)
    assert found.rdd.getNumPartitions() > 1  # whatever the bytes
    shown = sorted((r["_run"]["run_id"], r["rep"], r["_block"], r["_draws"]) for r in found.collect())
    assert len({r[:3] for r in shown}) == len(shown) and max(r[2] for r in shown) == 1000 // R.BLOCK
    for run, size in (("a", 1001), ("b", 3)):
        assert all(sum(r[3] for r in shown if r[:2] == (run, rep)) == size for rep in range(5))
    digests = [hashlib.md5(f"42|4|{p}".encode()).hexdigest() for p in range(501)]
    picks = [int(d[i : i + 15], 16) % 1001 // R.BLOCK for d in digests for i in (0, 15)][:1001]
    assert {r[2]: r[3] for r in shown if r[:2] == ("a", 4)} == dict(Counter(picks))
    monkeypatch.setattr(R, "STRETCH", 100)
    cut = R.block_draws(sizes, 5, 42).groupBy("_run", "rep", "_block").agg({"_draws": "sum"}).collect()
    assert sorted((r[0][0], *r[1:]) for r in cut) == shown


def test_bootstrap_of_constant_returns(spark):
    df = trades(spark, [(f"2024-01-0{i}", "a", 0.05) for i in range(1, 5)])
    assert {r["win_rate"] for r in R.bootstrap_kpis(df, 20).collect()} == {1.0}


def test_runs_without_a_name_are_resampled_too(spark):
    df = trades(spark, [("2031-05-06", f"s{i}", 0.01 * i) for i in range(7)], None)
    drawn = R.bootstrap_trades(df, 3)
    assert {r["rep"]: r["count"] for r in drawn.groupBy("rep").count().collect()} == {0: 7, 1: 7, 2: 7}
    real = df.where("symbol < 's3'")
    assert R.exposure_matched_trades(df, real, 2).count() == 6


def test_no_run_is_one_task(spark):
    """Values and trades are cut by more than the run, also where nothing is broadcast."""
    import re

    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        samples = sample_trades(spark).select("run_id", F.col("target_t1_close_ret").alias("x"))
        for df in (R.confidence_interval(samples, ["x"]), R.bootstrap_trades(sample_trades(spark), 3)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            # Below a window by the group alone there are only counts, one row per group and part.
            for match in re.finditer(r"Exchange hashpartitioning\(_group#\d+, \d+\)[^\n]*\n[^\n]*", plan):
                assert "HashAggregate" in match[0], plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_interval(spark):
    """Positions between two values are interpolated; ties and missing values are no values of their own."""
    data = [("r", v) for v in (-3.0, None, 5.0, 5.0, 9.0, 21.0)] + [(None, 4.0), (None, 6.0)]
    df = spark.createDataFrame(data, "run_id string, x double")
    got = {r["run_id"]: (r["lower"], r["upper"], r["includes_zero"]) for r in R.confidence_interval(df, ["x"], level=0.5).collect()}
    assert got == {"r": (5.0, 9.0, False), None: (4.5, 5.5, False)}
    wide = {r["run_id"]: (r["lower"], r["upper"], r["includes_zero"]) for r in R.confidence_interval(df, ["x"], level=0.9).collect()}
    assert wide["r"] == (pytest.approx(-1.4), pytest.approx(18.6), True)


def test_random_exposure_matches_the_days(spark):
    pool = sample_trades(spark, 60)
    real = pool.where(F.col("symbol") < "s20")
    drawn = R.exposure_matched_trades(pool, real, 5)
    wanted = {r["date"]: r["n"] for r in real.groupBy("date").agg(F.count("*").alias("n")).collect()}
    for r in drawn.groupBy("seed", "date").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("d")).collect():
        assert r["n"] == r["d"] == wanted[r["date"]]
    assert drawn.select("seed").distinct().count() == 5


@pytest.mark.parametrize("spare", [2.5, -1.5])
def test_random_exposure_takes_the_smallest_hashes(spark, monkeypatch, spare):
    """Also on days and seeds whose limit left too few, where more is wanted than offered, and for NULL keys."""
    monkeypatch.setattr(R, "SPARE", spare)
    data = [(f"r{run}" if run else None, day, f"s{i}") for run in range(3) for day in range(1, 6) for i in range(12 * day * (run + 1))]
    pool = spark.createDataFrame(data, "run_id string, d int, symbol string").select(
        "run_id", F.make_date(F.lit(2024), F.lit(1), "d").alias("date"), "symbol", F.lit(0.5).alias("x")
    )
    real = pool.where("substring(symbol, 2, 9) % 5 = 0").unionByName(pool.where("day(date) = 1 and run_id = 'r1'"))
    seeds = 6
    got = {tuple(r) for r in R.exposure_matched_trades(pool, real, seeds, ["run_id"]).select("run_id", "date", "seed", "symbol").collect()}
    offered, wanted = {}, {}
    for r in pool.collect():
        offered.setdefault((r.run_id, r.date), []).append(r.symbol)
    for r in real.collect():
        wanted[r.run_id, r.date] = wanted.get((r.run_id, r.date), 0) + 1
    assert wanted["r1", day("2024-01-01")] > len(offered["r1", day("2024-01-01")])
    expected = set()
    for (run, when), symbols in offered.items():
        for seed in range(seeds):
            ranked = sorted(symbols, key=lambda s: hashlib.md5(f"{seed}|{when}|{s}".encode()).hexdigest())
            expected |= {(run, when, seed, s) for s in ranked[: wanted[run, when]]}
    assert got == expected


def test_random_exposure_multiplies_few_candidates(spark, monkeypatch):
    pool = sample_trades(spark, 4000)
    real = pool.where(F.pmod(F.xxhash64("symbol"), F.lit(50)) == 0)
    kept = []

    def count(df, label="table"):
        kept.append((label, df.count()))
        return df

    monkeypatch.setattr(R, "stored", count)
    drawn = R.exposure_matched_trades(pool, real, 20)
    assert dict(kept)["draws"] < 3 * drawn.count() < 0.1 * 20 * pool.count()


def test_ticker_sample_is_seeded(spark):
    df = spark.range(100).select(F.concat(F.lit("s"), "id").alias("symbol"))
    a = {r["symbol"] for r in R.seeded_ticker_sample(df, 30).collect()}
    b = {r["symbol"] for r in R.seeded_ticker_sample(df.repartition(5).union(df), 30).collect()}
    assert len(a) == 30 and a == b
    assert R.seeded_ticker_sample(df.limit(4), 30).count() == 4


def test_trade_day_stats(spark):
    df = trades(spark, [("2024-01-01", "a", 0), ("2024-01-01", "b", 0), ("2024-01-01", "c", 0), ("2024-01-02", "a", 0), ("2024-01-03", "a", 0)])
    assert tuple(PO.trade_day_stats(df).first())[1:] == (5, 3, 1.0, 3)


def test_invariants_on_the_small_tables(spark, small_dir):
    from eventlab.sources import market as K

    predictions = K.predictions(spark, small_dir)
    signals = B.signals(predictions)
    daily = PO.drawdown(PO.equity_curve(PO.daily_returns(signals, cap=0.2)))
    assert daily.where(F.col("drawdown") > 0).count() == 0
    slots = PO.tranche_slots(signals, 20, 5)
    assert slots.agg(F.max("slots")).first()[0] <= 5
    assert PO.tranche_trades(signals, 20, 5).count() <= signals.count()

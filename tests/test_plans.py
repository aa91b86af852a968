"""What the physical plans must look like."""

import re

from pyspark.sql import functions as F

from eventlab.operators import events as E
from eventlab.operators import labels as L
from eventlab.operators import panel as P
from eventlab.operators import portfolio as PO
from eventlab.sources import market as K


def plan(df) -> str:
    """The initial plan, before adaptive execution replaces joins of small test tables."""
    return df._jdf.queryExecution().executedPlan().toString()


def panel_files(spark, tmp_path):
    spark.range(1000).select(
        (F.col("id") % 10).cast("string").alias("symbol"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("id") / 10).cast("int")).alias("date"),
        *[(F.lit(100.0) + F.col("id") % 7).alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.concat(F.lit("s"), F.col("id") % 3).alias("sector"),
    ).write.parquet(str(tmp_path / "panel"))
    return spark.read.parquet(str(tmp_path / "panel"))


def test_symbol_windows_share_one_shuffle(spark, tmp_path):
    panel = panel_files(spark, tmp_path)
    df = L.triple_barrier(P.forward_returns(P.momentum(panel)))
    assert len(re.findall("Exchange hashpartitioning", plan(df))) == 1
    assert len(re.findall(r"Sort \[", plan(df))) == 1


def test_sector_join_and_windows_share_the_panel_shuffle(spark, tmp_path):
    panel = panel_files(spark, tmp_path)
    meta = panel.select("symbol", "sector").distinct()
    df = P.momentum(P.sector_join(panel.drop("sector"), meta))
    text = plan(df)
    assert "ShuffledHashJoin" in text and "BroadcastHashJoin" not in text
    # the panel's, and the metadata's own (its distinct is hashed by symbol and sector first)
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+, \d+\)", text)) == 2


def test_only_needed_columns_are_read(spark, tmp_path):
    panel = panel_files(spark, tmp_path)
    df = P.momentum(panel, (14,)).select("symbol", "date", "return_14d")
    assert "ReadSchema: struct<symbol:string,date:date,close:double>" in plan(df)


def test_a_symbol_filter_reaches_the_files_but_a_date_filter_stays_above_the_window(spark, tmp_path):
    panel = panel_files(spark, tmp_path)
    moved = P.momentum(panel)
    by_symbol = plan(moved.where(F.col("symbol") == "3"))
    assert "EqualTo(symbol,3)" in by_symbol
    by_date = plan(moved.where(F.col("date") > F.lit("2020-03-01").cast("date")))
    assert "GreaterThan(date" not in by_date


def test_trades_are_summed_before_any_window(spark, tmp_path):
    trades = panel_files(spark, tmp_path).select(
        F.concat(F.lit("r"), "volume").alias("run_id"),
        "symbol",
        "date",
        (F.col("close") / 100 - 1).alias("target_t1_close_ret"),
    )
    text = plan(PO.backtest_kpis(trades))
    assert text.rindex("Window") < text.rindex("partial_sum")  # the plan is printed top down
    assert len(re.findall("Exchange hashpartitioning", text)) == 2


def test_top_trades_are_limited_before_the_shuffle(spark, tmp_path):
    trades = panel_files(spark, tmp_path).select(
        F.concat(F.lit("r"), "volume").alias("run_id"), "symbol", "date", F.col("close").alias("target_t1_close_ret")
    )
    assert "WindowGroupLimit" in plan(PO.best_trades(trades, 5)) and "Partial" in plan(PO.best_trades(trades, 5))


def test_latest_rows_need_no_window(spark, tmp_path):
    panel = panel_files(spark, tmp_path).withColumn("return_60d", F.col("close"))
    for df in (P.latest_snapshot(panel), E.latest_event(panel)):
        text = plan(df)
        assert "Window" not in text and "partial_max" in text


def test_no_python_in_the_feature_plan(spark, small_dir):
    text = plan(K.features(spark, small_dir))
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_buckets_are_cut_even_if_rows_are_hashed_by_the_key(spark, tmp_path):
    from eventlab.functions.ordering import number_rows, percent_ranks

    hashed = panel_files(spark, tmp_path).repartition(4, "sector")
    numbered = number_rows(hashed, ["sector"], F.pmod(F.hash("symbol"), F.lit(8)), ["symbol", "date"], "rn")
    ranked = percent_ranks(hashed, ["sector"], "close", "rank")
    for df in (numbered, ranked):
        assert re.search(r"Exchange hashpartitioning\((sector|_group)#\d+, _bucket#\d+", plan(df))


def test_features_of_several_labels_are_those_built_alone(spark):
    import datetime as dt

    from eventlab.plans import features as FT

    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(110)]
    bars = [(d, s, 10.0 + s + i % 7, 12.0 + s + i % 5, 9.0, 10.0 + s + (i * (s + 3)) % 11, 100.0) for s in range(3) for i, d in enumerate(days)]
    prices = spark.createDataFrame(bars, "date date, symbol bigint, open double, high double, low double, close double, volume double")
    metadata = spark.createDataFrame([(s, "x") for s in range(3)], "symbol bigint, sector string")
    told = [(s, days[i], 1.0, 1.5, 50.0) for s in range(3) for i in (5, 70, 85, 95, 109)]
    earnings = spark.createDataFrame(told, "symbol bigint, date date, eps_estimate double, reported_eps double, surprise_pct double")
    labels = [(1, "high"), (20, "close"), (1, "close")]
    each = FT.event_features_each(prices, metadata, earnings, labels, threshold=0.07)
    for (horizon, price), found in zip(labels, each, strict=True):
        alone = FT.event_features(prices, metadata, earnings, horizon=horizon, label_price=price, threshold=0.07)
        assert found.columns == alone.columns and found.count() > 0
        assert sorted(map(str, found.collect())) == sorted(map(str, alone.collect()))

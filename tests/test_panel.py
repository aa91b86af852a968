import datetime as dt
import random

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from eventlab.operators import events as E
from eventlab.operators import labels as L
from eventlab.operators import panel as P
from eventlab.plans import features as PF


def closes(spark, data):
    return spark.createDataFrame([(s, day(d), c) for s, d, c in data], "symbol string, date date, close double")


def test_adjust_scales_open_high_low(spark):
    raw = spark.createDataFrame(
        [(36.0, 48.0, 32.0, 40.0, 10.0), (7.0, 9.0, 5.0, 8.0, 8.0)],
        "open double, high double, low double, close double, adjusted_close double",
    )
    got = [(r["open"], r["high"], r["low"], r["close"]) for r in P.adjust_ohlc(raw).orderBy("open").collect()]
    assert got == [(7.0, 9.0, 5.0, 8.0), (9.0, 12.0, 8.0, 40.0)]


def test_adjust_leaves_tables_without_adjusted_close(spark):
    raw = spark.createDataFrame([(3.5, 4.25)], "open double, close double")
    assert P.adjust_ohlc(raw).collect() == raw.collect()


def test_adjust_by_a_zero_close_gives_null(spark):
    raw = spark.createDataFrame([(1.0, 0.0, 5.0)], "open double, close double, adjusted_close double")
    assert P.adjust_ohlc(raw).first()["open"] is None


def test_sector_join_drops_unknown_sectors_and_missing_closes(spark):
    panel = closes(spark, [("A", "2024-01-01", 1.0), ("B", "2024-01-01", None), ("C", "2024-01-01", 1.0), ("D", "2024-01-01", 2.0)])
    meta = spark.createDataFrame([("A", "x"), ("B", "x"), ("D", None)], "symbol string, sector string")
    assert [r["symbol"] for r in P.sector_join(panel, meta).collect()] == ["A"]


def test_last_metadata_row_wins(spark):
    panel = closes(spark, [("A", "2024-01-01", 1.0)])
    meta = spark.createDataFrame([("A", "old", 1), ("A", "new", 2)], "symbol string, sector string, seq int")
    assert P.sector_join(panel, meta).first()["sector"] == "new"


def test_momentum_stays_inside_a_symbol(spark):
    panel = closes(
        spark,
        [("U", "2031-05-05", 40.0), ("V", "2031-05-05", 3.0), ("U", "2031-05-07", 30.0), ("V", "2031-05-06", 12.0), ("U", "2031-05-08", 45.0), ("V", "2031-05-09", 9.0)],
    )
    got = rows(P.momentum(panel, (1, 2)).select("symbol", "date", "return_1d", "return_2d"), "symbol", "date")
    assert [r[2] for r in got] == [None, pytest.approx(-0.25), pytest.approx(0.5), None, pytest.approx(3.0), pytest.approx(-0.25)]
    assert [r[3] for r in got] == [None, None, pytest.approx(0.125), None, None, pytest.approx(2.0)]


def test_sector_rank_is_the_average_percentile(spark):
    data = [("p", -0.4), ("q", 0.7), ("r", 0.0), ("s", 0.2)]
    panel = spark.createDataFrame([(day("2031-05-05"), "x", s, r) for s, r in data], "date date, sector string, symbol string, return_60d double")
    got = {r["symbol"]: r["sector_rank_60d"] for r in P.sector_rank(panel).collect()}
    assert got == {"p": 0.25, "r": 0.5, "s": 0.75, "q": 1.0}


def test_sector_rank_of_ties_and_missing_returns(spark):
    data = [("a", 0.1), ("b", 0.2), ("c", 0.2), ("d", 0.3), ("e", None)]
    panel = spark.createDataFrame([(day("2024-01-01"), "x", s, r) for s, r in data], "date date, sector string, symbol string, return_60d double")
    got = {r["symbol"]: r["sector_rank_60d"] for r in P.sector_rank(panel).collect()}
    assert got == {"a": 0.25, "b": 0.625, "c": 0.625, "d": 1.0, "e": None}


def ohlc(spark, data):
    return spark.createDataFrame(
        [(s, day(d), o, h, lo, c) for s, d, o, h, lo, c in data],
        "symbol string, date date, open double, high double, low double, close double",
    )


def test_forward_returns(spark):
    bars = [("U", "2031-05-05", 20.0, 21.0, 19.0, 20.0), ("U", "2031-05-06", 22.0, 25.0, 15.0, 18.0), ("U", "2031-05-07", 9.0, 27.0, 9.0, 27.0)]
    ahead = P.forward_returns(ohlc(spark, bars)).select("date", *[f"target_t1_{p}_ret" for p in ("open", "high", "low", "close")])
    first, second, last = rows(ahead, "date")
    assert first[1:] == pytest.approx((0.1, 0.25, -0.25, -0.1))
    assert second[1:] == pytest.approx((-0.5, 0.5, -0.5, 0.5))
    assert last[1:] == (None,) * 4


def test_label_is_strict_and_zero_for_missing(spark):
    frame = spark.createDataFrame([(1, 0.5), (2, 0.1251), (3, 0.125), (4, -0.3), (5, None)], "i int, target_t1_high_ret double")
    assert [r["target_spike_class"] for r in L.label_spike(frame, 0.125).orderBy("i").collect()] == [1, 1, 0, 0, 0]


BARRIER_CASES = {
    # Bars after an entry at 50 as (high, low, close), with barriers at 60 and 45, and the expected label.
    "gain first": ([(61.0, 47.0, 52.0), (50.0, 30.0, 31.0), (50.0, 50.0, 50.0)], 1.0),
    "loss first": ([(55.0, 44.0, 46.0), (70.0, 50.0, 69.0), (69.0, 69.0, 69.0)], 0.0),
    "both in a day": ([(59.0, 46.0, 50.0), (60.0, 45.0, 58.0), (58.0, 58.0, 58.0)], 0.0),
    "last day up": ([(52.0, 48.0, 49.0), (53.0, 47.0, 48.0), (54.0, 48.0, 50.5)], 1.0),
    "last day down": ([(52.0, 48.0, 51.0), (53.0, 47.0, 52.0), (54.0, 48.0, 49.0)], 0.0),
    "last day even": ([(52.0, 48.0, 51.0), (53.0, 47.0, 52.0), (54.0, 48.0, 50.0)], 0.0),
    "history ends": ([(52.0, 48.0, 51.0)], None),
    "gain before the end": ([(52.0, 48.0, 51.0), (60.0, 47.0, 51.0)], 1.0),
}


def test_triple_barrier(spark):
    data = []
    for symbol, (bars, _) in BARRIER_CASES.items():
        data.append((symbol, "2031-05-05", 50.0, 50.0, 50.0, 50.0))
        for i, (high, low, close) in enumerate(bars):
            data.append((symbol, f"2031-05-{i + 6:02d}", 50.0, high, low, close))
    got = L.triple_barrier(ohlc(spark, data), 0.2, 0.1, 3).where(F.col("date") == day("2031-05-05"))
    assert {r["symbol"]: r["target_spike_class"] for r in got.collect()} == {s: e for s, (_, e) in BARRIER_CASES.items()}


def test_long_barriers_equal_the_bars_one_by_one(spark, monkeypatch):
    """Both ways, on walks with gaps, jumps to the barrier itself, missing and negative prices, and short symbols."""
    r = random.Random(8)
    data = []
    for s, n in (("a", 300), ("b", 90), ("c", 3), ("d", 1), ("e", 160)):
        price = 50.0
        for i in range(n):
            price = 50.0 if r.random() < 0.05 else price * (1 + r.gauss(0, 0.01))
            bar = [price, price * (1 + abs(r.gauss(0, 0.02))), price * (1 - abs(r.gauss(0, 0.02))), price]
            if s == "e":
                bar = [None if r.random() < 0.1 else x if r.random() < 0.9 else r.choice([0.0, -50.0, 60.0, 45.0]) for x in bar]
            data.append((s, str(day("2030-01-01") + dt.timedelta(i)), *bar))
    panel = ohlc(spark, data).repartition(3)
    for days in (1, 2, 7, 33, 64, 250):
        monkeypatch.setattr(L, "BARS_WITH_A_ROW", 1000)
        wanted = rows(L.triple_barrier(panel, 0.2, 0.1, days).select("symbol", "date", "target_spike_class"), "symbol", "date")
        monkeypatch.setattr(L, "BARS_WITH_A_ROW", 0)
        found = L.triple_barrier(panel, 0.2, 0.1, days)
        assert found.columns == [*panel.columns, "target_spike_class"]
        assert rows(found.select("symbol", "date", "target_spike_class"), "symbol", "date") == wanted
    assert len({r[2] for r in wanted}) == 3


def test_long_barriers_collect_no_bars(spark):
    panel = ohlc(spark, [("a", "2031-05-05", 1.0, 1.0, 1.0, 1.0)])
    plan = L.triple_barrier(panel, 0.2, 0.1, 250)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_snapshot_takes_the_last_known_value_per_column(spark):
    panel = spark.createDataFrame(
        [("A", day("2024-01-01"), 1.0, 0.1, "x"), ("A", day("2024-01-02"), None, 0.2, "x"), ("A", day("2024-01-03"), 3.0, None, "x"), ("B", day("2024-01-01"), 1.0, None, "y")],
        "symbol string, date date, close double, return_60d double, sector string",
    )
    assert rows(P.latest_snapshot(panel).select("symbol", "date", "close", "return_60d"), "symbol") == [("A", day("2024-01-02"), 1.0, 0.2)]


def earnings(spark, data, seq=False):
    schema = "symbol string, date date, eps_estimate double, reported_eps double, surprise_pct double" + (", seq int" if seq else "")
    return spark.createDataFrame([(r[0], day(r[1]), *r[2:]) for r in data], schema)


def test_first_duplicate_hides_the_others(spark):
    panel = closes(spark, [("A", "2024-01-01", 1.0), ("B", "2024-01-01", 1.0)])
    events = earnings(
        spark,
        [("A", "2024-01-01", 1.0, 1.0, None, 1), ("A", "2024-01-01", 1.0, 1.0, 5.0, 2), ("B", "2024-01-01", 1.0, 1.0, 7.0, 1), ("B", "2024-01-01", 1.0, 1.0, 9.0, 2)],
        seq=True,
    )
    assert rows(E.event_join(panel, events).select("symbol", "surprise_pct"), "symbol") == [("B", 7.0)]


def test_standardised_surprise(spark):
    """The surprise over the deviation of up to eight earlier ones, from the fifth on."""
    import statistics

    surprises = [3.0, -1.0, 0.5, 7.0, 2.0, -4.0, 1.0, 1.5, 9.0, -2.5, 6.0]
    data = [("U", str(day("2031-01-01") + dt.timedelta(91 * i)), 1.0, 1.0, v) for i, v in enumerate(surprises)]
    data += [("FLAT", str(day("2031-01-01") + dt.timedelta(91 * i)), 1.0, 1.0, -2.0) for i in range(7)]
    got = rows(E.standardised_surprise(earnings(spark, data)).select("symbol", "date", "sue"), "symbol", "date")
    expected = [None if i < 4 else v / statistics.stdev(surprises[max(0, i - 8) : i]) for i, v in enumerate(surprises)]
    assert [r[2] for r in got if r[0] == "U"][4:] == pytest.approx(expected[4:])
    assert [r[2] for r in got if r[0] == "U"][:4] == [None] * 4
    assert all(r[2] is None for r in got if r[0] == "FLAT")


def test_upcoming_and_next(spark):
    events = earnings(
        spark,
        [("VOLE", "2026-03-01", 2.0, None, None), ("UNAU", "2026-02-01", 1.0, None, None), ("UNAU", "2026-05-01", 1.5, None, None), ("OLD", "2025-01-01", 1.0, None, None), ("DONE", "2026-02-01", 1.0, 1.0, 0.0), ("NONE", "2026-02-01", None, None, None), ("NOSNAP", "2026-02-01", 1.0, None, None)],
    )
    snapshot = spark.createDataFrame(
        [("UNAU", day("2025-12-31"), "tech", 0.1), ("VOLE", day("2025-12-31"), "tech", 0.2), ("DONE", day("2025-12-31"), "x", 0.0)],
        "symbol string, date date, sector string, return_60d double",
    )
    as_of = day("2026-01-01")
    assert [r[0] for r in rows(E.upcoming_earnings(events, snapshot, as_of), "date")] == ["UNAU", "VOLE", "UNAU"]
    soonest = rows(E.next_upcoming(events, snapshot, as_of).select("symbol", "event_date", "eps_estimate"), "symbol")
    assert soonest == [("UNAU", day("2026-02-01"), 1.0), ("VOLE", day("2026-03-01"), 2.0)]
    assert E.for_ticker(events, " vole ").count() == 1


def test_scenario_grid(spark):
    grid = rows(E.scenario_grid(spark.createDataFrame([(0.8,)], "eps_estimate double"), -50, 50, 25), "surprise_pct")
    assert [(r[1], r[2]) for r in grid] == [(-50, pytest.approx(0.4)), (-25, pytest.approx(0.6)), (0, pytest.approx(0.8)), (25, pytest.approx(1.0)), (50, pytest.approx(1.2))]


def series(spark, days=80):
    start = day("2031-03-03")
    data = []
    for i in range(days):
        close = 40.0 + i % 9 + 0.25 * i
        data.append(("UNAU", start + dt.timedelta(i), close, close + 2, close - 0.5, close, 3e4))
    return spark.createDataFrame(data, "symbol string, date date, open double, high double, low double, close double, volume double")


def event_at(spark, i):
    return earnings(spark, [("UNAU", str(day("2031-03-03") + dt.timedelta(i)), 0.9, 0.72, -20.0)])


def test_event_features_end_to_end(spark):
    meta = spark.createDataFrame([("UNAU", "ships")], "symbol string, sector string")
    got = PF.event_features(series(spark), meta, event_at(spark, 72)).collect()
    close = [40.0 + i % 9 + 0.25 * i for i in range(80)]
    assert len(got) == 1
    assert got[0]["return_60d"] == pytest.approx(close[72] / close[12] - 1)
    assert got[0]["return_14d"] == pytest.approx(close[72] / close[58] - 1)
    assert got[0]["sector_rank_60d"] == 1.0
    assert got[0]["target_t1_high_ret"] == pytest.approx((close[73] + 2 - close[72]) / close[72])
    assert got[0]["target_spike_class"] == 1
    snapshot = PF.price_snapshot(series(spark), meta).collect()
    assert [r["date"] for r in snapshot] == [day("2031-03-03") + dt.timedelta(79)]


def test_event_features_checks_its_windows(spark):
    with pytest.raises(ValueError, match="14"):
        PF.event_features(None, None, None, windows=(60,))


def test_event_features_with_barrier_and_sue(spark):
    meta = spark.createDataFrame([("UNAU", "ships")], "symbol string, sector string")
    events = event_at(spark, 72)
    row = PF.event_features(series(spark), meta, events, barrier={"days": 3}, with_sue=True).first()
    assert row["target_spike_class"] == 1.0
    assert row["sue"] is None

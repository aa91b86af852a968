"""Queries on portfolios, resampling and prediction scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.operators import events as E
from eventlab.operators import metrics as M
from eventlab.operators import portfolio as PO
from eventlab.operators import resample as R
from eventlab.operators import serving as S
from eventlab.plans import backtests as B
from eventlab.schemas import KPIS, target
from eventlab.sources import market as K
from eventlab.storage import stored

from .ctes import curve_ctes, kpi_ctes, with_ctes
from .shape import r6, r6_all, tidy

REPS = 2000
HORIZON = 20
TRANCHES = 5


def _test(spark, sf):
    return K.predictions(spark, sf)


def _signals(spark, sf):
    return B.signals(_test(spark, sf))


def _cut(df):
    """Plans that use their trades several times start from a checkpoint."""
    return stored(df)


def filter_signals(spark, sf):
    return tidy(PO.filter_signals(_test(spark, sf)).select("symbol", "date", "y_pred_proba"))


def limit_order_returns(spark, sf):
    rows = PO.limit_order_returns(_signals(spark, sf), 0.07)
    return tidy(rows.select("symbol", "date", "realized_return"))


def daily_returns(spark, sf):
    return tidy(PO.daily_returns(_signals(spark, sf)))


def daily_returns_capped(spark, sf):
    return tidy(PO.daily_returns(_signals(spark, sf), cap=0.2))


def equity_curve(spark, sf):
    daily = PO.daily_returns(_signals(spark, sf), cap=0.2)
    return tidy(PO.equity_curve(daily).select("run_id", "date", "daily_return", "equity"))


def drawdown(spark, sf):
    daily = PO.daily_returns(_signals(spark, sf), cap=0.2)
    return tidy(PO.drawdown(PO.equity_curve(daily)).select("run_id", "date", "equity", "drawdown"))


def backtest_kpis(spark, sf):
    return tidy(PO.backtest_kpis(_signals(spark, sf), cap=0.2))


def event_backtest(spark, sf):
    """One run per sector, and a run whose score never signals."""
    rows = _cut(_test(spark, sf))
    silent = rows.withColumns({"run_id": F.lit("silent"), "y_pred_proba": F.lit(0.0)})
    return tidy(B.event_backtest(rows.withColumn("run_id", F.col("sector")).unionByName(silent), cap=0.2))


def payoff_stats(spark, sf):
    return tidy(PO.payoff_stats(_signals(spark, sf)))


def payoff_by_sector(spark, sf):
    return tidy(PO.payoff_stats(_signals(spark, sf), ["run_id", "sector"]))


def exclude_top_n(spark, sf):
    rows = PO.exclude_top_n(_signals(spark, sf), 10)
    return tidy(rows.select("symbol", "date", target(1, "close")))


def robustness_table(spark, sf):
    return tidy(B.robustness(_cut(_test(spark, sf))))


def trade_day_stats(spark, sf):
    return tidy(PO.trade_day_stats(_signals(spark, sf)))


def cost_sweep(spark, sf):
    return tidy(B.cost_sweep(_signals(spark, sf)))


def position_sizing(spark, sf):
    return tidy(B.position_sizing(_signals(spark, sf)))


def threshold_sweep(spark, sf):
    return tidy(B.threshold_sweep(_cut(_test(spark, sf))))


def target_execution_alignment(spark, sf):
    return tidy(B.target_execution_alignment(_cut(_test(spark, sf))))


def tranche_slots(spark, sf):
    return tidy(PO.tranche_slots(_signals(spark, sf), HORIZON, TRANCHES))


def tranche_backtest(spark, sf):
    """The trades that capital allows."""
    rows = PO.tranche_trades(_cut(_signals(spark, sf)), HORIZON, TRANCHES)
    return tidy(rows.select("symbol", "date", target(1, "close")))


def tranche_kpis(spark, sf):
    rows = _cut(_test(spark, sf).where(F.col(target(1, "close")).isNotNull()))
    return tidy(B.tranche_backtest(rows, HORIZON, tranches=TRANCHES))


def horizon_rule(spark, sf):
    rows = _cut(K.predictions(spark, sf, horizon=HORIZON, label_price="close"))
    return tidy(B.horizon_rule(rows, HORIZON))


def bootstrap_kpis(spark, sf):
    return tidy(R.bootstrap_kpis(_cut(_signals(spark, sf)), REPS, cap=0.2))


def confidence_interval(spark, sf):
    """Central 95 % of the returns and the score over all test predictions."""
    rows = _test(spark, sf)
    return tidy(R.confidence_interval(rows, [target(1, "close"), target(1, "high"), "y_pred_proba"]))


def kpi_intervals(spark, sf):
    return tidy(B.kpi_intervals(_cut(_signals(spark, sf)), REPS))


def exposure_matched_trades(spark, sf):
    rows = _cut(_test(spark, sf))
    drawn = R.exposure_matched_trades(rows, B.signals(rows), 20)
    return tidy(drawn.select("seed", "date", "symbol"))


def exposure_matched_random(spark, sf):
    rows = _cut(_test(spark, sf))
    return tidy(R.exposure_matched_random(rows, B.signals(rows), 20))


def baseline_rules(spark, sf):
    return tidy(B.baseline_rules(_cut(_test(spark, sf)), 20))


def seeded_ticker_sample(spark, sf):
    return R.seeded_ticker_sample(K.features(spark, sf), 30)


def classification_metrics(spark, sf):
    return tidy(M.classification_metrics(K.scored_features(spark, sf), ["split"]))


def brier_score(spark, sf):
    return tidy(M.brier_score(K.scored_features(spark, sf), ["split"]))


def calibration_curve(spark, sf):
    return tidy(M.calibration_curve(_test(spark, sf)))


def walk_forward_rule(spark, sf):
    per_fold, _ = B.walk_forward_rule(_cut(K.scored_features(spark, sf)), K.SPLIT_DATE)
    return tidy(per_fold)


def fold_summary(spark, sf):
    _, summary = B.walk_forward_rule(_cut(K.scored_features(spark, sf)), K.SPLIT_DATE)
    return tidy(summary)


def attribution_rank(spark, sf):
    """Contributions to the rule score's log-odds against fixed reference values."""
    reference = {"surprise_pct": 0.0, "return_60d": 0.0, "sector_rank_60d": 0.5}
    rows = S.linear_attribution(_test(spark, sf), K.RULE_WEIGHTS, reference)
    return tidy(S.attribution_rank(rows))


def pead_backtest(spark, sf):
    return tidy(PO.backtest_kpis(B.signals(E.pead_rule(_test(spark, sf))), cap=0.2))


QUERIES = {
    f.__name__: f
    for f in (
        filter_signals, limit_order_returns, daily_returns, daily_returns_capped, equity_curve, drawdown,
        backtest_kpis, event_backtest, payoff_stats, payoff_by_sector, exclude_top_n, robustness_table,
        trade_day_stats, cost_sweep, position_sizing, threshold_sweep, target_execution_alignment, tranche_slots,
        tranche_backtest, tranche_kpis, horizon_rule, bootstrap_kpis, confidence_interval, kpi_intervals,
        exposure_matched_trades, exposure_matched_random, baseline_rules, seeded_ticker_sample,
        classification_metrics, brier_score, calibration_curve, walk_forward_rule, fold_summary,
        attribution_rank, pead_backtest,
    )
}

KPI = r6_all(*KPIS)
RET = "target_t1_close_ret"
PAYOFF = f"""coalesce(avg(CASE WHEN {RET} > 0 THEN {RET} END), 0) AS avg_win,
    coalesce(avg(CASE WHEN {RET} <= 0 THEN {RET} END), 0) AS avg_loss"""


def _payoff(table: str, keys: str, ret: str = RET) -> str:
    return f"SELECT {keys}, {PAYOFF.replace(RET, ret)} FROM {table} GROUP BY {keys}"


RATIO = r6("abs(avg_win / nullif(avg_loss, 0))", "payoff_ratio")
METRICS = """avg(CASE WHEN y_pred = {label} THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
    coalesce(count(CASE WHEN y_pred = 1 AND {label} = 1 THEN 1 END)::DOUBLE
        / nullif(count(CASE WHEN y_pred = 1 THEN 1 END), 0), 0) AS precision"""


def _hash(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


def _part(digest: str, i: int, width: int) -> str:
    return f"CAST('0x' || substr({digest}, {1 + width * i}, {width}) AS BIGINT)"


RANKED = f"SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {RET} DESC NULLS LAST, date, symbol) AS best FROM sig"
DRAWS = {
    "numbered": f"""SELECT date, symbol, {RET}, row_number() OVER (ORDER BY date, symbol, {RET}) - 1 AS place, count(*) OVER () AS n FROM sig""",
    "pairs": f"""SELECT rep, p, n, md5(concat_ws('|', 42, rep, p)) AS digest FROM (SELECT max(n) AS n FROM numbered),
        LATERAL (SELECT unnest(range((n + 1) // 2)) AS p), range(0, {REPS}) r(rep)""",
    "shares": f"""SELECT rep, pick % n // {R.BLOCK} AS block, count(*) AS draws, any_value(n) AS n FROM (
        SELECT rep, n, {_part('digest', 0, 15)} AS pick FROM pairs UNION ALL
        SELECT rep, n, {_part('digest', 1, 15)} FROM pairs WHERE 2 * p + 1 < n) GROUP BY rep, block""",
    "quads": """SELECT rep, block, draws, n, q, md5(concat_ws('|', 'own', 42, rep, block, q)) AS digest
        FROM (SELECT *, unnest(range((draws + 3) // 4)) AS q FROM shares)""",
    "resampled": f"""SELECT 'rule' AS run_id, rep, t.date, t.{RET} FROM (
        {' UNION ALL '.join(f"SELECT rep, block, n, {_part('digest', i, 8)} AS pick FROM quads WHERE 4 * q + {i} < draws" for i in range(4))}) d
        JOIN numbered t ON t.place = block * {R.BLOCK} + pick % least({R.BLOCK}, d.n - block * {R.BLOCK})""",
    **kpi_ctes("resampled", "run_id, rep"),
}
RANDOM = {
    "wanted": "SELECT date, count(*) AS n FROM sig GROUP BY date",
    "drawn": """SELECT 'rule' AS run_id, seed, date, symbol, target_t1_close_ret FROM (
        SELECT test.*, seed, n, row_number() OVER (PARTITION BY seed, date
            ORDER BY md5(concat_ws('|', seed, date, symbol)), symbol) AS place
        FROM test JOIN wanted USING (date) CROSS JOIN range(0, 20) s(seed)) WHERE place <= n""",
}
RANDOM_KPI = {**RANDOM, **kpi_ctes("drawn", "run_id, seed")}


def _business_days(date: str, days: int) -> str:
    worked = f"least(isodow({date}) - 1, 4)"
    return f"CAST({date} - CAST(isodow({date}) - 1 - {worked} AS INTEGER) + CAST({days} + 2 * (({worked} + {days}) // 5) AS INTEGER) AS DATE)"


def _tranches(trades: str, horizon: int, tranches: int, ret: str) -> dict[str, str]:
    return {
        "days": f"""SELECT date, count(*) AS n, {_business_days('date', horizon)} AS release,
            row_number() OVER (ORDER BY date) AS i FROM {trades} GROUP BY date""",
        "state": f"""SELECT i, date, [{{'r': release, 'k': least(n, {tranches})}}] AS held, least(n, {tranches}) AS slots
            FROM days WHERE i = 1
            UNION ALL
            SELECT i, date, CASE WHEN take > 0 THEN list_append(kept, {{'r': release, 'k': take}}) ELSE kept END, take FROM (
                SELECT *, least(n, {tranches} - coalesce(list_sum(list_transform(kept, lambda h: h.k)), 0))::BIGINT AS take FROM (
                    SELECT d.*, list_filter(s.held, lambda h: h.r > d.date) AS kept
                    FROM state s JOIN days d ON d.i = s.i + 1))""",
        "accepted": f"""SELECT * FROM (SELECT t.*, s.slots, row_number() OVER (PARTITION BY t.date ORDER BY t.symbol) AS place
            FROM {trades} t JOIN state s ON s.date = t.date) WHERE place <= slots""",
        "daily": f"""SELECT run_id, date, sum({ret} - 0.001) * {1 / tranches!r}::DOUBLE AS daily_return, count(*) AS trades,
            sum(CASE WHEN {ret} > 0 THEN 1 ELSE 0 END) AS wins FROM accepted GROUP BY run_id, date""",
        **curve_ctes("run_id"),
    }


# The 20 row horizon: its own forward returns, and features without a complete one dropped.
H = HORIZON
LONG = {
    "fwdh": f"""SELECT *, (lead(high, {H}) OVER w - close) / close AS target_h_high,
        (lead(close, {H}) OVER w - close) / close AS target_h_close FROM ranked
        WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "sigh": """SELECT *, 'rule' AS run_id FROM (SELECT *, 1 / (1 + exp(-(((-0.5 + surprise_pct * 0.05) + return_60d * 5.0)
            + sector_rank_60d))) AS y_pred_proba FROM fwdh JOIN earn USING (symbol, date))
        WHERE surprise_pct IS NOT NULL AND return_60d IS NOT NULL AND target_h_high IS NOT NULL
        AND date >= DATE '2000-01-01' AND y_pred_proba > 0.5""",
}
FOLDED = {
    "folded": """SELECT *, CAST(floor(((year(date) - 2000) * 12 + month(date) - 1) / 6) AS BIGINT) AS i FROM scored
        WHERE date >= DATE '2000-01-01'""",
    "fold_rows": """SELECT i, row_number() OVER (ORDER BY i) AS fold, count(*) AS n_test,
        CAST(DATE '2000-01-01' + to_months(CAST(i * 6 AS INTEGER)) AS DATE) AS test_start,
        CAST(DATE '2000-01-01' + to_months(CAST(i * 6 + 6 AS INTEGER)) AS DATE) AS test_end FROM folded GROUP BY i""",
    "fsig": "SELECT f.*, fold FROM folded f JOIN fold_rows USING (i) WHERE y_pred_proba > 0.5",
    **kpi_ctes("fsig", "fold"),
    "fmetrics": f"SELECT fold, {METRICS.format(label='target_spike_class')} FROM folded JOIN fold_rows USING (i) GROUP BY fold",
    "per_fold": """SELECT fold, test_start, test_end, (SELECT count(*) FROM scored WHERE date < test_start) AS n_train, n_test,
        precision, coalesce(total_return, 0) AS total_return, coalesce(win_rate, 0) AS win_rate,
        coalesce(max_drawdown, 0) AS max_drawdown, coalesce(sharpe, 0) AS sharpe, coalesce(trades, 0) AS trades
        FROM fold_rows JOIN fmetrics USING (fold) LEFT JOIN kpi USING (fold)""",
}
ALIGNED = {
    "variants": f"""SELECT v.variant, date, symbol, y_pred, y_pred_proba,
        CASE WHEN (CASE v.variant WHEN 'close_aligned' THEN {RET} ELSE target_t1_high_ret END) > 0.07 THEN 1 ELSE 0 END AS label,
        CASE WHEN v.variant = 'limit_order_aligned' AND target_t1_high_ret >= 0.07 THEN 0.07::DOUBLE ELSE {RET} END AS ret
        FROM test CROSS JOIN (VALUES ('mismatched'), ('close_aligned'), ('limit_order_aligned')) v(variant)
        WHERE {RET} IS NOT NULL""",
    "vsig": "SELECT * FROM variants WHERE y_pred_proba > 0.5",
    **kpi_ctes("vsig", "variant", "ret"),
}
RUNS = {
    "many": """SELECT * REPLACE (sector AS run_id) FROM test
        UNION ALL SELECT * REPLACE ('silent' AS run_id, 0.0 AS y_pred_proba) FROM test""",
    "msig": "SELECT * FROM many WHERE y_pred_proba > 0.5",
    **kpi_ctes("msig", "run_id"),
}
INTERVALS = " UNION ALL ".join(
    f"SELECT run_id, '{k}' AS metric, {{point}} quantile_cont({k}, [0.025, 0.975]) AS b FROM kpi GROUP BY run_id" for k in KPIS
)


def _bounds(prefix: str = "") -> str:
    return f"{r6('b[1]', 'lower')}, {r6('b[2]', 'upper')}, b[1] <= 0 AND b[2] >= 0 AS includes_zero"


SQL = {
    "filter_signals": with_ctes(f"SELECT symbol, date, {r6('y_pred_proba')} FROM test WHERE y_pred_proba > 0.5"),
    "limit_order_returns": with_ctes(
        f"SELECT symbol, date, {r6(f'CASE WHEN target_t1_high_ret >= 0.07 THEN 0.07::DOUBLE ELSE {RET} END', 'realized_return')} FROM sig"
    ),
    "daily_returns": with_ctes(
        f"SELECT run_id, date, {r6('daily_return')}, trades, CAST(wins AS BIGINT) AS wins FROM daily", kpi_ctes("sig", "run_id", cap=None)
    ),
    "daily_returns_capped": with_ctes(
        f"SELECT run_id, date, {r6('daily_return')}, trades, CAST(wins AS BIGINT) AS wins FROM daily", kpi_ctes("sig", "run_id")
    ),
    "equity_curve": with_ctes(
        f"SELECT run_id, date, {r6('daily_return')}, {r6('equity')} FROM equity", kpi_ctes("sig", "run_id")
    ),
    "drawdown": with_ctes(
        f"SELECT run_id, date, {r6('equity')}, {r6('drawdown')} FROM curve", kpi_ctes("sig", "run_id")
    ),
    "backtest_kpis": with_ctes(f"SELECT run_id, {KPI}, trades FROM kpi", kpi_ctes("sig", "run_id")),
    "event_backtest": with_ctes(
        f"""SELECT run_id, {', '.join(r6(f'coalesce({k}, 0)', k) for k in KPIS)}, coalesce(trades, 0) AS trades
        FROM (SELECT DISTINCT run_id FROM many) LEFT JOIN kpi USING (run_id)""",
        RUNS,
    ),
    "payoff_stats": with_ctes(
        f"SELECT run_id, {r6_all('avg_win', 'avg_loss')}, {RATIO} FROM payoff", {"payoff": _payoff("sig", "run_id")}
    ),
    "payoff_by_sector": with_ctes(
        f"SELECT run_id, sector, {r6_all('avg_win', 'avg_loss')}, {RATIO} FROM payoff",
        {"payoff": _payoff("sig", "run_id, sector")},
    ),
    "exclude_top_n": with_ctes(f"SELECT symbol, date, {r6(RET)} FROM best_first WHERE best > 10", {"best_first": RANKED}),
    "robustness_table": with_ctes(
        f"""SELECT run_id, CAST(excluded AS BIGINT) AS excluded, {KPI}, trades, {r6_all('avg_win', 'avg_loss')}, {RATIO}
        FROM kpi JOIN payoff USING (run_id)""",
        {
            "best_first": RANKED,
            "trimmed": "SELECT * FROM best_first CROSS JOIN (VALUES (5), (10), (20)) t(excluded) WHERE best > excluded",
            **kpi_ctes("trimmed", "run_id, excluded"),
            "payoff": _payoff("sig", "run_id"),
        },
    ),
    "trade_day_stats": with_ctes(
        f"""SELECT run_id, CAST(sum(n) AS BIGINT) AS trades, count(*) AS days, {r6('median(n)', 'median_per_day')}, max(n) AS max_per_day
        FROM (SELECT run_id, date, count(*) AS n FROM sig GROUP BY ALL) GROUP BY run_id"""
    ),
    "cost_sweep": with_ctes(
        f"SELECT run_id, cost, {KPI}, trades FROM kpi",
        {
            "swept": "SELECT * FROM sig CROSS JOIN (VALUES (0.001::DOUBLE), (0.003::DOUBLE), (0.006::DOUBLE), (0.015::DOUBLE)) c(cost)",
            **kpi_ctes("swept", "run_id, cost", cost="cost"),
        },
    ),
    "position_sizing": with_ctes(
        f"SELECT run_id, w AS max_position_weight, {KPI}, trades FROM kpi",
        {
            "swept": "SELECT * FROM sig CROSS JOIN (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.33::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) c(w)",
            **kpi_ctes("swept", "run_id, w", cap="w"),
        },
    ),
    "threshold_sweep": with_ctes(
        f"""SELECT run_id, threshold, {KPI}, trades, {r6('positive_rate')} FROM kpi JOIN (
            SELECT threshold, count(CASE WHEN target_t1_high_ret > threshold THEN 1 END)::DOUBLE / count(*) AS positive_rate
            FROM test CROSS JOIN (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.07::DOUBLE), (0.1::DOUBLE)) c(threshold) GROUP BY threshold)
        USING (threshold)""",
        {
            "swept": f"""SELECT *, CASE WHEN target_t1_high_ret >= threshold THEN threshold ELSE {RET} END AS ret
                FROM sig CROSS JOIN (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.07::DOUBLE), (0.1::DOUBLE)) c(threshold)""",
            **kpi_ctes("swept", "run_id, threshold", "ret"),
        },
    ),
    "target_execution_alignment": with_ctes(
        f"""SELECT variant, {r6_all('accuracy', 'precision')}, {KPI}, trades FROM kpi
        JOIN (SELECT variant, {METRICS.format(label='label')} FROM variants GROUP BY variant) USING (variant)""",
        ALIGNED,
    ),
    "tranche_slots": with_ctes(
        "SELECT 'rule' AS run_id, date, slots FROM state WHERE slots > 0", _tranches("sig", H, TRANCHES, RET), True
    ),
    "tranche_backtest": with_ctes(
        f"SELECT symbol, date, {r6(RET)} FROM accepted", _tranches("sig", H, TRANCHES, RET), True
    ),
    "tranche_kpis": with_ctes(f"SELECT run_id, {KPI}, trades FROM kpi", _tranches("sig", H, TRANCHES, RET), True),
    "horizon_rule": with_ctes(
        f"SELECT run_id, {KPI}, trades, {r6_all('avg_win', 'avg_loss')}, {RATIO} FROM kpi JOIN payoff USING (run_id)",
        {**LONG, **_tranches("sigh", H, H, "target_h_close"), "payoff": _payoff("accepted", "run_id", "target_h_close")},
        True,
    ),
    "bootstrap_kpis": with_ctes(f"SELECT run_id, rep, {KPI}, trades FROM kpi", DRAWS),
    "confidence_interval": with_ctes(
        " UNION ALL ".join(
            f"SELECT run_id, metric, {_bounds()} FROM (SELECT run_id, '{c}' AS metric, quantile_cont({c}, [0.025, 0.975]) AS b FROM test GROUP BY run_id)"
            for c in (RET, "target_t1_high_ret", "y_pred_proba")
        )
    ),
    "kpi_intervals": with_ctes(
        f"""SELECT run_id, metric, {r6('point_estimate')}, {_bounds()} FROM ({INTERVALS.replace('{point}', '')})
        JOIN ({' UNION ALL '.join(f"SELECT '{k}' AS metric, {k} AS point_estimate FROM point" for k in KPIS)}) USING (metric)""",
        {
            **DRAWS,
            "pdaily": kpi_ctes("sig", "run_id")["daily"],
            "pequity": curve_ctes("run_id")["equity"].replace("FROM daily", "FROM pdaily"),
            "pcurve": curve_ctes("run_id")["curve"].replace("FROM equity", "FROM pequity"),
            "point": curve_ctes("run_id")["kpi"].replace("FROM curve", "FROM pcurve"),
        },
    ),
    "exposure_matched_trades": with_ctes("SELECT seed, date, symbol FROM drawn", RANDOM),
    "exposure_matched_random": with_ctes(
        f"SELECT run_id, {', '.join(r6(f'avg({k})', k) for k in KPIS)}, count(*) AS seeds FROM kpi GROUP BY run_id", RANDOM_KPI
    ),
    "baseline_rules": with_ctes(
        f"""SELECT 'exposure_matched_random' AS config, {', '.join(r6(f'avg({k})', k) for k in KPIS)} FROM kpi
        UNION ALL SELECT 'pead_rule', {', '.join(r6(k) for k in KPIS)} FROM point""",
        {
            **RANDOM_KPI,
            "rule": "SELECT * FROM test WHERE surprise_pct > 0",
            "pdaily": kpi_ctes("rule", "run_id")["daily"],
            "pequity": curve_ctes("run_id")["equity"].replace("FROM daily", "FROM pdaily"),
            "pcurve": curve_ctes("run_id")["curve"].replace("FROM equity", "FROM pequity"),
            "point": curve_ctes("run_id")["kpi"].replace("FROM curve", "FROM pcurve"),
        },
    ),
    "seeded_ticker_sample": with_ctes(
        "SELECT symbol FROM (SELECT DISTINCT symbol FROM feat) ORDER BY md5(concat_ws('|', 42, symbol)), symbol LIMIT 30"
    ),
    "classification_metrics": with_ctes(
        f"SELECT split, {r6_all('accuracy', 'precision')}, rows FROM (SELECT split, {METRICS.format(label='target_spike_class')}, count(*) AS rows FROM scored GROUP BY split)"
    ),
    "brier_score": with_ctes(
        f"""SELECT split, {r6('avg((y_pred_proba - target_spike_class) * (y_pred_proba - target_spike_class))', 'brier_score')}
        FROM scored GROUP BY split"""
    ),
    "calibration_curve": with_ctes(
        f"""SELECT {r6('bin * 0.1::DOUBLE', 'bin_low')}, {r6('(bin + 1) * 0.1::DOUBLE', 'bin_high')},
        {r6('avg(y_pred_proba)', 'mean_predicted')}, {r6('avg(target_spike_class::DOUBLE)', 'fraction_positive')}, count(*) AS count
        FROM (SELECT *, len(list_filter([{', '.join(f'{i * 0.1!r}::DOUBLE' for i in range(1, 10))}], lambda e: e <= y_pred_proba)) AS bin FROM test)
        GROUP BY bin"""
    ),
    "walk_forward_rule": with_ctes(
        f"SELECT fold, test_start, test_end, n_train, n_test, {r6('precision')}, {KPI}, trades FROM per_fold", FOLDED
    ),
    "fold_summary": with_ctes(
        " UNION ALL ".join(
            f"""SELECT '{k}' AS metric, {r6(f'avg({k})', 'mean')}, {r6(f'stddev_samp({k})', 'std')},
            {r6(f'min({k})', 'min')}, {r6(f'max({k})', 'max')} FROM per_fold"""
            for k in ("precision", *KPIS)
        ),
        FOLDED,
    ),
    "attribution_rank": with_ctes(
        f"""SELECT symbol, date, feature, {r6('contribution')},
        row_number() OVER (PARTITION BY symbol, date ORDER BY abs(contribution) DESC NULLS LAST, feature) AS place FROM (
            SELECT symbol, date, 'surprise_pct' AS feature, (surprise_pct - 0.0) * 0.05 AS contribution FROM test
            UNION ALL SELECT symbol, date, 'return_60d', (return_60d - 0.0) * 5.0 FROM test
            UNION ALL SELECT symbol, date, 'sector_rank_60d', (sector_rank_60d - 0.5) * 1.0 FROM test)"""
    ),
    "pead_backtest": with_ctes(
        f"SELECT run_id, {KPI}, trades FROM kpi",
        {"rule": "SELECT * FROM test WHERE surprise_pct > 0", **kpi_ctes("rule", "run_id")},
    ),
}

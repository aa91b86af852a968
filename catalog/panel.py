"""Queries on panels, labels and events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from eventlab.operators import events as E
from eventlab.operators import labels as L
from eventlab.operators import metrics as M
from eventlab.operators import panel as P
from eventlab.operators import serving as S
from eventlab.operators import splits as SP
from eventlab.plans import features as PF
from eventlab.schemas import FEATURES, target
from eventlab.sources import market as K
from eventlab.sources import prices as PR
from eventlab.sources import tables as TB

from .ctes import with_ctes
from .shape import r6, r6_all, tidy

AS_OF = dt.date(2001, 6, 30)
FEATURE_COLUMNS = (
    "close volume eps_estimate reported_eps surprise_pct return_14d return_60d sector_rank_60d "
    "target_t1_open_ret target_t1_high_ret target_t1_low_ret target_t1_close_ret"
).split()
#: Trading days of the long barrier.
YEAR = 250
OHLC = ["open", "high", "low", "close"]


def _panel(spark, sf):
    return P.sector_join(K.prices(spark, sf), K.metadata(spark, sf))


def _moved(spark, sf):
    return P.momentum(_panel(spark, sf))


def event_features(spark, sf):
    return tidy(K.features(spark, sf))


def event_features_sue(spark, sf):
    return tidy(K.features(spark, sf, with_sue=True))


def event_features_barrier(spark, sf):
    barrier = {"take_profit": 0.05, "stop_loss": 0.03, "days": 5}
    rows = K.features(spark, sf, barrier=barrier)
    return tidy(rows.select("symbol", "date", "sector_rank_60d", "target_spike_class"))


def price_snapshot(spark, sf):
    rows = PF.price_snapshot(K.prices(spark, sf), K.metadata(spark, sf))
    return tidy(rows.select("symbol", "date", "sector", "close", "return_14d", "return_60d", "sector_rank_60d"))


def adjust_ohlc(spark, sf):
    rows = P.adjust_ohlc(K.raw_prices(spark, sf))
    return tidy(rows.select("symbol", "date", "open", "high", "low", "close", "adjusted_close"))


def bars(spark, sf):
    return tidy(K.prices(spark, sf))


def panel_union(spark, sf):
    raw = K.prices(spark, sf)
    cut = F.lit(K.ADJUSTED_SINCE)
    return tidy(raw.where(F.col("date") < cut).unionByName(raw.where(F.col("date") >= cut)))


def duplicate_bars(spark, sf):
    lines = K.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date")
    )
    return tidy(PR.duplicate_bars(lines))


def sector_join(spark, sf):
    return tidy(_panel(spark, sf).select("symbol", "date", "sector", "close"))


def momentum(spark, sf):
    return tidy(_moved(spark, sf).select("symbol", "date", "return_14d", "return_60d"))


def sector_rank(spark, sf):
    return tidy(P.sector_rank(_moved(spark, sf)).select("symbol", "date", "sector_rank_60d"))


def forward_returns(spark, sf):
    rows = P.forward_returns(_panel(spark, sf))
    return tidy(rows.select("symbol", "date", *[target(1, p) for p in OHLC]))


def forward_returns_20(spark, sf):
    rows = P.forward_returns(_panel(spark, sf), 20)
    return tidy(rows.select("symbol", "date", *[target(20, p) for p in OHLC]))


def label_spike(spark, sf):
    rows = L.label_spike(P.forward_returns(_panel(spark, sf)), 0.07)
    return tidy(rows.select("symbol", "date", "target_spike_class"))


def label_spike_close(spark, sf):
    rows = L.label_spike(P.forward_returns(_panel(spark, sf)), 0.02, price="close")
    return tidy(rows.select("symbol", "date", "target_spike_class"))


def triple_barrier(spark, sf):
    rows = L.triple_barrier(_panel(spark, sf), 0.05, 0.03, 5)
    return tidy(rows.select("symbol", "date", "target_spike_class"))


def triple_barrier_long(spark, sf):
    rows = L.triple_barrier(_panel(spark, sf), 0.09, 0.09, 30)
    return tidy(rows.select("symbol", "date", "target_spike_class"))


def triple_barrier_year(spark, sf):
    rows = L.triple_barrier(_panel(spark, sf), 0.12, 0.12, YEAR)
    return tidy(rows.select("symbol", "date", "target_spike_class"))


def _barrier_sql(take: float, stop: float, days: int) -> str:
    legs = []
    for h in range(1, days + 1):
        legs.append(
            f"CASE WHEN (lead(low, {h}) OVER w - close) / close <= -{stop} THEN 0.0 "
            f"WHEN (lead(high, {h}) OVER w - close) / close >= {take} THEN 1.0 END"
        )
    end = f"CASE WHEN (lead(close, {days}) OVER w - close) / close > 0 THEN 1.0 WHEN lead(close, {days}) OVER w IS NOT NULL THEN 0.0 END"
    return f"CAST(coalesce({', '.join(legs)}, {end}) AS DOUBLE)"


def event_join(spark, sf):
    rows = E.event_join(_panel(spark, sf), K.earnings(spark, sf))
    return tidy(rows.select("symbol", "date", "close", "eps_estimate", "reported_eps", "surprise_pct"))


def earnings_first(spark, sf):
    """Duplicates: every event is listed again with a later place and without a surprise."""
    listed = K.earnings(spark, sf).withColumn("seq", F.lit(2))
    hidden = F.when(F.col("symbol") % 2 == 0, F.col("surprise_pct"))
    copies = listed.withColumns({"seq": F.lit(1), "surprise_pct": hidden})
    return tidy(E.first_per_day(listed.unionByName(copies)).select("symbol", "date", "surprise_pct"))


def sue(spark, sf):
    events = K.earnings(spark, sf).where(F.col("surprise_pct").isNotNull())
    return tidy(E.standardised_surprise(events).select("symbol", "date", "surprise_pct", "sue"))


def pead_rule(spark, sf):
    return tidy(E.pead_rule(K.features(spark, sf)).select("symbol", "date", "y_pred", "y_pred_proba"))


def upcoming_filter(spark, sf):
    """Every symbol's unreported event, as seen on the day before it."""
    rows = E.upcoming(K.earnings(spark, sf), F.date_sub(F.col("date"), 1))
    return tidy(rows.select("symbol", "date", "eps_estimate"))


def _snapshot(spark, sf):
    return PF.price_snapshot(K.prices(spark, sf), K.metadata(spark, sf))


def upcoming_earnings(spark, sf):
    return tidy(E.upcoming_earnings(K.earnings(spark, sf), _snapshot(spark, sf), AS_OF))


def next_upcoming(spark, sf):
    rows = E.next_upcoming(K.earnings(spark, sf), _snapshot(spark, sf), AS_OF)
    return tidy(rows.select("symbol", "event_date", "eps_estimate", "snapshot_date", "return_60d"))


def scenario_grid(spark, sf):
    rows = S.scenario_rows(K.earnings(spark, sf), _snapshot(spark, sf), AS_OF)
    return tidy(rows.select("symbol", "event_date", "surprise_pct", "reported_eps", "sector_rank_60d"))


def latest_snapshot(spark, sf):
    """Last non-null values: the 14 day return is blanked on odd days to leave gaps."""
    gap = F.when(F.dayofmonth("date") % 2 == 0, F.col("return_14d"))
    rows = P.latest_snapshot(_moved(spark, sf).withColumn("return_14d", gap))
    return tidy(rows.select("symbol", "date", "sector", "close", "return_14d", "return_60d"))


def latest_event(spark, sf):
    return tidy(E.latest_event(K.features(spark, sf)).select("symbol", "date", "surprise_pct", "return_60d"))


def dataset_health(spark, sf):
    return tidy(S.dataset_health(K.features(spark, sf)))


def ticker_list(spark, sf):
    return tidy(S.ticker_list(K.features(spark, sf)))


def dropna_filters(spark, sf):
    """Rows each completeness rule keeps, of the panel joined with all earnings."""
    moved = P.forward_returns(_moved(spark, sf))
    rows = moved.join(E.first_per_day(K.earnings(spark, sf)), ["symbol", "date"])
    kept = {
        "rows": F.count("*"),
        "with_surprise": F.count("surprise_pct"),
        "with_return_and_target": F.count_if(F.col("return_60d").isNotNull() & F.col(target(1, "high")).isNotNull()),
        "with_all": F.count_if(
            F.col("surprise_pct").isNotNull() & F.col("return_60d").isNotNull() & F.col(target(1, "close")).isNotNull()
        ),
    }
    return tidy(rows.agg(*[c.alias(n) for n, c in kept.items()]))


def earnings_clean(spark, sf):
    """Events announced late in the evening, five hours behind UTC, of even symbols."""
    evening = F.concat(F.col("date").cast("string"), F.lit(" 22:30:00-05:00"))
    noon = F.concat(F.col("date").cast("string"), F.lit(" 12:00:00+00:00"))
    raw = K.earnings(spark, sf).withColumn("earnings_date", F.when(F.col("symbol") % 2 == 0, evening).otherwise(noon))
    return tidy(TB.earnings_clean(raw.drop("date")))


def chrono_split(spark, sf):
    rows = SP.chrono_split(K.features(spark, sf), K.SPLIT_DATE)
    return tidy(rows.select("symbol", "date", "split"))


def validation_slice(spark, sf):
    rows = SP.chrono_split(K.features(spark, sf), K.SPLIT_DATE).where(F.col("split") == "train")
    return tidy(
        SP.validation_slice(rows, K.VALIDATION_DATE).select("symbol", "date", "is_validation")
    )


def walk_forward_folds(spark, sf):
    return tidy(SP.walk_forward_folds(SP.complete_rows(K.features(spark, sf)), K.SPLIT_DATE, 6))


def fold_assign(spark, sf):
    rows = SP.complete_rows(K.features(spark, sf))
    folds = SP.walk_forward_folds(rows, K.SPLIT_DATE, 6)
    return tidy(SP.fold_assign(rows, folds, K.SPLIT_DATE, 6).select("symbol", "date", "fold", "test_start"))


def class_weight(spark, sf):
    rows = SP.chrono_split(K.features(spark, sf), K.SPLIT_DATE)
    return tidy(M.class_weight(rows, ["split"]))


def spike_rate(spark, sf):
    return tidy(M.spike_rate(K.features(spark, sf), [0.02, 0.05, 0.07, 0.10]))


def complete_features(spark, sf):
    rows = SP.complete_rows(K.features(spark, sf, with_sue=True), [*FEATURES, "sue"])
    return tidy(rows.select("symbol", "date", "sue", *FEATURES))


QUERIES = {
    f.__name__: f
    for f in (
        event_features, event_features_sue, event_features_barrier, price_snapshot, adjust_ohlc, bars,
        panel_union, duplicate_bars, sector_join, momentum, sector_rank, forward_returns, forward_returns_20,
        label_spike, label_spike_close, triple_barrier, triple_barrier_long, triple_barrier_year, event_join, earnings_first, sue,
        pead_rule, upcoming_filter, upcoming_earnings, next_upcoming, scenario_grid, latest_snapshot, latest_event,
        dataset_health, ticker_list, dropna_filters, earnings_clean, chrono_split, validation_slice,
        walk_forward_folds, fold_assign, class_weight, spike_rate, complete_features,
    )
}

BY_SYMBOL = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"
SUE = """SELECT *, CASE WHEN count(surprise_pct) OVER w >= 4 THEN surprise_pct / nullif(stddev_samp(surprise_pct) OVER w, 0) END
    AS sue FROM (SELECT * FROM earn WHERE surprise_pct IS NOT NULL)
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"""
EVENT_SUE = """SELECT *, CASE WHEN count(surprise_pct) OVER w >= 4 THEN surprise_pct / nullif(stddev_samp(surprise_pct) OVER w, 0) END
    AS sue FROM (SELECT * FROM fwd JOIN earn USING (symbol, date) WHERE surprise_pct IS NOT NULL)
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"""
KEPT = "return_60d IS NOT NULL AND target_t1_high_ret IS NOT NULL"
WINDOW_INDEX = "CAST(floor(((year(date) - 2000) * 12 + month(date) - 1) / 6) AS BIGINT)"
COMPLETE = "eps_estimate IS NOT NULL AND reported_eps IS NOT NULL AND sector_rank_60d IS NOT NULL"
FOLDS = f"""SELECT row_number() OVER (ORDER BY i) AS fold,
    CAST(DATE '2000-01-01' + to_months(CAST(i * 6 AS INTEGER)) AS DATE) AS test_start,
    CAST(DATE '2000-01-01' + to_months(CAST(i * 6 + 6 AS INTEGER)) AS DATE) AS test_end,
    (SELECT count(*) FROM feat WHERE {COMPLETE}
        AND date < CAST(DATE '2000-01-01' + to_months(CAST(i * 6 AS INTEGER)) AS DATE)) AS n_train, n_test
    FROM (SELECT {WINDOW_INDEX} AS i, count(*) AS n_test FROM feat WHERE {COMPLETE} AND date >= DATE '2000-01-01' GROUP BY 1)"""

SQL = {
    "event_features": with_ctes(
        f"SELECT date, symbol, sector, {r6_all(*FEATURE_COLUMNS)}, CAST(target_spike_class AS BIGINT) AS target_spike_class FROM feat"
    ),
    "event_features_sue": with_ctes(
        f"""SELECT date, symbol, sector, {r6_all(*FEATURE_COLUMNS, 'sue')},
        CAST(CASE WHEN target_t1_high_ret > 0.07 THEN 1 ELSE 0 END AS BIGINT) AS target_spike_class
        FROM esue WHERE {KEPT}""",
        {"esue": EVENT_SUE},
    ),
    "event_features_barrier": with_ctes(
        f"""SELECT symbol, date, {r6('sector_rank_60d')}, target_spike_class
        FROM (SELECT *, {_barrier_sql(0.05, 0.03, 5)} AS target_spike_class FROM fwd {BY_SYMBOL})
        JOIN earn USING (symbol, date) WHERE surprise_pct IS NOT NULL AND {KEPT}"""
    ),
    "price_snapshot": with_ctes(
        f"SELECT symbol, date, sector, {r6_all('close', 'return_14d', 'return_60d', 'sector_rank_60d')} FROM snapshot"
    ),
    "adjust_ohlc": with_ctes(
        f"""SELECT symbol, date, {r6('open')}, {r6('high')}, {r6('low')},
        {r6("close * CASE WHEN date < DATE '1998-01-01' THEN 2 ELSE 1 END", 'close')}, {r6('close', 'adjusted_close')} FROM px"""
    ),
    "bars": with_ctes(f"SELECT symbol, date, {r6_all(*OHLC, 'volume')} FROM px"),
    "panel_union": with_ctes(f"SELECT symbol, date, {r6_all(*OHLC, 'volume')} FROM px"),
    "duplicate_bars": """SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, count(*) AS bars
        FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "sector_join": with_ctes(f"SELECT symbol, date, sector, {r6('close')} FROM panel"),
    "momentum": with_ctes(f"SELECT symbol, date, {r6_all('return_14d', 'return_60d')} FROM mom"),
    "sector_rank": with_ctes(f"SELECT symbol, date, {r6('sector_rank_60d')} FROM ranked"),
    "forward_returns": with_ctes(f"SELECT symbol, date, {r6_all(*[target(1, p) for p in OHLC])} FROM fwd"),
    "forward_returns_20": with_ctes(
        "SELECT symbol, date, "
        + ", ".join(r6(f"(lead({p}, 20) OVER w - close) / close", target(20, p)) for p in OHLC)
        + f" FROM panel {BY_SYMBOL}"
    ),
    "label_spike": with_ctes(
        "SELECT symbol, date, CAST(CASE WHEN target_t1_high_ret > 0.07 THEN 1 ELSE 0 END AS BIGINT) AS target_spike_class FROM fwd"
    ),
    "label_spike_close": with_ctes(
        "SELECT symbol, date, CAST(CASE WHEN target_t1_close_ret > 0.02 THEN 1 ELSE 0 END AS BIGINT) AS target_spike_class FROM fwd"
    ),
    "triple_barrier": with_ctes(
        f"SELECT symbol, date, {_barrier_sql(0.05, 0.03, 5)} AS target_spike_class FROM panel {BY_SYMBOL}"
    ),
    "triple_barrier_year": with_ctes(
        f"""SELECT t.symbol, t.date, coalesce(any_value(label), any_value(CASE WHEN t.after > t.close THEN 1.0 WHEN t.after IS NOT NULL THEN 0.0 END))::DOUBLE
            AS target_spike_class FROM numbered t LEFT JOIN (
                SELECT t.symbol, t.date, arg_min(CASE WHEN (f.low - t.close) / t.close <= -0.12 THEN 0.0 ELSE 1.0 END, f.rn) AS label
                FROM numbered t JOIN numbered f ON f.symbol = t.symbol AND f.rn > t.rn AND f.rn <= t.rn + {YEAR}
                WHERE (f.low - t.close) / t.close <= -0.12 OR (f.high - t.close) / t.close >= 0.12 GROUP BY t.symbol, t.date
            ) l ON l.symbol = t.symbol AND l.date = t.date GROUP BY t.symbol, t.date""",
        {
            "numbered": f"""SELECT symbol, date, close, low, high, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
                lead(close, {YEAR}) OVER (PARTITION BY symbol ORDER BY date) AS after FROM panel"""
        },
    ),
    "triple_barrier_long": with_ctes(
        f"SELECT symbol, date, {_barrier_sql(0.09, 0.09, 30)} AS target_spike_class FROM panel {BY_SYMBOL}"
    ),
    "event_join": with_ctes(
        f"""SELECT symbol, date, {r6_all('close', 'eps_estimate', 'reported_eps', 'surprise_pct')}
        FROM panel JOIN earn USING (symbol, date) WHERE surprise_pct IS NOT NULL"""
    ),
    "earnings_first": with_ctes(
        f"SELECT symbol, date, {r6('CASE WHEN symbol % 2 = 0 THEN surprise_pct END', 'surprise_pct')} FROM earn"
    ),
    "sue": with_ctes(f"SELECT symbol, date, {r6_all('surprise_pct', 'sue')} FROM esue", {"esue": SUE}),
    "pead_rule": with_ctes(
        """SELECT symbol, date, CAST(CASE WHEN surprise_pct > 0 THEN 1 ELSE 0 END AS BIGINT) AS y_pred,
        CASE WHEN surprise_pct > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_pred_proba FROM feat"""
    ),
    "upcoming_filter": with_ctes(
        f"SELECT symbol, date, {r6('eps_estimate')} FROM earn WHERE reported_eps IS NULL AND eps_estimate IS NOT NULL"
    ),
    "upcoming_earnings": with_ctes(
        f"""SELECT e.symbol, e.date, {r6('e.eps_estimate', 'eps_estimate')}, s.sector
        FROM earn e JOIN snapshot s USING (symbol)
        WHERE e.date > DATE '{AS_OF}' AND reported_eps IS NULL AND eps_estimate IS NOT NULL"""
    ),
    "next_upcoming": with_ctes(
        f"""SELECT e.symbol, min(e.date) AS event_date, {r6('arg_min(e.eps_estimate, e.date)', 'eps_estimate')},
        any_value(s.date) AS snapshot_date, {r6('any_value(s.return_60d)', 'return_60d')}
        FROM earn e JOIN snapshot s USING (symbol)
        WHERE e.date > DATE '{AS_OF}' AND reported_eps IS NULL AND eps_estimate IS NOT NULL GROUP BY e.symbol"""
    ),
    "scenario_grid": with_ctes(
        f"""SELECT e.symbol, e.date AS event_date, CAST(g AS DOUBLE) AS surprise_pct,
        {r6('eps_estimate * (1 + CAST(g AS DOUBLE) / 100)', 'reported_eps')}, {r6('s.sector_rank_60d', 'sector_rank_60d')}
        FROM (SELECT symbol, min(date) AS date, arg_min(eps_estimate, date) AS eps_estimate FROM earn
            WHERE date > DATE '{AS_OF}' AND reported_eps IS NULL AND eps_estimate IS NOT NULL GROUP BY symbol) e
        JOIN snapshot s USING (symbol), range(-100, 101, 5) t(g)"""
    ),
    "latest_snapshot": with_ctes(
        f"""SELECT symbol, max(date) AS date, any_value(sector) AS sector, {r6('arg_max(close, date)', 'close')},
        {r6('arg_max(return_14d, date) FILTER (WHERE day(date) % 2 = 0 AND return_14d IS NOT NULL)', 'return_14d')},
        {r6('arg_max(return_60d, date)', 'return_60d')} FROM mom WHERE return_60d IS NOT NULL GROUP BY symbol"""
    ),
    "latest_event": with_ctes(
        f"""SELECT symbol, max(date) AS date, {r6('arg_max(surprise_pct, date)', 'surprise_pct')},
        {r6('arg_max(return_60d, date)', 'return_60d')} FROM feat GROUP BY symbol"""
    ),
    "dataset_health": with_ctes("SELECT count(*) AS rows, min(date) AS min_date, max(date) AS max_date FROM feat"),
    "ticker_list": with_ctes("SELECT symbol, arg_max(sector, date) AS sector FROM feat GROUP BY symbol"),
    "dropna_filters": with_ctes(
        """SELECT count(*) AS rows, count(surprise_pct) AS with_surprise,
        count(CASE WHEN return_60d IS NOT NULL AND target_t1_high_ret IS NOT NULL THEN 1 END) AS with_return_and_target,
        count(CASE WHEN surprise_pct IS NOT NULL AND return_60d IS NOT NULL AND target_t1_close_ret IS NOT NULL THEN 1 END) AS with_all
        FROM fwd JOIN earn USING (symbol, date)"""
    ),
    "earnings_clean": with_ctes(
        f"""SELECT symbol, CASE WHEN symbol % 2 = 0 THEN date + 1 ELSE date END AS date,
        {r6_all('eps_estimate', 'reported_eps', 'surprise_pct')} FROM earn"""
    ),
    "chrono_split": with_ctes("SELECT symbol, date, split FROM scored"),
    "validation_slice": with_ctes(
        "SELECT symbol, date, date >= DATE '1999-01-01' AS is_validation FROM scored WHERE split = 'train'"
    ),
    "walk_forward_folds": with_ctes("SELECT * FROM folds", {"folds": FOLDS}),
    "fold_assign": with_ctes(
        f"""SELECT symbol, date, fold, test_start FROM (SELECT *, {WINDOW_INDEX} AS i FROM feat WHERE {COMPLETE}) e
        JOIN folds f ON f.test_start = CAST(DATE '2000-01-01' + to_months(CAST(e.i * 6 AS INTEGER)) AS DATE)""",
        {"folds": FOLDS},
    ),
    "class_weight": with_ctes(
        f"""SELECT split, count(CASE WHEN target_spike_class = 1 THEN 1 END) AS positives,
        count(CASE WHEN target_spike_class = 0 THEN 1 END) AS negatives,
        {r6('count(CASE WHEN target_spike_class = 0 THEN 1 END)::DOUBLE / count(CASE WHEN target_spike_class = 1 THEN 1 END)', 'scale_pos_weight')}
        FROM scored GROUP BY split"""
    ),
    "spike_rate": with_ctes(
        f"""SELECT threshold, count(*) AS rows, count(CASE WHEN target_t1_high_ret > threshold THEN 1 END) AS positives,
        {r6('count(CASE WHEN target_t1_high_ret > threshold THEN 1 END)::DOUBLE / count(*)', 'positive_rate')}
        FROM feat, (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.07::DOUBLE), (0.10::DOUBLE)) t(threshold) GROUP BY threshold"""
    ),
    "complete_features": with_ctes(
        f"SELECT symbol, date, {r6_all('sue', *FEATURES)} FROM esue WHERE {KEPT} AND {COMPLETE} AND sue IS NOT NULL",
        {"esue": EVENT_SUE},
    ),
}

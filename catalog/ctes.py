"""Common table expressions of the check SQL, by name, with what each one needs."""

from __future__ import annotations

import re

PRICE_ORDER = "l_orderkey, l_linenumber, l_partkey, price"
KPI_COLUMNS = ("total_return", "win_rate", "max_drawdown", "sharpe")


def _r(expression: str, scale: str = "1e6") -> str:
    return f"floor(({expression}) * {scale} + 0.5) / {scale}"


CTES: dict[str, str] = {
    "px": f"""SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
        {_r(f"first(price ORDER BY {PRICE_ORDER})")} AS open,
        {_r("max(100 * (1 + l_tax))")} AS high,
        {_r("min(100 * (1 - l_discount))")} AS low,
        {_r(f"last(price ORDER BY {PRICE_ORDER})")} AS close,
        sum(l_quantity) AS volume
        FROM (SELECT *, 100 * (1 + l_tax - l_discount) AS price FROM lineitem) GROUP BY 1, 2""",
    "meta": """SELECT s_suppkey AS symbol, r_name AS sector, n_name AS industry, s_name AS name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "panel": "SELECT px.*, sector FROM px JOIN meta USING (symbol)",
    "quarters": f"""SELECT l_suppkey AS symbol, year(l_shipdate) * 4 + quarter(l_shipdate) AS quarter,
        {_r("CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS DOUBLE) / count(*) / 1e8")} AS eps, CAST(min(l_shipdate) AS DATE) AS date
        FROM lineitem GROUP BY 1, 2""",
    "earn": """SELECT symbol, date, eps_estimate, reported_eps,
        100 * ((reported_eps - eps_estimate) / abs(eps_estimate)) AS surprise_pct FROM (
            SELECT symbol, date, lag(eps, 2) OVER w AS eps_estimate,
                CASE WHEN lead(quarter) OVER w IS NOT NULL THEN lag(eps, 1) OVER w END AS reported_eps
            FROM quarters WINDOW w AS (PARTITION BY symbol ORDER BY quarter))""",
    "mom": """SELECT *, close / lag(close, 14) OVER w - 1 AS return_14d, close / lag(close, 60) OVER w - 1 AS return_60d
        FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "ranked": """SELECT * EXCLUDE (v), CASE WHEN v IS NOT NULL THEN
            (rank() OVER (PARTITION BY date, sector ORDER BY v NULLS LAST)
             + (count(*) OVER (PARTITION BY date, sector, v) - 1) / 2.0)
            / count(v) OVER (PARTITION BY date, sector) END AS sector_rank_60d
        FROM (SELECT *, floor(return_60d * 1e9 + 0.5) / 1e9 AS v FROM mom)""",
    "fwd": """SELECT *, (lead(open) OVER w - close) / close AS target_t1_open_ret,
            (lead(high) OVER w - close) / close AS target_t1_high_ret,
            (lead(low) OVER w - close) / close AS target_t1_low_ret,
            (lead(close) OVER w - close) / close AS target_t1_close_ret
        FROM ranked WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "feat": """SELECT date, symbol, sector, close, volume, eps_estimate, reported_eps, surprise_pct, return_14d,
            return_60d, sector_rank_60d, target_t1_open_ret, target_t1_high_ret, target_t1_low_ret,
            target_t1_close_ret, CASE WHEN target_t1_high_ret > 0.07 THEN 1 ELSE 0 END AS target_spike_class
        FROM fwd JOIN earn USING (symbol, date)
        WHERE surprise_pct IS NOT NULL AND return_60d IS NOT NULL AND target_t1_high_ret IS NOT NULL""",
    "scored": """SELECT *, CASE WHEN y_pred_proba > 0.5 THEN 1 ELSE 0 END AS y_pred, 'rule' AS run_id,
            CASE WHEN date < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS split
        FROM (SELECT *, 1 / (1 + exp(-(((-0.5 + surprise_pct * 0.05) + return_60d * 5.0) + sector_rank_60d)))
            AS y_pred_proba FROM feat WHERE eps_estimate IS NOT NULL AND reported_eps IS NOT NULL)""",
    "test": "SELECT * FROM scored WHERE split = 'test'",
    "sig": "SELECT * FROM test WHERE y_pred_proba > 0.5 AND target_t1_close_ret IS NOT NULL",
    "snapshot": """SELECT symbol, max(date) AS date, arg_max(sector, date) AS sector, arg_max(close, date) AS close,
            arg_max(return_14d, date) AS return_14d, arg_max(return_60d, date) AS return_60d,
            arg_max(sector_rank_60d, date) AS sector_rank_60d
        FROM ranked WHERE return_60d IS NOT NULL GROUP BY symbol""",
    "spans": """SELECT l_suppkey AS symbol, CAST(min(l_shipdate) AS DATE) AS first_day,
            CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem GROUP BY 1""",
    "changes": """SELECT row_number() OVER (ORDER BY date DESC, symbol, op) AS seq, date, symbol, op FROM (
            SELECT first_day AS date, symbol, 'add' AS op FROM spans WHERE symbol % 3 = 0
            UNION ALL SELECT last_day, symbol, 'remove' FROM spans WHERE symbol % 4 = 0
            UNION ALL SELECT DATE '1997-01-01', symbol, 'remove' FROM spans WHERE symbol % 6 = 1
            UNION ALL SELECT DATE '1998-01-01', symbol, 'add' FROM spans WHERE symbol % 6 = 1)""",
    "members": "SELECT symbol FROM spans WHERE symbol % 4 <> 0",
    "life": """SELECT symbol, min(CASE WHEN op = 'add' THEN date END) AS date_added,
            CASE WHEN max(now) = 0 THEN max(CASE WHEN op = 'remove' THEN date END) END AS date_removed,
            max(now) = 1 AS is_current
        FROM (SELECT symbol, date, op, 0 AS now FROM changes
              UNION ALL SELECT symbol, NULL, NULL, 1 FROM members) GROUP BY symbol""",
    "runs": """SELECT CAST(event_id AS VARCHAR) AS run_id, ts AS timestamp, user_id AS experiment,
            props AS config_json, value / 500 AS accuracy, value / 600 AS precision,
            value / 520 AS train_accuracy,
            CASE WHEN event_type <> 'error' THEN value / 550 END AS train_precision,
            CASE WHEN event_type <> 'signup' THEN value / 1000 - 0.05 END AS total_return,
            value / 700 AS win_rate, -value / 800 AS max_drawdown, value / 100 AS sharpe FROM events""",
    "labelled": """SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY timestamp, run_id) AS run_number,
            'Run ' || row_number() OVER (PARTITION BY experiment ORDER BY timestamp, run_id) AS run_label FROM runs""",
    "gaps": "SELECT *, train_precision - precision AS gap FROM labelled",
}


def with_ctes(select: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """The select with every common table expression it mentions, in the order of use.

    ``extra`` adds expressions of this one query, which may use the common ones.
    """
    known = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def add_needs(text: str, own: str = "") -> None:
        for name in known:
            if name != own and name not in ordered and re.search(rf"(?i)\b(FROM|JOIN)\s+{name}\b", text):
                add_needs(known[name], name)
                ordered.append(name)

    add_needs(select)
    if not ordered:
        return select
    parts = ", ".join(f"{name} AS ({known[name]})" for name in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {select}"


def kpi_ctes(
    trades: str, keys: str, ret: str = "target_t1_close_ret", cost: str = "0.001", cap: str | None = "0.2"
) -> dict[str, str]:
    """Expressions ``daily``, ``curve`` and ``kpi`` over a table of trades."""
    weight = "1.0 / count(*)" if cap is None else f"least(1.0 / count(*), {cap})"
    return {
        "daily": f"""SELECT {keys}, date, sum({ret} - {cost}) * {weight} AS daily_return, count(*) AS trades,
            sum(CASE WHEN {ret} > 0 THEN 1 ELSE 0 END) AS wins FROM {trades} GROUP BY {keys}, date""",
        **curve_ctes(keys),
    }


def curve_ctes(keys: str) -> dict[str, str]:
    window = f"(PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return {
        "equity": f"SELECT *, 100000 * product(1 + daily_return) OVER {window} AS equity FROM daily",
        "curve": f"SELECT *, equity / max(equity) OVER {window} - 1 AS drawdown FROM equity",
        "kpi": f"""SELECT {keys}, arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return,
            CAST(sum(wins) AS DOUBLE) / sum(trades) AS win_rate, min(drawdown) AS max_drawdown,
            coalesce(CASE WHEN stddev_samp(daily_return) > 0
                THEN avg(daily_return) / stddev_samp(daily_return) * sqrt(252) END, 0) AS sharpe,
            CAST(sum(trades) AS BIGINT) AS trades FROM curve GROUP BY {keys}""",
    }

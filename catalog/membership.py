"""Queries on index membership and metadata."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from eventlab.operators import membership as MB
from eventlab.plans import backtests as B
from eventlab.sources import market as K
from eventlab.sources import prices as PR
from eventlab.sources import tables as TB
from eventlab.storage import stored

from .ctes import kpi_ctes, with_ctes
from .shape import r6_all, tidy

DATES = [dt.date(1996, 6, 30), dt.date(1997, 6, 30), dt.date(1999, 12, 31), dt.date(2001, 10, 1)]


def membership_asof(spark, sf):
    current, changes = K.membership(spark, sf)
    return MB.membership_asof(current, changes, DATES)


def membership_on_event_days(spark, sf):
    """Members on every day that has an announcement."""
    days = K.earnings(spark, sf).select(F.col("date").alias("as_of"))
    return MB.membership_asof(*K.membership(spark, sf), days)


def membership_intervals(spark, sf):
    return MB.membership_intervals(*K.membership(spark, sf))


def universe_point_in_time(spark, sf):
    """Feature rows of symbols that were members on the day of the announcement."""
    rows = MB.universe_point_in_time(K.features(spark, sf), *K.membership(spark, sf))
    return tidy(rows.select("symbol", "date", "target_spike_class"))


def ticker_lifespans(spark, sf):
    return MB.ticker_lifespans(*K.membership(spark, sf))


def master_list(spark, sf):
    return MB.master_list(MB.ticker_lifespans(*K.membership(spark, sf)))


def ticker_universe(spark, sf):
    return MB.ticker_universe(*K.membership(spark, sf))


def membership_changes(spark, sf):
    return K.membership(spark, sf)[1]


def universe_current(spark, sf):
    life = MB.ticker_lifespans(*K.membership(spark, sf))
    return tidy(MB.universe_current(K.features(spark, sf), life).select("symbol", "date", "target_spike_class"))


def universe_all(spark, sf):
    """Both universes, told apart."""
    rows = K.features(spark, sf).select("symbol", "date")
    life = MB.ticker_lifespans(*K.membership(spark, sf)).select("symbol", "is_current")
    return rows.join(life, "symbol", "left").withColumn("is_current", F.coalesce("is_current", F.lit(False)))


def survivorship_delta(spark, sf):
    life = MB.ticker_lifespans(*K.membership(spark, sf))
    return tidy(MB.survivorship_delta(K.features(spark, sf), life).select("symbol", "date", "target_spike_class"))


def survivorship_compare(spark, sf):
    life = MB.ticker_lifespans(*K.membership(spark, sf))
    return tidy(B.survivorship_compare(stored(K.predictions(spark, sf)), life))


def _classified(spark, sf):
    life = MB.ticker_lifespans(*K.membership(spark, sf))
    tickers = K.metadata(spark, sf).select("symbol").join(life, "symbol", "left")
    return MB.metadata_build(tickers, K.primary_metadata(spark, sf), K.fallback_metadata(spark, sf))


def metadata_build(spark, sf):
    return MB.valid_metadata(_classified(spark, sf))


def metadata_rejected(spark, sf):
    return MB.rejected_metadata(_classified(spark, sf))


def metadata_partition(spark, sf):
    """Both outputs of one classification put together again."""
    rows = _classified(spark, sf)
    valid = MB.valid_metadata(rows).select("symbol", F.lit("valid").alias("route"))
    return valid.unionByName(MB.rejected_metadata(rows).select("symbol", F.lit("rejected").alias("route")))


def classify_metadata(spark, sf):
    """Sectors and names are blanked for some symbols before classification."""
    none = F.lit(None).cast("date")
    rows = K.metadata(spark, sf).select(
        "symbol",
        F.when(F.col("symbol") % 7 != 0, F.col("sector")).otherwise("  ").alias("sector"),
        "industry",
        F.when(F.col("symbol") % 3 != 0, F.col("name")).alias("name"),
        none.alias("date_added"),
        none.alias("date_removed"),
    )
    return MB.classify_metadata(rows).select("symbol", "official_name", "sector", "industry", "is_valid")


def normalise_ticker(spark, sf):
    """Class shares written with a dot; every ninth name is blank."""
    raw = F.when(F.col("symbol") % 9 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" brk."), F.col("symbol").cast("string")))
    rows = K.metadata(spark, sf).select("symbol", raw.alias("ticker"))
    return TB.normalise_ticker(rows, "ticker").select("symbol", F.upper("ticker").alias("ticker"))


def incremental_ingest(spark, sf):
    """Symbols that have no bar in the first week and still have to be loaded."""
    bars = K.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date")
    )
    return PR.missing_symbols(K.metadata(spark, sf), bars.where(F.col("date") < F.lit(dt.date(1995, 1, 8))))


def ingest_progress(spark, sf):
    bars = K.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date")
    )
    return PR.ingest_progress(K.metadata(spark, sf), bars.where(F.col("date") < F.lit(dt.date(1995, 1, 8))))


QUERIES = {
    f.__name__: f
    for f in (
        membership_asof, membership_on_event_days, membership_intervals, universe_point_in_time, ticker_lifespans, master_list, ticker_universe, membership_changes, universe_current,
        universe_all, survivorship_delta, survivorship_compare, metadata_build, metadata_rejected,
        metadata_partition, classify_metadata, normalise_ticker, incremental_ingest, ingest_progress,
    )
}

AS_OF_ROWS = ", ".join(f"(DATE '{d}')" for d in DATES)
CLASSIFIED = """SELECT m.symbol, l.date_added, l.date_removed,
    CASE WHEN m.symbol % 5 <> 0 OR m.symbol % 10 <> 0 THEN sector END AS sector,
    CASE WHEN m.symbol % 5 <> 0 OR m.symbol % 10 <> 0 THEN industry END AS industry,
    CASE WHEN m.symbol % 5 <> 0 OR m.symbol % 10 <> 0 THEN name END AS name
    FROM meta m LEFT JOIN life l USING (symbol)"""
UNIVERSES = """SELECT *, 'all_incl_delisted' AS universe FROM test
    UNION ALL SELECT *, 'current_only' AS universe FROM test WHERE symbol IN (SELECT symbol FROM life WHERE is_current)"""

#: The state of (symbol, as_of) pairs by undoing later changes, for any table ``asked`` of such pairs.
REWOUND = """SELECT as_of, symbol FROM (
    SELECT a.as_of, a.symbol, -1 AS seq, 0 AS step, a.symbol IN (SELECT symbol FROM members) AS member FROM asked a
    UNION ALL
    SELECT a.as_of, a.symbol, seq, CASE op WHEN 'add' THEN 0 ELSE 1 END, op = 'remove'
    FROM asked a JOIN changes c ON c.symbol = a.symbol AND c.date > a.as_of)
    QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY seq DESC, step DESC) = 1 AND member"""
EVERYONE = "(SELECT symbol FROM members UNION SELECT symbol FROM changes)"

SQL = {
    "membership_on_event_days": with_ctes(
        REWOUND, {"asked": f"SELECT DISTINCT e.date AS as_of, m.symbol FROM earn e CROSS JOIN {EVERYONE} m"}
    ),
    "membership_intervals": with_ctes(
        """SELECT symbol, nullif(min(day), DATE '1900-01-01') AS valid_from, CASE WHEN bool_or(next IS NULL) THEN NULL ELSE max(next) END AS valid_to
        FROM (SELECT *, sum(starts) OVER (PARTITION BY symbol ORDER BY day) AS run
            FROM (SELECT *, CASE WHEN lag(next) OVER (PARTITION BY symbol ORDER BY day) = day THEN 0 ELSE 1 END AS starts
                FROM (SELECT p.symbol, p.day, p.next FROM pieces p JOIN rewound r ON r.symbol = p.symbol AND r.as_of = p.day)))
        GROUP BY symbol, run""",
        {
            "edges": f"""SELECT symbol, date AS day FROM changes UNION SELECT symbol, DATE '1900-01-01' FROM {EVERYONE}""",
            "pieces": "SELECT symbol, day, lead(day) OVER (PARTITION BY symbol ORDER BY day) AS next FROM edges",
            "asked": "SELECT symbol, day AS as_of FROM edges",
            "rewound": REWOUND,
        },
    ),
    "universe_point_in_time": with_ctes(
        """SELECT symbol, date, CAST(target_spike_class AS BIGINT) AS target_spike_class FROM feat
        WHERE (symbol, date) IN (SELECT (symbol, as_of) FROM rewound)""",
        {"asked": "SELECT DISTINCT symbol, date AS as_of FROM feat", "rewound": REWOUND},
    ),
    "membership_asof": with_ctes(
        f"""SELECT as_of, symbol FROM (
            SELECT as_of, symbol, -1 AS seq, 0 AS step, true AS member FROM members, (VALUES {AS_OF_ROWS}) a(as_of)
            UNION ALL
            SELECT as_of, symbol, seq, CASE op WHEN 'add' THEN 0 ELSE 1 END, op = 'remove'
            FROM changes, (VALUES {AS_OF_ROWS}) a(as_of) WHERE date > as_of)
        QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY seq DESC, step DESC) = 1 AND member"""
    ).replace("FROM members, (VALUES", "FROM members CROSS JOIN (VALUES"),
    "ticker_lifespans": with_ctes("SELECT * FROM life"),
    "master_list": with_ctes(
        """SELECT symbol, date_added, CASE WHEN is_current THEN 'present' ELSE CAST(date_removed AS VARCHAR) END AS date_removed
        FROM life"""
    ),
    "ticker_universe": with_ctes("SELECT symbol FROM members UNION SELECT symbol FROM changes"),
    "membership_changes": with_ctes(
        """SELECT seq, date, CASE WHEN op = 'add' THEN symbol END AS added_ticker,
        CASE WHEN op = 'remove' THEN symbol END AS removed_ticker FROM changes"""
    ),
    "universe_current": with_ctes(
        """SELECT symbol, date, CAST(target_spike_class AS BIGINT) AS target_spike_class FROM feat
        WHERE symbol IN (SELECT symbol FROM life WHERE is_current)"""
    ),
    "universe_all": with_ctes(
        "SELECT symbol, date, symbol IN (SELECT symbol FROM life WHERE is_current) AS is_current FROM feat"
    ),
    "survivorship_delta": with_ctes(
        """SELECT symbol, date, CAST(target_spike_class AS BIGINT) AS target_spike_class FROM feat
        WHERE symbol NOT IN (SELECT symbol FROM life WHERE is_current)"""
    ),
    "survivorship_compare": with_ctes(
        f"""SELECT universe, {r6_all('accuracy', 'precision', 'total_return', 'win_rate', 'max_drawdown', 'sharpe')}, rows, trades
        FROM kpi JOIN (SELECT universe, avg(CASE WHEN y_pred = target_spike_class THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
            count(CASE WHEN y_pred = 1 AND target_spike_class = 1 THEN 1 END)::DOUBLE / count(CASE WHEN y_pred = 1 THEN 1 END) AS precision,
            count(*) AS rows FROM both_u GROUP BY universe) USING (universe)""",
        {"both_u": UNIVERSES, "usig": "SELECT * FROM both_u WHERE y_pred_proba > 0.5", **kpi_ctes("usig", "universe")},
    ),
    "metadata_build": with_ctes(
        "SELECT symbol, name AS official_name, sector, industry, date_added, date_removed FROM classed WHERE sector IS NOT NULL",
        {"classed": CLASSIFIED},
    ),
    "metadata_rejected": with_ctes(
        """SELECT symbol, 'Unknown / Missing Sector' AS official_name, date_added, date_removed
        FROM classed WHERE sector IS NULL""",
        {"classed": CLASSIFIED},
    ),
    "metadata_partition": with_ctes(
        "SELECT symbol, CASE WHEN sector IS NULL THEN 'rejected' ELSE 'valid' END AS route FROM classed",
        {"classed": CLASSIFIED},
    ),
    "classify_metadata": with_ctes(
        """SELECT symbol, CASE WHEN symbol % 3 <> 0 THEN name WHEN symbol % 7 <> 0 THEN CAST(symbol AS VARCHAR)
            ELSE 'Unknown / Missing Sector' END AS official_name,
        CASE WHEN symbol % 7 <> 0 THEN sector END AS sector, CASE WHEN symbol % 7 <> 0 THEN industry END AS industry,
        symbol % 7 <> 0 AS is_valid FROM meta"""
    ),
    "normalise_ticker": "SELECT s_suppkey AS symbol, 'BRK-' || s_suppkey AS ticker FROM supplier WHERE s_suppkey % 9 <> 0",
    "incremental_ingest": """SELECT s_suppkey AS symbol FROM supplier
        WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate < DATE '1995-01-08')""",
    "ingest_progress": """SELECT count(*) AS wanted, count(CASE WHEN s_suppkey IN
        (SELECT l_suppkey FROM lineitem WHERE l_shipdate < DATE '1995-01-08') THEN 1 END) AS loaded FROM supplier""",
}

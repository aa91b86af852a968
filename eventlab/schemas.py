"""Column names and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE_COLUMNS = ["open", "high", "low", "close", "volume"]
FEATURES = ["eps_estimate", "reported_eps", "surprise_pct", "return_60d", "sector_rank_60d"]
SUE_FEATURES = ["eps_estimate", "reported_eps", "sue", "return_60d", "sector_rank_60d"]
LABEL = "target_spike_class"
RETURN = "target_t1_close_ret"
KPIS = ["total_return", "win_rate", "max_drawdown", "sharpe"]
LOG_METRICS = ["accuracy", "precision", *KPIS]


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


RAW_PRICES = T.StructType(
    [T.StructField("date", T.DateType())]
    + _doubles("open", "high", "low", "close", "adjusted_close", "volume")
)

RAW_PRICES_JSON = T.StructType(RAW_PRICES.fields + [T.StructField("warning", T.StringType())])

RAW_EARNINGS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("earnings_date", T.StringType()),
        *_doubles("eps_estimate", "reported_eps", "surprise_pct"),
    ]
)

METADATA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("symbol", "official_name", "sector", "industry")]
    + [T.StructField("date_added", T.DateType()), T.StructField("date_removed", T.DateType())]
)

MEMBERSHIP_CHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("added_ticker", T.StringType()),
        T.StructField("removed_ticker", T.StringType()),
    ]
)

TRAINING_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("config_json", T.StringType()),
        *_doubles("accuracy", "precision", "train_accuracy", "train_precision"),
    ]
)

BACKTEST_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("logged_at", T.TimestampType()),
        *_doubles(*KPIS),
    ]
)


def target(horizon: int, price: str) -> str:
    """Name of the forward return column, e.g. ``target_t1_close_ret``."""
    return f"target_t{horizon}_{price}_ret"

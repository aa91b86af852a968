"""Event labels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import change
from ..schemas import LABEL, target
from .panel import by_symbol


def label_spike(
    df: DataFrame, threshold: float = 0.02, horizon: int = 1, price: str = "high", out: str = LABEL
) -> DataFrame:
    """1 where the forward return exceeds the threshold, else 0 (also for a missing return)."""
    hit = F.col(target(horizon, price)) > threshold
    return df.withColumn(out, F.coalesce(hit, F.lit(False)).cast("int"))


#: Up to so many days the bars ahead travel with each row; beyond, a symbol's bars are searched by halves.
BARS_WITH_A_ROW = 32


def triple_barrier(
    panel: DataFrame, take_profit: float = 0.05, stop_loss: float = 0.03, days: int = 5, out: str = LABEL
) -> DataFrame:
    """Label by the first barrier reached within ``days`` rows.

    1.0 for the profit target on the high, 0.0 for the stop on the low (which wins on a
    day that reaches both), else the sign of the last day's close. NULL when no barrier
    is reached and that day does not exist. Long horizons go through `barrier_search`, whose
    work grows with the logarithm of the days.
    """
    if days > BARS_WITH_A_ROW:
        kept = panel.select(*[c for c in panel.columns if c.lower() != out.lower()])
        schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])
        return kept.groupBy("symbol").applyInArrow(barrier_search(take_profit, stop_loss, days, out), schema)
    close = F.col("close")
    end = change(F.lead("close", days).over(by_symbol()), close)
    at_end = (end > 0).cast("double")
    return panel.withColumn(out, F.coalesce(_first_touch(close, take_profit, stop_loss, days), at_end))


def running_extremes(values: np.ndarray, days: int, best: np.ufunc) -> list[np.ndarray]:
    """The best value of the next 1, 2, 4 ... rows of each row, as far as ``days`` reach."""
    nothing = np.inf if best is np.minimum else -np.inf
    tables = [np.r_[values[1:], nothing]]
    while 2 ** len(tables) <= days:
        half = 2 ** (len(tables) - 1)
        last = tables[-1]
        tables.append(best(last, np.r_[last[half:], np.full(min(half, len(last)), nothing)][: len(last)]))
    return tables


def barrier_search(take_profit: float, stop_loss: float, days: int, out: str) -> Callable[[pa.Table], pa.Table]:
    """The labels of `triple_barrier` for a symbol's bars.

    From tables of running lows and highs, each row steps over the largest untouched stretch, then half
    of it, and so on: what it stops at is the first touch. A symbol has one bar a day, so its bars are bounded by
    the calendar.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        close, low, high = (table.column(c).cast(pa.float64()).to_numpy().astype(np.float64) for c in ("close", "low", "high"))
        n = len(close)
        # A missing price touches nothing.
        lows, highs = np.where(np.isnan(low), np.inf, low), np.where(np.isnan(high), -np.inf, high)
        least, most = running_extremes(lows, days, np.minimum), running_extremes(highs, days, np.maximum)
        usable = close > 0
        base = np.where(usable, close, 1.0)

        def stopped(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return (x - base[rows]) / base[rows] <= -stop_loss

        def taken(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return (x - base[rows]) / base[rows] >= take_profit

        rows, step = np.arange(n), np.zeros(n, np.int64)
        for k in range(len(least) - 1, -1, -1):
            at = np.minimum(rows + step, n - 1)
            free = (step + 2**k <= days) & ~stopped(least[k][at], rows) & ~taken(most[k][at], rows)
            step = np.where(free, step + 2**k, step)
        there = rows + step + 1
        touched = usable & (step < days) & (there < n)
        there = np.minimum(there, n - 1)
        answer = np.where(stopped(lows[there], rows), 0.0, 1.0)
        for i in np.flatnonzero(~usable & (close < 0)):  # a negative price turns the order round: bar by bar
            ahead = slice(i + 1, i + 1 + days)
            down, up = (low[ahead] - close[i]) / close[i] <= -stop_loss, (high[ahead] - close[i]) / close[i] >= take_profit
            hit = np.flatnonzero(down | up)
            touched[i] = len(hit) > 0
            answer[i] = 0.0 if len(hit) and down[hit[0]] else 1.0
        end = np.r_[close[days:], np.full(min(days, n), np.nan)]
        known = ~np.isnan(end) & ~np.isnan(close) & (close != 0)
        up = (end - close) / np.where(known, close, 1.0) > 0
        return table.append_column(out, pa.array(np.where(touched, answer, up), pa.float64(), mask=~(touched | known)))

    return run


def _first_touch(close: Column, take_profit: float, stop_loss: float, days: int) -> Column:
    ahead = F.collect_list(F.struct("low", "high")).over(by_symbol().rowsBetween(1, days))
    touches = F.transform(
        ahead,
        lambda bar: F.when(change(bar["low"], close) <= -stop_loss, 0.0).when(
            change(bar["high"], close) >= take_profit, 1.0
        ),
    )
    return F.try_element_at(F.filter(touches, lambda t: t.isNotNull()), F.lit(1))

"""From trades to daily returns, equity, drawdown and KPIs.

Trades carry ``date``, ``symbol``, a return column and one or more run keys. Every
operator treats the keys as partitions, so a sweep over parameters is one job in which
the parameter is a further key. Trades are summed per (keys, date) before any window,
so windows see at most one row per day and run.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import add_business_days
from ..schemas import KPIS, RETURN, target

RUN = ("run_id",)
CAPITAL = 100_000.0
COST = 0.001
TRADING_DAYS = 252


def filter_signals(predictions: DataFrame, threshold: float = 0.5, score: str = "y_pred_proba") -> DataFrame:
    return predictions.where(F.col(score) > threshold)


def limit_order_returns(
    trades: DataFrame,
    threshold: float | Column,
    high: str = target(1, "high"),
    close: str = RETURN,
    out: str = "realized_return",
) -> DataFrame:
    """Exit at a limit order if the high reaches it, else at the close."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return trades.withColumn(out, F.when(F.col(high) >= limit, limit).otherwise(F.col(close)))


def with_parameter(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """One copy of the rows per parameter value."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def daily_returns(
    trades: DataFrame,
    keys: Sequence[str] = RUN,
    ret: str = RETURN,
    cost: float | Column = COST,
    cap: float | Column | None = None,
) -> DataFrame:
    """Portfolio return per run and day, net of cost.

    Equal weights, at most ``cap`` per trade; the uninvested rest earns nothing. ``cap``
    and ``cost`` may be key columns. Keeps the trade and win counts for the win rate.
    """
    cost = cost if isinstance(cost, Column) else F.lit(float(cost))
    weight = 1 / F.col("trades")
    if cap is not None:
        weight = F.least(weight, cap if isinstance(cap, Column) else F.lit(float(cap)))
    return (
        trades.groupBy(*keys, "date")
        .agg(
            F.sum(F.col(ret) - cost).alias("_net"),
            F.count(ret).alias("trades"),
            F.count_if(F.col(ret) > 0).alias("wins"),
        )
        .where(F.col("trades") > 0)
        .select(*keys, "date", (F.col("_net") * weight).alias("daily_return"), "trades", "wins")
    )


def equity_curve(daily: DataFrame, keys: Sequence[str] = RUN, capital: float = CAPITAL) -> DataFrame:
    running = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("equity", capital * F.product(1 + F.col("daily_return")).over(running))


def drawdown(equity: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    running = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return equity.withColumn("drawdown", F.try_divide(F.col("equity"), F.max("equity").over(running)) - 1)


def kpis_of(daily: DataFrame, keys: Sequence[str] = RUN, capital: float = CAPITAL) -> DataFrame:
    """Total return, win rate, maximum drawdown and annualised Sharpe ratio per run.

    The total return is measured from the end of the first trading day, as the equity
    curve's first point already contains that day.
    """
    curve = drawdown(equity_curve(daily, keys, capital), keys)
    spread = F.stddev_samp("daily_return")
    sharpe = F.when(spread > 0, F.avg("daily_return") / spread * F.sqrt(F.lit(TRADING_DAYS)))
    return curve.groupBy(*keys).agg(
        (F.try_divide(F.max_by("equity", "date"), F.min_by("equity", "date")) - 1).alias("total_return"),
        (F.sum("wins") / F.sum("trades")).alias("win_rate"),
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"),
        F.sum("trades").alias("trades"),
    )


def backtest_kpis(
    trades: DataFrame,
    keys: Sequence[str] = RUN,
    ret: str = RETURN,
    cost: float | Column = COST,
    cap: float | Column | None = None,
    capital: float = CAPITAL,
) -> DataFrame:
    return kpis_of(daily_returns(trades, keys, ret, cost, cap), keys, capital)


def fill_runs(kpis: DataFrame, runs: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """All runs, with zeros for those without a trade."""
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in KPIS}
    filled["trades"] = F.coalesce(F.col("trades"), F.lit(0).cast("bigint"))
    return runs.join(kpis, list(keys), "left").withColumns(filled)


def payoff_stats(trades: DataFrame, keys: Sequence[str] = RUN, ret: str = RETURN) -> DataFrame:
    """Average win, average loss (a zero return is a loss) and their ratio."""
    r = F.col(ret)
    averages = trades.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("avg_loss"),
    )
    return averages.withColumn("payoff_ratio", F.abs(F.try_divide(F.col("avg_win"), F.col("avg_loss"))))


def best_trades(trades: DataFrame, n: int, keys: Sequence[str] = RUN, ret: str = RETURN) -> DataFrame:
    """``(keys, date, symbol, best)`` of the n best trades per run.

    The limit on the row number is applied in every input partition first, so a large
    run sends few rows to its final task.
    """
    order = W.partitionBy(*keys).orderBy(F.col(ret).desc_nulls_last(), "date", "symbol")
    ranked = trades.withColumn("best", F.row_number().over(order)).where(F.col("best") <= n)
    return ranked.select(*keys, "date", "symbol", "best")


def exclude_top_n(trades: DataFrame, n: int, keys: Sequence[str] = RUN, ret: str = RETURN) -> DataFrame:
    return exclude_top_each(trades, [n], keys, ret).drop("excluded")


def exclude_top_each(
    trades: DataFrame, ns: Sequence[int], keys: Sequence[str] = RUN, ret: str = RETURN
) -> DataFrame:
    """The trades left after each trim, with the trim size in ``excluded``.

    Exactly n trades go, also if a symbol trades twice a day or a key is NULL: the ranks of equal
    keys, dates and symbols are collected (n at most), and each of these rows takes one.
    """
    place = ["_trade", "_turn"]
    same = F.struct(*keys, "date", "symbol")
    turn = F.row_number().over(W.partitionBy("_trade").orderBy(F.col(ret).desc_nulls_last()))
    best = best_trades(trades, max(ns), keys, ret).withColumn("_trade", same)
    best = best.withColumn("_turn", F.row_number().over(W.partitionBy("_trade").orderBy("best")))
    marked = trades.withColumn("_trade", same).withColumn("_turn", turn).join(best.select(*place, "best"), place, "left")
    every = with_parameter(marked, "excluded", list(ns))
    return every.where(F.coalesce(F.col("best") > F.col("excluded"), F.lit(True))).drop("best", *place)


def robustness_table(
    trades: DataFrame,
    ns: Sequence[int] = (5, 10, 20),
    keys: Sequence[str] = RUN,
    ret: str = RETURN,
    cost: float = COST,
    cap: float | None = 0.2,
) -> DataFrame:
    """KPIs after each trim beside the payoff statistics of all trades."""
    trimmed = backtest_kpis(exclude_top_each(trades, ns, keys, ret), [*keys, "excluded"], ret, cost, cap)
    return trimmed.join(payoff_stats(trades, keys, ret), list(keys))


def trade_day_stats(trades: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Trades, trading days, and the median and largest number of trades on a day."""
    per_day = trades.groupBy(*keys, "date").agg(F.count("*").alias("n"))
    return per_day.groupBy(*keys).agg(
        F.sum("n").alias("trades"),
        F.count("*").alias("days"),
        F.median("n").alias("median_per_day"),
        F.max("n").alias("max_per_day"),
    )


def tranche_slots(
    trades: DataFrame, horizon: int, tranches: int | None = None, keys: Sequence[str] = RUN
) -> DataFrame:
    """How many trades capital allows per run and day.

    Capital is cut into tranches that each hold one position for ``horizon`` business
    days; a tranche released on a day may be used again that day. The state runs over
    days, so trades are counted per day first and a run's group has one row per day.
    """
    tranches = tranches or horizon
    keys = list(keys)
    per_day = (
        trades.groupBy(*keys, "date")
        .agg(F.count("*").alias("n"))
        .withColumn("release", add_business_days(F.col("date"), horizon))
    )
    schema = ", ".join(f"`{k}` {per_day.schema[k].dataType.simpleString()}" for k in keys)

    def allocate(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("date")
        held: list[tuple] = []
        used = 0
        taken = []
        for date, wanted, release in zip(days["date"], days["n"], days["release"]):
            while held and held[0][0] <= date:
                used -= held.pop(0)[1]
            take = min(int(wanted), tranches - used)
            if take:
                held.append((release, take))
                used += take
            taken.append(take)
        return days[keys + ["date"]].assign(slots=taken)

    slots = per_day.groupBy(*keys).applyInPandas(allocate, f"{schema}, date date, slots bigint")
    return slots.where(F.col("slots") > 0)


def tranche_trades(
    trades: DataFrame, horizon: int, tranches: int | None = None, keys: Sequence[str] = RUN
) -> DataFrame:
    """The trades a capital-constrained portfolio takes, by symbol within a day."""
    tranches = tranches or horizon
    slots = tranche_slots(trades, horizon, tranches, keys)
    queue = W.partitionBy(*keys, "date").orderBy("symbol")
    first = trades.withColumn("_place", F.row_number().over(queue)).where(F.col("_place") <= tranches)
    taken = first.join(slots, [*keys, "date"]).where(F.col("_place") <= F.col("slots"))
    return taken.drop("_place", "slots")


def tranche_daily_returns(
    accepted: DataFrame,
    horizon: int,
    tranches: int | None = None,
    keys: Sequence[str] = RUN,
    ret: str = RETURN,
    cost: float = COST,
) -> DataFrame:
    """Daily returns with a fixed weight per tranche."""
    weight = 1.0 / (tranches or horizon)
    return accepted.groupBy(*keys, "date").agg(
        (F.sum(F.col(ret) - cost) * weight).alias("daily_return"),
        F.count(ret).alias("trades"),
        F.count_if(F.col(ret) > 0).alias("wins"),
    )


def tranche_kpis(
    trades: DataFrame,
    horizon: int,
    tranches: int | None = None,
    keys: Sequence[str] = RUN,
    ret: str = RETURN,
    cost: float = COST,
    capital: float = CAPITAL,
) -> DataFrame:
    accepted = tranche_trades(trades, horizon, tranches, keys)
    return kpis_of(tranche_daily_returns(accepted, horizon, tranches, keys, ret, cost), keys, capital)

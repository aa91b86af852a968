"""Price panels, earnings, memberships and run logs derived from order data.

The benchmark tables hold orders, not markets. These views read a supplier as a symbol
and a shipment line as a trade, so that every operator has input whose size follows the
tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import number_rows
from ..functions.scalars import to_places
from ..operators.splits import chrono_split
from ..plans.features import event_features, event_features_each

SPLIT_DATE = dt.date(2000, 1, 1)
VALIDATION_DATE = dt.date(1999, 1, 1)
ADJUSTED_SINCE = dt.date(1998, 1, 1)
THRESHOLD = 0.07
SYMBOL_RANGE = 65536
RULE_WEIGHTS = {"surprise_pct": 1 / 20, "return_60d": 5.0, "sector_rank_60d": 1.0}


# Declared, so that opening a table does not read file footers first.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per supplier: first, highest, lowest and last line price, and the quantity."""
    price = 100 * (1 + F.col("l_tax") - F.col("l_discount"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        (100 * (1 + F.col("l_tax"))).alias("high"),
        (100 * (1 - F.col("l_discount"))).alias("low"),
        F.col("l_quantity").alias("quantity"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", price.alias("price")).alias("at"),
    )
    return lines.groupBy("symbol", "date").agg(
        to_places(F.min("at")["price"], 6).alias("open"),
        to_places(F.max("high"), 6).alias("high"),
        to_places(F.min("low"), 6).alias("low"),
        to_places(F.max("at")["price"], 6).alias("close"),
        F.sum("quantity").alias("volume"),
    )


def raw_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Bars as a provider delivers them: prices before 1998 unadjusted for a 2:1 split."""
    factor = F.when(F.col("date") < F.lit(ADJUSTED_SINCE), 2.0).otherwise(1.0)
    bars = prices(spark, sf).withColumn("adjusted_close", F.col("close"))
    return bars.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close")})


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier's region as sector and nation as industry."""
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("symbol"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            F.col("s_name").alias("name"),
        )
    )


def primary_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return metadata(spark, sf).where(F.col("symbol") % 5 != 0)


def fallback_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return metadata(spark, sf).where((F.col("symbol") % 5 == 0) & (F.col("symbol") % 10 != 0))


def earnings(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly events: the estimate and the report are the averages of earlier quarters.

    The last quarter of a symbol is not reported yet. Values are summed as whole hundredths
    of cents, so that the average does not depend on the order of the rows.
    """
    value = F.round(F.col("l_extendedprice") * 100).cast("bigint") * F.round((1 - F.col("l_discount")) * 100).cast("bigint")
    day = F.to_date("l_shipdate")
    quarters = (
        table(spark, sf, "lineitem")
        .select(
            F.col("l_suppkey").alias("symbol"),
            day.alias("date"),
            (F.year(day) * 4 + F.quarter(day)).alias("quarter"),
            value.alias("value"),
        )
        .groupBy("symbol", "quarter")
        .agg(to_places(F.sum("value") / F.count("value") / 1e8, 6).alias("eps"), F.min("date").alias("date"))
    )
    # One row per quarter and symbol.
    in_order = W.partitionBy("symbol").orderBy("quarter")
    known = F.lead("quarter").over(in_order).isNotNull()
    reported, estimate = F.lag("eps", 1).over(in_order), F.lag("eps", 2).over(in_order)
    return (
        quarters.select(
            "symbol",
            "date",
            estimate.alias("eps_estimate"),
            F.when(known, reported).alias("reported_eps"),
        )
        .withColumn(
            "surprise_pct",
            100 * F.try_divide(F.col("reported_eps") - F.col("eps_estimate"), F.abs("eps_estimate")),
        )
    )


def membership(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Current members and the list of changes, newest first."""
    spans = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("symbol"))
        .agg(F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("last"))
    )

    def event(day: Column, op: str, applies: Column) -> Column:
        return F.struct(F.when(applies, day).alias("date"), F.lit(op).alias("op"))

    symbol = F.col("symbol")
    readded = symbol % 6 == 1
    events = spans.select(
        symbol,
        F.inline(
            F.array(
                event(F.col("first"), "add", symbol % 3 == 0),
                event(F.col("last"), "remove", symbol % 4 == 0),
                event(F.lit(dt.date(1997, 1, 1)), "remove", readded),
                event(F.lit(dt.date(1998, 1, 1)), "add", readded),
            )
        ),
    ).where(F.col("date").isNotNull())
    # The place in the list. A bucket is a day and a range of symbols, as many days are busy.
    bucket = F.struct((-F.unix_date("date")).alias("day"), F.floor(symbol / SYMBOL_RANGE).alias("range"))
    listed = number_rows(events, [], bucket, ["symbol", "op"], "seq")
    changes = listed.select(
        "seq",
        "date",
        F.when(F.col("op") == "add", symbol).alias("added_ticker"),
        F.when(F.col("op") == "remove", symbol).alias("removed_ticker"),
    )
    return spans.where(symbol % 4 != 0).select("symbol"), changes


def features(spark: SparkSession, sf: str, **options) -> DataFrame:
    """The event feature table with the 7 % label."""
    options = {"threshold": THRESHOLD, **options}
    return event_features(prices(spark, sf), metadata(spark, sf), earnings(spark, sf), **options)


def features_each(spark: SparkSession, sf: str, labels: Sequence[tuple[int, str]]) -> list[DataFrame]:
    """`features` for several (horizon, label price), built together."""
    return event_features_each(prices(spark, sf), metadata(spark, sf), earnings(spark, sf), labels, threshold=THRESHOLD)


def rule_score(df: DataFrame) -> DataFrame:
    """A fixed score in place of a fitted model, so that results can be checked exactly."""
    linear = sum((F.col(c) * w for c, w in RULE_WEIGHTS.items()), F.lit(-0.5))
    scored = df.withColumn("y_pred_proba", 1 / (1 + F.exp(-linear)))
    return scored.withColumn("y_pred", (F.col("y_pred_proba") > 0.5).cast("int"))


def scored_features(spark: SparkSession, sf: str, **options) -> DataFrame:
    """Complete feature rows with the rule score, split and run id."""
    rows = chrono_split(features(spark, sf, **options), SPLIT_DATE)
    return rule_score(rows).withColumn("run_id", F.lit("rule"))


def predictions(spark: SparkSession, sf: str, **options) -> DataFrame:
    """Scored rows of the test period."""
    return scored_features(spark, sf, **options).where(F.col("split") == "test")


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as experiment runs, one history per user."""
    value = F.col("value")
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("run_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").alias("experiment"),
        F.col("props").alias("config_json"),
        (value / 500).alias("accuracy"),
        (value / 600).alias("precision"),
        (value / 520).alias("train_accuracy"),
        F.when(F.col("event_type") != "error", value / 550).alias("train_precision"),
        F.when(F.col("event_type") != "signup", value / 1000 - 0.05).alias("total_return"),
        (value / 700).alias("win_rate"),
        (-value / 800).alias("max_drawdown"),
        (value / 100).alias("sharpe"),
    )


def constituent_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A constituents page per supplier; every eleventh lost its table.

    Tickers are written with a dot, as on such pages.
    """
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    head = "".join(f"<th>{h}</th>" for h in ("Symbol", "Security", "GICS Sector", "GICS Sub-Industry"))
    rows = metadata(spark, sf)
    ticker = F.concat(F.lit("S."), F.col("symbol").cast("string"))
    table_html = F.concat(
        F.lit(f"<table class='nav'><tr><th>Menu</th></tr></table><table id='c'><tr>{head}</tr><tr>"),
        cell(F.concat(F.lit("<a href='#'>"), ticker, F.lit("</a>"))),
        cell(F.concat(F.col("name"), F.lit(" &amp; Co"))),
        cell(F.col("sector")),
        cell(F.col("industry")),
        F.lit("</tr></table>"),
    )
    body = F.when(F.col("symbol") % 11 == 10, F.lit("<p>under construction</p>")).otherwise(table_html)
    return rows.select(
        F.concat(F.lit("page/"), F.col("symbol").cast("string")).alias("url"),
        F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"),
    )

"""Split ranks, numbers and lags against plain windows, with a hot group and hot ties."""

import random

from conftest import day
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventlab.functions.ordering import number_rows, number_sorted, percent_ranks, percentiles, value_bucket


def skewed(spark, n=3000):
    rng = random.Random(7)
    data = []
    for i in range(n):
        group = "hot" if rng.random() < 0.5 else f"g{rng.randrange(6)}"
        value = 0.0 if rng.random() < 0.35 else round(rng.gauss(0, 0.5) * rng.choice([1, 1, 40]), 3)
        data.append((i, group, None if i % 17 == 0 else value, rng.randrange(500)))
    return spark.createDataFrame(data, "id int, grp string, value double, at int")


def test_percent_ranks_equal_pandas(spark):
    df = skewed(spark)
    ranks = percent_ranks(df, ["grp"], "value", "rank")
    got = df.join(ranks, ["grp", "value"], "left").select("id", "rank").toPandas().set_index("id")["rank"].sort_index()
    pdf = df.toPandas().set_index("id").sort_index()
    expected = pdf.groupby("grp")["value"].rank(pct=True)
    assert (got.fillna(-1) - expected.fillna(-1)).abs().max() < 1e-12


def test_number_rows_equals_a_plain_window(spark):
    df = skewed(spark)
    got = number_rows(df, ["grp"], F.floor(F.col("at") / 50), ["at", "id"], "rn", ["id", "value"])
    order = W.partitionBy("grp").orderBy("at", "id")
    expected = df.withColumn("rn", F.row_number().over(order)).withColumn("prev_id", F.lag("id").over(order))
    flat = got.select("id", "rn", F.col("prev.id").alias("prev_id"))
    assert flat.exceptAll(expected.select("id", "rn", "prev_id")).count() == 0
    assert flat.count() == df.count()


def test_number_rows_without_keys(spark):
    df = spark.range(100).withColumn("b", F.floor(F.col("id") / 7))
    got = number_rows(df, [], F.col("b"), ["id"], "rn")
    assert got.where(F.col("rn") != F.col("id") + 1).count() == 0


def test_empty_buckets_carry_the_row_before(spark):
    df = spark.createDataFrame([("a", 1), ("a", 900), ("a", 901), ("b", 5)], "grp string, at int")
    got = number_rows(df, ["grp"], F.floor(F.col("at") / 10), ["at"], "rn", ["at"])
    found = {(r["grp"], r["at"]): r["prev"]["at"] if r["prev"] else None for r in got.collect()}
    assert found == {("a", 1): None, ("a", 900): 1, ("a", 901): 900, ("b", 5): None}


def test_value_buckets_keep_the_order(spark):
    values = sorted([-1e6, -50.0, -10.0, -9.99, -0.011, -0.01, 0.0, 0.004, 0.011, 9.999, 10.0, 10.5, 1e3, 1e9])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r["b"] for r in df.select(value_bucket(F.col("v")).alias("b"), "v").orderBy("v").collect()]
    assert buckets == sorted(buckets)


def test_ranks_survive_one_value_holding_a_third_of_the_rows(spark):
    hot = spark.range(20_000).select(
        F.lit(day("2024-01-01")).alias("date"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") / 1e5).alias("value"),
    )
    top = percent_ranks(hot, ["date"], "value", "rank").orderBy(F.desc("rank")).first()["rank"]
    tied = percent_ranks(hot, ["date"], "value", "rank").where("value = 0").first()["rank"]
    assert top == 1.0
    assert tied == (6667 + 1) / 2 / 20_000


def test_percentiles_equal_numpy(spark):
    import numpy as np

    df = skewed(spark)
    shares = (0.0, 0.025, 0.25, 0.5, 0.975, 1.0)
    got = {r["grp"]: r["p"] for r in percentiles(df, ["grp"], "value", shares).collect()}
    for group, part in df.toPandas().groupby("grp"):
        expected = np.percentile(part["value"].dropna(), [100 * s for s in shares])
        assert np.allclose(got[group], expected)


def test_number_sorted_equals_a_plain_window(spark):
    df = skewed(spark).withColumn("grp", F.when(F.col("grp") != "g1", F.col("grp")))
    got = number_sorted(df, ["grp"], ["at", "id"], "rn", ["id"])
    order = W.partitionBy("grp").orderBy("at", "id")
    expected = df.withColumn("rn", F.row_number().over(order)).withColumn("prev_id", F.lag("id").over(order))
    flat = got.select("id", "rn", F.col("prev.id").alias("prev_id"))
    assert flat.exceptAll(expected.select("id", "rn", "prev_id")).count() == 0
    assert flat.count() == df.count()


def test_a_sort_spreads_one_hot_group(spark):
    from eventlab.functions.ordering import sort_rows

    hot = spark.range(20_000).select(F.lit("one").alias("grp"), F.col("id").alias("at"), F.lit(0).alias("same"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # would join parts this small again
    spark.conf.set(coalesce, "false")
    try:
        sizes = [r["count"] for r in sort_rows(hot, ["grp", "same"], ["at"]).groupBy("_part").count().collect()]
    finally:
        spark.conf.set(coalesce, "true")
    assert len(sizes) > 1 and max(sizes) < 15_000

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import day
from pyspark.sql import functions as F

from eventlab.functions import scalars as S


def test_business_days_equal_pandas(spark):
    days = [day("2024-01-01") + dt.timedelta(i) for i in range(21)]
    cases = [(d, h) for d in days for h in (1, 2, 5, 7, 20)]
    df = spark.createDataFrame(cases, "d date, h int")
    got = df.select("d", "h", S.add_business_days(F.col("d"), F.col("h")).alias("r")).collect()
    for r in got:
        assert r["r"] == (pd.Timestamp(r["d"]) + pd.tseries.offsets.BDay(r["h"])).date()


def test_bins_equal_numpy(spark):
    probabilities = [0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.55, 0.7, 0.9, 0.999, 1.0]
    edges = np.linspace(0, 1, 11)
    df = spark.createDataFrame([(p,) for p in probabilities], "p double")
    got = [r["b"] for r in df.select(S.probability_bin(F.col("p"), 10).alias("b")).collect()]
    assert got == list(np.digitize(probabilities, edges[1:-1]))
    assert S.bin_edges(10) == list(edges)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, i int")
    assert [r["x"] for r in S.nan_to_null(df).orderBy("i").collect()] == [None, 2.0]


@pytest.mark.parametrize("raw, clean", [("OLD.K", "OLD-K"), (" vole", "vole"), ("", None), ("  ", None), (None, None)])
def test_clean_ticker(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(S.clean_ticker(F.col("t")).alias("t")).first()["t"] == clean


def test_rounding_half_up_without_negative_zero(spark):
    df = spark.createDataFrame([(1.25,), (-1.25,), (-0.01,)], "x double")
    got = [r["y"] for r in df.select(S.to_places(F.col("x"), 1).alias("y")).collect()]
    assert got == [1.3, -1.2, 0.0]
    assert str(got[2]) == "0.0"


def test_run_ids_are_sortable(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),)], "t timestamp")
    value = df.select(S.run_id(F.col("t")).alias("r")).first()["r"]
    assert value.startswith("20240102_030405_") and len(value) == 22


def test_hash_is_large_and_stable(spark):
    a, b = spark.range(2).select(S.hash_int(F.lit(42), F.col("id")).alias("h")).collect()
    again = spark.range(2).repartition(2).select("id", S.hash_int(F.lit(42), F.col("id")).alias("h")).orderBy("id").collect()
    assert [a["h"], b["h"]] == [r["h"] for r in again]
    assert 0 <= a["h"] < 2**60

"""Intermediate tables in the shared folder, and joins that a hot key cannot stop."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

__all__ = ["free_name", "join_groups", "small_batches", "stored", "text_key"]

#: A key is hot if it holds more than this share of all rows; so there are fewer than 1000 of them.
HOT_SHARE = 1000


#: Bytes of rows that Spark hands to Python at once.
BATCH_BYTES = 16 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The rows, for an operator that hands whole texts to Python.

    Bounds the session's Arrow batches, which Spark, the worker and its results each hold: a task's
    memory then does not grow with the length of the texts. A smaller bound of the session stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    have = re.fullmatch("([0-9]+)b?", conf.get(key))
    if not have or not 0 < int(have[1]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: Column) -> DataFrame:
    """Left join of rows with one row per group, null keys included, where a group may hold most rows.

    ``count`` is the group's number of rows and ``total`` that of all rows, both columns of
    ``groups``. Groups above a share of 1 / `HOT_SHARE` are fewer than `HOT_SHARE`, a size that
    may be broadcast whatever the input. The others are joined by a shuffle, in which hot rows
    take any partition.
    """
    names = [c for c in groups.columns if c != key]
    packed = groups.select(F.col(key).alias("_key"), F.struct(*names).alias("_group"), (F.col(count) * HOT_SHARE > total).alias("_hot"))
    hot = F.broadcast(packed.where("_hot").select(F.col("_key").alias("_hot_key"), F.col("_group").alias("_hot_group")))
    with_hot = rows.join(hot, F.col(key).eqNullSafe(F.col("_hot_key")), "left")
    # A hot row's text key has no partner; it only spreads the rows.
    spread = F.concat(F.lit("h"), F.monotonically_increasing_id().cast("string"))
    plain = F.when(F.col("_hot_group").isNotNull(), spread).otherwise(text_key(F.col(key)))
    rest = packed.where("NOT _hot").select(text_key(F.col("_key")).alias("_rest_key"), F.col("_group").alias("_rest_group"))
    joined = with_hot.withColumn("_plain", plain).join(rest, F.col("_plain") == F.col("_rest_key"), "left")
    group = F.coalesce("_hot_group", "_rest_group")
    return joined.select(*rows.columns, *[group[n].alias(n) for n in names])


def text_key(key: Column) -> Column:
    """A text that differs for each value, null included."""
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))


def free_name(columns: Sequence[str], name: str) -> str:
    """A column name that nothing else has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name

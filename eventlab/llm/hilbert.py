"""Shards of documents along a Hilbert curve through their metadata.

Each metadata column is quantised to levels that hold about equally many rows. The levels are
coordinates; documents are sorted by their place on the Hilbert curve through that grid and cut
into runs of equal counts. Neighbours on the curve are neighbours in every dimension, so a shard
spans few levels of each column, and a filter on any of them skips most shards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import number_sorted, sort_rows
from .tables import free_name, stored

SHARDS = 40
BITS = 5
#: Size of a document beyond its text's bytes.
OVERHEAD = 16
#: Rows that the quantiles may be off by, as a share of all rows: one in so many.
ACCURACY = 10_000


def curve_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates, one row per point.

    The coordinates are read as binary digits, most significant first. In each step the digits
    of all dimensions say which orthant the point is in, in Gray code order; the orthant's
    own curve is a rotated and mirrored copy, which is undone for the digits below.
    """
    x = levels.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            high = (x[i] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def _text_quantiles(rows: DataFrame, name: str, steps: Sequence[float]) -> list[str]:
    """For each step the smallest text that this share of the texts do not exceed, in code point order.

    Whole texts are compared. Distinct ones are counted and sorted over the cluster, cut into parts.
    """
    counted = rows.na.drop(subset=[name]).groupBy(F.col(name).alias("text")).agg(F.count("*").alias("n"))
    placed = sort_rows(counted, [], ["text"])
    sizes = placed.groupBy("_part").agg(F.sum("n").alias("size"))
    across = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row for each part.
    before = sizes.select("_part", F.coalesce(F.sum("size").over(across), F.lit(0)).alias("lower"), F.sum("size").over(W.partitionBy()).alias("total"))
    inside = W.partitionBy("_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("lower") + F.col("upto")
    ranked = placed.withColumn("upto", F.sum("n").over(inside)).join(before, "_part")
    found = ranked.agg(*[F.min(F.when(upto >= step * F.col("total"), F.col("text"))) for step in steps]).first()
    return [x for x in found if x is not None]


def levels(rows: DataFrame, dims: Sequence[str], bits: int) -> list[Column]:
    """A level column for every dimension: how many quantiles of the column lie below the value.

    A missing value has level 0. Only the quantiles, at most 2 ** bits of each column, come to the driver.
    """
    texts = [c for c in dims if isinstance(rows.schema[c].dataType, T.StringType)]
    values = {c: F.col(c) if c in texts else F.col(c).cast("double") for c in dims}
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = {c: _text_quantiles(rows, c, steps) for c in texts}
    numbers = [c for c in dims if c not in texts]
    if numbers:
        row = rows.agg(*[F.percentile_approx(values[c], steps, ACCURACY) for c in numbers]).first()
        found |= {c: x or [] for c, x in zip(numbers, row, strict=True)}
    out = []
    for c in dims:
        # A frequent value takes several quantiles; so frequent values lie far apart on the grid.
        below = [F.when(values[c] > b, n).otherwise(0) for b, n in sorted(Counter(found[c]).items())]
        out.append(F.coalesce(sum(below, F.lit(0)), F.lit(0)).cast("int"))
    return out


def assign(
    docs: DataFrame,
    dims: Sequence[str] = ("lang", "source", "size"),
    shards: int = SHARDS,
    bits: int = BITS,
) -> DataFrame:
    """``doc_id, size, text_crc32, tag, curve, shard, slot``, one row per document.

    ``size`` may be named as a dimension. Runs of the curve hold counts at most one apart; ties
    on the curve go by id, then by the row's hash (``tag``). Missing texts are empty.
    """
    text = F.col("text").cast("string")
    others = [c for c in dims if c != "size"]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint")
    tag = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    narrow = docs.select(F.col("doc_id").cast("bigint"), *others, size.alias("size"), crc.alias("text_crc32"), tag.alias("tag"))
    rows = stored(narrow, "metadata")

    @F.pandas_udf("bigint")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack([c.to_numpy() for c in columns], 1), bits))

    placed = rows.withColumn("curve", curve(*levels(rows, dims, bits)))
    ordered = placed.withColumn("last", F.col("doc_id").isNull())
    ranked = number_sorted(ordered, [], ["curve", "last", "doc_id", "tag"], "place")
    few, more = divmod(rows.count(), shards)
    place = F.col("place") - 1
    edge = more * (few + 1)  # the first shards hold one row more
    wide, thin = F.lit(few + 1), F.lit(max(few, 1))
    shard = F.when(place < edge, F.floor(place / wide)).otherwise(more + F.floor((place - edge) / thin))
    slot = F.when(place < edge, place % wide).otherwise((place - edge) % thin)
    columns = ["doc_id", "size", "text_crc32", "tag", "curve"]
    return ranked.select(*columns, shard.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, path: str, dims: Sequence[str] = ("lang", "source", "size"), shards: int = SHARDS) -> None:
    """Writes the documents as one folder of Parquet files per shard, in the order of the curve."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    tag, n, shard, slot = (free_name(docs.columns, x) for x in ("tag", "equal_row", "shard", "slot"))
    plan = assign(docs, dims, shards).select(F.col("tag").alias(tag), F.col("shard").alias(shard), F.col("slot").alias(slot))
    # Fully equal rows share a tag; each takes one of their places.
    plan = plan.withColumn(n, F.row_number().over(W.partitionBy(tag).orderBy(shard, slot)))
    rows = docs.withColumn(tag, F.xxhash64(*columns)).withColumn(n, F.row_number().over(W.partitionBy(tag).orderBy(F.lit(1))))
    joined = rows.join(plan, [tag, n]).drop(tag, n)
    joined.repartition(shards, shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)

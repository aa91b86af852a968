"""Ranks, row numbers and lags inside groups that may be too large for one task.

A plain window puts a whole group into one task. Where nothing bounds a group (a
hot experiment, a trading day with most of the market in one sector), these
helpers cut it into ordered parts, work inside the parts, and correct the result
with a small summary per part. `number_rows` and `value_positions` cut at buckets
that are known to be even (hashes, id ranges, rounded values) and stay lazy;
`sort_rows` cuts at the ranges of a distributed sort, whatever the order is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored


def _group(keys: Sequence[str]) -> Column:
    """The keys as one struct: it is never NULL, so groups with NULL keys join like any other."""
    return F.struct(*keys) if keys else F.lit(0)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    number: str = "rn",
    previous: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """Number the rows of each group 1..n, and fetch columns of the row before.

    ``bucket`` must not decrease along the group's order nor be NULL; ``order`` sorts the rows of
    a bucket and must be total. With ``previous`` the result has a struct ``prev`` of those columns,
    NULL in the first row; ``total`` names a column for the size of the group.
    """
    cut = df.withColumns({"_group": _group(keys), "_bucket": bucket})
    place = ["_group", "_bucket"]
    inside = W.partitionBy(*place).orderBy(*order)
    across = W.partitionBy("_group").orderBy("_bucket")

    summary = [F.count("*").alias("_n")]
    if previous:
        tail = F.max_by(F.struct(*previous), F.struct(*order))
        summary.append(tail.alias("_tail"))
    sizes = cut.groupBy(*place).agg(*summary)
    before = F.sum("_n").over(across.rowsBetween(W.unboundedPreceding, -1))
    carried = {"_before": F.coalesce(before, F.lit(0))}
    if total:
        carried["_total"] = F.sum("_n").over(W.partitionBy("_group"))
    if previous:
        carried["_carried"] = F.lag("_tail").over(across)
    # Both sides are cut by group and bucket outright: the windows leave the summary hashed by the
    # group alone, and Spark would send all rows of a group to one task to match it.
    offsets = sizes.withColumns(carried).drop("_n", "_tail").repartition(*place)
    numbered = cut.repartition(*place).withColumn("_rn", F.row_number().over(inside))
    if previous:
        numbered = numbered.withColumn("_prev", F.lag(F.struct(*previous)).over(inside))
    joined = numbered.join(offsets, place)
    out = joined.withColumn(number, (F.col("_before") + F.col("_rn")).cast("bigint"))
    if previous:
        out = out.withColumn("prev", F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_prev")))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, number, *(["prev"] if previous else []), *([total] if total else []))


def sort_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``_part`` and ``_pos``, their place in a sort by keys and order.

    The sort cuts at sampled ranges, so a hot group and a hot stretch of it are spread too.
    The places are stored: a lost executor cannot renumber the rows.
    """
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    fixed = stored(spread.withColumn("_id", F.monotonically_increasing_id()))
    places = {"_part": F.shiftright("_id", 33), "_pos": F.col("_id").bitwiseAND(F.lit(2**33 - 1))}
    return fixed.withColumns(places).drop("_id")


def number_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str = "rn", previous: Sequence[str] = ()
) -> DataFrame:
    """As `number_rows`, for an order without known even buckets. ``order`` must be total."""
    keys = list(keys)
    placed = sort_rows(df, keys, order)
    group = [*keys, "_part"]
    summary = [F.count("*").alias("_n"), F.min("_pos").alias("_start")]
    if previous:
        summary.append(F.max_by(F.struct(*previous), "_pos").alias("_tail"))
    across = W.partitionBy(*keys).orderBy("_part")
    before = F.coalesce(F.sum("_n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = {"_shift": before - F.col("_start") + 1}
    if previous:
        carried["_carried"] = F.lag("_tail").over(across)
    # At most one row per group and part.
    parts = placed.groupBy(*group).agg(*summary).withColumns(carried)
    if previous:
        inside = W.partitionBy(*group).orderBy("_pos")
        placed = placed.withColumn("_prev", F.lag(F.struct(*previous)).over(inside))
    joined = _join_null_safe(placed, parts.drop("_n", *(["_tail"] if previous else [])), group)
    out = joined.withColumn(number, (F.col("_pos") + F.col("_shift")).cast("bigint"))
    if previous:
        out = out.withColumn("prev", F.when(F.col("_pos") == F.col("_start"), F.col("_carried")).otherwise(F.col("_prev")))
    return out.select(*df.columns, number, *(["prev"] if previous else []))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that keeps rows with NULL keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, same).drop(*[f"_r_{k}" for k in keys])


def value_bucket(value: Column, step: float = 1e-2) -> Column:
    """Order-preserving bucket: ``step`` wide up to 10, and by relative size beyond."""
    size = F.abs(value)
    beyond = F.signum(value) * (10 / step + F.floor(F.ln(size / 10) / step))
    return F.when(size < 10, F.floor(value / step)).otherwise(beyond).cast("bigint")


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct (keys, value) with its place in the sorted group.

    ``_before`` rows of the group are smaller, ``_n`` rows are equal, of ``_total`` with a
    value. Ties are counted before anything is shuffled by value, so a value shared by much
    of a group costs one row. A bucket holds few distinct values if they are rounded (a 0.01
    wide bucket has at most ten million values of nine decimals).
    """
    keys = list(keys)
    # The filter on the bucket is the one its join below implies; written here it keeps
    # both uses of the counts identical, so they share one shuffle.
    counted = (
        df.na.drop(subset=[*keys, value])
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_n"))
        .withColumn("_bucket", value_bucket(F.col(value)))
        .where(F.col("_bucket").isNotNull())
    )
    across = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        counted.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_size"))
        .withColumns(
            {
                "_lower": F.coalesce(F.sum("_size").over(across), F.lit(0)),
                "_total": F.sum("_size").over(W.partitionBy(*keys)),
            }
        )
        .drop("_size")
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        # Said outright, as rows hashed by the keys alone would satisfy the window uncut.
        counted.repartition(*keys, "_bucket")
        .withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_bucket"])
        .select(*keys, value, (F.col("_lower") + F.col("_inside")).alias("_before"), "_n", "_total")
    )


def percent_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average-tie rank over the non-null count, one row per distinct (keys, value)."""
    rank = (F.col("_before") + (F.col("_n") + 1) / 2) / F.col("_total")
    return value_positions(df, keys, value).select(*keys, value, rank.alias(out))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Exact percentiles with linear interpolation: ``(keys, p)``, p an array in the order of ``shares``.

    Spark's own exact percentile gathers a group's values in one task. Here the distinct
    values are sorted over the cluster, and only the neighbours of each place are picked.
    """
    keys = list(keys)
    counted = df.na.drop(subset=[value]).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = sort_rows(counted, keys, [value]).withColumn("_group", _group(keys))
    place = ["_group", "_part"]
    across = W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy(*place).agg(F.sum("_n").alias("_size"))
    offsets = {
        "_lower": F.coalesce(F.sum("_size").over(across), F.lit(0)),
        "_total": F.sum("_size").over(W.partitionBy("_group")),
    }
    # Cut outright, as in `number_rows`: a group's values are never one task's work.
    parts = sizes.withColumns(offsets).drop("_size").repartition(*place)
    inside = W.partitionBy(*place).orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_lower") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranked = placed.repartition(*place).join(parts, place).withColumn("_before", before)

    def value_at(index: Column) -> Column:
        here = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_n"))
        return F.max(F.when(here, F.col(value)))

    wanted = []
    for share in shares:
        at = share * (F.col("_total") - 1)
        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        wanted.append(low + (high - low) * F.max(at - F.floor(at)))
    return ranked.groupBy(*keys).agg(F.array(*wanted).alias("p"))

"""Mixes sources to target weights, by counts of exact document lengths.

Every source gets a share of all words. What it gives at least a whole time is taken whole;
the rest of its budget is filled from the histogram of its document lengths: the same share of
every length first, then a bounded knapsack over the lengths that are left, which usually meets
the budget to the word. Documents are picked by a seeded hash, as many of each length as the
histogram says. Only histograms meet in one task, and they do not grow with the documents: a
source has at most as many lengths as its longest document has words.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import number_rows, number_sorted
from .tables import free_name, join_groups, stored, text_key

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
WORD = "[^\\x20\\x09-\\x0D]+"
#: Budget in words that the knapsack fills exactly; what is above it is filled greedily before.
KNAPSACK = 1 << 15
#: Rows of one source and length that are ranked by one task.
RANKED = 4096
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_level(sources: DataFrame, total: int, most: int) -> float:
    """The words per unit of weight at which the capped targets add up to the total.

    Every round caps the sources that the last level would take above ``most`` times their
    size, and shares the rest among the others by weight. Only sums leave the table.
    """
    cap = F.col("source_size") * most
    level = None
    while True:
        above = F.lit(False) if level is None else cap < F.col("weight") * F.lit(level)
        capped = F.sum(F.when(above, cap).otherwise(F.lit(0))).alias("capped")
        weights = F.sum(F.when(above, F.lit(0)).otherwise(F.col("weight"))).alias("weights")
        row = sources.agg(capped, weights).first()
        if not row["weights"]:
            return float("inf") if level is None else level
        new = (total - row["capped"]) / row["weights"]
        if level is not None and new <= level:
            return level
        level = new


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """One row per source: ``source, source_size, source_docs, target``.

    Sources take the weights in turn, in code point order, a missing source last.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    last = sums.withColumn("is_null", F.col("source").isNull())
    ranked = stored(number_sorted(last, [], ["is_null", "source"], "place"), "sources")
    weight = F.array(*[F.lit(float(w)) for w in weights])
    sources = ranked.withColumn("weight", F.get(weight, ((F.col("place") - 1) % len(weights)).cast("int")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, total, most)
    cap = (F.col("source_size") * most).cast("double")
    target = F.when(cap < F.col("weight") * F.lit(level), cap).otherwise(F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", "source_docs", F.when(F.lit(total > 0), target).otherwise(F.lit(0.0)).alias("target"))


def fill_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, knapsack: int = KNAPSACK) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up to the budget, or nearly."""
    taken = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.astype(np.int64)
    if budget <= 0:
        return taken
    if total > knapsack:
        share = budget / total
        taken = np.minimum(np.floor(counts * share).astype(np.int64), counts)
        taken[sizes == 0] = 0
    left = counts - taken
    rest = budget - int((taken * sizes).sum())
    for i in np.argsort(-sizes, kind="stable").tolist():
        if rest <= knapsack:
            break
        more = min(int(left[i]), (rest - knapsack) // int(sizes[i])) if sizes[i] else 0
        taken[i] += more
        left[i] -= more
        rest -= more * int(sizes[i])
    # Bounded knapsack: the counts in powers of two, the reachable sums as the bits of a number. Sums
    # above the budget count too, up to twice the rest: one of them may be nearer.
    most_sum = 2 * rest
    items = []
    for i in np.flatnonzero((sizes > 0) & (sizes <= most_sum) & (left > 0)).tolist():
        most, part = min(int(left[i]), most_sum // int(sizes[i])), 1
        while most:
            part = min(part, most)
            items.append((i, part))
            most -= part
            part *= 2
    items.sort(key=lambda x: -int(sizes[x[0]]) * x[1])
    reach, within, steps = 1, (1 << (most_sum + 1)) - 1, []
    for i, part in items:
        steps.append(reach)
        reach |= (reach << (int(sizes[i]) * part)) & within
        if reach >> rest & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    nearest = (above & -above).bit_length() + rest if above else None
    at = nearest if nearest is not None and nearest - rest < rest - below else below
    for (i, part), before in zip(reversed(items[: len(steps)]), reversed(steps), strict=True):
        if not before >> at & 1:
            taken[i] += part
            at -= int(sizes[i]) * part
    return taken


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source: repeats of every document, and how many of each size get one more."""
    target, total = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    repeats = min(int(target // total), MAX_REPEATS) if total else 0
    budget = round(target - repeats * total)
    pdf = pdf.sort_values("size")
    extra = fill_budget(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), budget)
    return pdf.assign(repeats=repeats, extra=extra)[["cell", "size", "n", "repeats", "extra", "source_size", "target"]]


def _chosen(sized: DataFrame, weights: Sequence[float], most: int, seed: int) -> DataFrame:
    """The sized rows with their source's figures and ``repeats``, how often each is taken."""
    cell = F.concat_ws("|", F.col("size").cast("string"), text_key(F.col("source")))
    sized = stored(sized.withColumn("cell", cell), "sizes")
    sources = targets(sized, weights, most)
    counts = sized.groupBy("source", "size", "cell").agg(F.count("*").alias("n")).withColumn("key", text_key(F.col("source")))
    merged = counts.join(sources.withColumn("key", text_key(F.col("source"))).drop("source"), "key")
    kind = "cell string, size bigint, n bigint, repeats int, extra bigint, source_size bigint, target double"
    plan = merged.groupBy("key").applyInPandas(_plan, kind).drop("size")
    rows = sized.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "tag"))
    joined = join_groups(rows, plan, "cell", "n", F.lit(max(1, sized.count())))
    # Small cells have one bucket; a hot cell is cut by ranges of the draw.
    share = (F.col("draw").cast("double") / 2.0**64) + 0.5
    bucket = F.least(F.floor(share * F.ceil(F.col("n") / RANKED)), F.ceil(F.col("n") / RANKED) - 1)
    ranked = number_rows(joined, ["cell"], bucket, ["draw", "tag"], "place")
    often = F.col("repeats") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)
    return ranked.withColumn("often", often)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, one row per document.

    A missing text has size 0 and is never taken; a missing source is a source of its own.
    Reruns agree; fully equal rows may change places. Other columns are ignored.
    """
    if most != MAX_REPEATS:
        raise ValueError(f"documents are repeated {MAX_REPEATS} times at most")
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), word_count(text).alias("size"), F.xxhash64(text).alias("tag"))
    chosen = _chosen(sized, weights, most, seed)
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("often")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The documents of the mix with their columns as they are, repeated as often as they are taken."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    tag = F.xxhash64(*columns)
    sized = docs.select(
        F.col("doc_id").cast("bigint"),
        F.col("source").cast("string"),
        word_count(F.col("text").cast("string")).alias("size"),
        tag.alias("tag"),
    )
    own = F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), tag)
    chosen = _chosen(sized, weights, MAX_REPEATS, seed).where("often > 0 AND size > 0")
    # Fully equal rows share a draw: their repeats are added up, and dealt to them again below.
    draw, total, place, n, copy = (free_name(docs.columns, x) for x in ("draw", "often", "place", "equal_rows", "copy"))
    often = chosen.groupBy(F.col("draw").alias(draw)).agg(F.sum("often").alias(total))
    joined = docs.withColumn(draw, own).join(often, draw)
    equal = W.partitionBy(draw)
    joined = joined.withColumns({place: F.row_number().over(equal.orderBy(F.lit(1))), n: F.count(F.lit(1)).over(equal)})
    more = F.when(F.col(place) <= F.col(total) % F.col(n), 1).otherwise(0)
    copies = F.array_repeat(F.lit(0), (F.floor(F.col(total) / F.col(n)) + more).cast("int"))
    return joined.select(*columns, F.explode(copies).alias(copy)).select(*columns)

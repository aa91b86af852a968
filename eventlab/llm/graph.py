"""Connected components over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


class Forest:
    """Union-find over any long numbers; the smallest number is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether it joined two trees."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Every node that is not a root, and its root."""
        nodes = [x for x, up in self.parent.items() if x != up]
        return np.array(nodes, np.int64), np.array([self.root(x) for x in nodes], np.int64)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition, replaced by an edge from each node to the smallest it reaches here."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
    nodes, roots = forest.edges()
    if len(nodes):
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], schema=EDGES)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` but the roots themselves.

    The root is the smallest node of a component. Rounds of large-star and small-star steps: each
    node hands the smallest node it sees to its larger neighbours, then to its smaller ones. The
    number of edges never grows, rounds grow with the logarithm of the nodes, and the neighbours of
    a hot node are joined by a plain equi-join, which Spark splits when one key is large.
    """
    pairs = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b")
    now = stored(pairs.mapInArrow(local_stars, "a bigint, b bigint"), "edges")
    state = _state(now)
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        new = _state(now)
        if new == state:
            return now.toDF("node", "root")
        state = new


def _state(edges: DataFrame) -> tuple:
    """Changes when the set of edges changes."""
    mixed = F.sum(F.pmod(F.xxhash64("a", "b"), F.lit((1 << 31) - 1)))
    return tuple(edges.agg(F.count("*"), mixed).first())

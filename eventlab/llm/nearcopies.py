"""Near-duplicate documents by order MinHash, verified by banded alignment.

A sketch holds the few occurrence-labelled shingles of a text that a random order puts first, in
the order of the text. Two texts share one with about the probability that the shingles of both
agree in those places and in their order, so sketches feel moved text, which plain MinHash does not.

1. Equal sequences of words are one class; only classes go on.
2. Classes that share any sketch are candidates. In each such bucket the member that sits in the most
   and largest buckets is the hub, and all others are compared with it.
3. Links make components. Where a bucket is still split, all its pairs across components are
   settled: in blocks, by counting common shingles with matrix products, and aligning what the
   counts leave possible. Pairs are never listed, and no bucket is cut short.

The similarity of two texts is the share of their shingles that an alignment keeps in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import Forest, components
from .orderhash import MIN_SIMILARITY, SKETCHES, shingles, similarity, sketches
from .suffixes import LAST_ID
from .tables import free_name, join_groups, small_batches, stored
from .textblocks import text_blocks

#: Members of a bucket that are compared at one go; larger ones are cut into blocks.
BLOCK = 1024
#: Shingles whose counts are multiplied at one go.
COLUMNS = 2048

SKETCH = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole, size, keys = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, SKETCHES), np.uint64)]
        for block in text_blocks(batch.column("text")):
            value, own, both = shingles(block)
            whole.append(both)
            size.append(np.bincount(own, minlength=len(block)))
            keys.append(sketches(value, own, len(block)))
        f, sketch = np.concatenate(whole).view(np.int64), np.concatenate(keys).view(np.int64)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel()), SKETCHES).cast(pa.list_(pa.int64()))
        found = [pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(np.concatenate(size)), lists]
        names = ["doc", "tag", *SKETCH.names]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), *found], names=names)


def _own_shingles(text: str) -> np.ndarray:
    value, _, _ = shingles(next(text_blocks(pa.array([text or ""]))))
    return value


def _verify(least: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, np.zeros(0, np.uint64)
        for batch in batches:
            linked = []
            rows = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            for a, b, text_a, text_b in zip(*rows, strict=True):
                if a != last:
                    last, first = a, _own_shingles(text_a)
                linked.append(similarity(first, _own_shingles(text_b), least) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def settle(own: list[np.ndarray], component: np.ndarray, node: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Links that connect different components among texts given by their shingles."""
    n = len(own)
    size = np.array([len(x) for x in own])
    _, which = np.unique(np.concatenate(own), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    seen = np.bincount(which)
    shared = seen[which] > 1
    row, which = row[shared], (np.cumsum(seen > 1) - 1)[which[shared]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    for start in range(0, int(which[-1]) + 1 if len(which) else 0, COLUMNS):
        a, b = np.searchsorted(which, [start, start + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[a:b], which[a:b] - start] = 1
        common += part @ part.T
    possible = common >= least / (1 + least) * (size[:, None] + size) - 1e-3
    possible &= component[:, None] != component
    forest = Forest()
    for i, j in zip(*np.nonzero(np.triu(possible, 1)), strict=True):
        a, b = int(component[i]), int(component[j])
        if forest.root(a) != forest.root(b) and similarity(own[i], own[j], least) >= least:
            forest.join(a, b)
            yield int(node[i]), int(node[j])


def _settle_cells(least: float) -> object:
    """Batches sorted by cell; a cell may go on in the next batch."""

    def flush(held: list[tuple]) -> tuple[list[int], list[int]]:
        links = list(settle([_own_shingles(t) for *_, t in held], np.array([c for _, c, _ in held]), np.array([x for x, *_ in held]), least))
        return [a for a, _ in links], [b for _, b in links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            a, b = [], []
            rows = (batch.column(c).to_pylist() for c in ("key", "low", "high", "node", "root", "text"))
            for key, low, high, node, root, text in zip(*rows, strict=True):
                if (key, low, high) != last:
                    if len(held) > 1:
                        more = flush(held)
                        a, b = a + more[0], b + more[1]
                    held, last = [], (key, low, high)
                held.append((node, root, text))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if len(held) > 1:
            a, b = flush(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of classes."""
    wanted = classes.join(nodes, "node").select("node", "rep.doc", "rep.tag")
    rows = docs.select("doc", "tag", "text")
    return rows.join(wanted, ["doc", "tag"]).groupBy("node").agg(F.first("text").alias("text"))


def _members(classes: DataFrame) -> DataFrame:
    """``key, node, centre``: classes by the sketches that they share; the hub of a key has the largest centre."""
    entries = classes.select("node", F.explode(F.array_distinct("sketch")).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(entries.join(sizes, "key"), "members")
    # Sizes are summed up to a bound that only ties the largest, so the sum cannot overflow.
    centre = members.groupBy("node").agg(F.sum(F.least("size", F.lit(1 << 40))).alias("centre"))
    return stored(members.join(centre, "node").select("key", "node", "centre"), "members")


def _links(docs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``node, root`` of classes that a chain of links connects."""
    members = _members(classes)
    hubs = members.groupBy("key").agg(F.max(F.struct("centre", (-F.col("node")).alias("minus"))).alias("hub"))
    stars = members.join(hubs, "key").withColumn("hub", -F.col("hub.minus")).where("node <> hub")
    pairs = stored(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = stored(_texts(docs, classes, ends), "texts")
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    links = stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(least), "a bigint, b bigint"), "links")
    roots = components(links)

    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    state = rooted.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("size"))
    split = state.where("r1 <> r2").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    unsettled = rooted.join(split, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = unsettled.select("key", "node", "root", "block", other.alias("other"))
    cells = cells.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "root")
    # A bucket in one block is often repeated by another sketch: equal sets of members are settled once.
    once = _distinct_cells(cells)
    dealt = once.join(texts, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = dealt.select("key", "low", "high", "node", "root", "text").mapInArrow(_settle_cells(least), "a bigint, b bigint")
    more = stored(found, "links")
    if more.isEmpty():
        return roots
    return components(links.union(more))


def _distinct_cells(cells: DataFrame) -> DataFrame:
    """The cells without those that hold exactly the nodes of another one."""
    cells = stored(cells, "cells")
    mixed = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")).alias(f"m{i}") for i in (1, 2)]
    sets = cells.groupBy("key", "low", "high").agg(F.count("*").alias("n"), *mixed)
    kept = sets.groupBy("n", "m1", "m2").agg(F.min(F.struct("key", "low", "high")).alias("cell")).select("cell.*")
    return cells.join(kept, ["key", "low", "high"])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID))
    return small_batches(docs).select(doc.alias("doc"), _tag(text).alias("tag"), text.alias("text"))


def _tag(text: Column) -> Column:
    return F.xxhash64(text)


def classify(docs: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """``doc, tag, class_id, component_id, kept``, one row per document; a missing id is `LAST_ID`.

    ``class_id`` is the smallest document with the same words, ``component_id`` the smallest that a chain of links
    reaches, and exactly one row of a component is kept. Texts without words are alone.
    """
    rows = _rows(docs)
    kinds = "doc bigint, tag bigint, f1 bigint, f2 bigint, n bigint, sketch array<bigint>"
    sketched = stored(rows.mapInArrow(_sketch_batches, kinds).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    same = F.when(F.col("n") > 0, F.concat_ws(":", F.col("f1").cast("string"), F.col("f2").cast("string")))
    sketched = sketched.withColumn("same", same)
    grouped = sketched.where("n > 0").groupBy("same").agg(
        F.min(F.struct("doc", "tag", "uid")).alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")
    )
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = _links(rows, classes, least)
    rooted = classes.select("same", "node", "rep", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    groups = rooted.join(smallest, "root").select("same", "copies", "rep", "component")
    joined = join_groups(sketched.select("doc", "tag", "uid", "same"), groups, "same", "copies", F.lit(max(1, sketched.count())))
    own = F.struct("doc", "tag", "uid")
    component, rep = F.coalesce("component", own), F.coalesce("rep", own)
    return joined.select("doc", "tag", rep["doc"].alias("class_id"), component["doc"].alias("component_id"), (component["uid"] == F.col("uid")).alias("kept"))


def near_duplicates(docs: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """``doc_id, class_id, component_id, kept``, one row per document; see `classify`."""
    found = classify(docs, least)
    return found.select(*[F.nullif(F.col(a), F.lit(LAST_ID)).alias(b) for a, b in (("doc", "doc_id"), ("class_id", "class_id"), ("component_id", "component_id"))], "kept")


def keep_one(docs: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """One document of every component, with its columns as they are."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    doc, tag, n = (free_name(docs.columns, x) for x in ("doc", "tag", "equal_row"))
    kept = stored(classify(docs, least).where("kept").select(F.col("doc").alias(doc), F.col("tag").alias(tag)), "kept")
    own = {doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)), tag: _tag(F.col("text").cast("string"))}
    # Texts without words are all kept; otherwise one of several equal rows is.
    wordless = ~F.rlike(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]"))
    joined = docs.withColumns(own).join(kept.distinct(), [doc, tag])
    numbered = joined.withColumn(n, F.row_number().over(W.partitionBy(doc, tag).orderBy(F.lit(1))))
    return numbered.where((F.col(n) == 1) | wordless).select(*columns)

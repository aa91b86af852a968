"""Near-duplicate vectors by cosine: inverted lists, product-quantised residuals, exact rerank.

Vectors are scaled to length one. Coarse centroids make inverted lists; the residual of a vector to
its centroid is coded by subspaces. A vector asks the lists near it, compares the codes there by
table lookup, and reranks what may be close enough by exact cosine in double precision.

* Probes: a neighbour of cosine t is at most r = sqrt(2 - 2t) away. If it is in another list, the step
  towards it crosses the plane between both centroids, so one of the two is at most r / 2 from that
  plane. A vector asks every list whose plane is that near: no pair is missed, whatever the directions
  in which the vectors differ. The number of probes follows from the data, not from a parameter.
* Pairs over two lists count where the vector nearer to the plane asks, once, for both directions.
  Inside a list both ask.
* Codes: with the code's own error e (stored), the distance to the coded vector differs from the
  true one by e at most. Everything within r + e is reranked, so codes lose nothing.
* Equal vectors are one class before all that. A list of many vectors is dealt to blocks, so neither
  copies nor a dense region meet in one task. Tasks return the number of links of each vector and a
  spanning forest of the links, not the links.

Centroids and codes are fitted on a bounded sample of ``SAMPLE`` vectors; all vectors are indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .graph import Forest, components
from .tables import join_groups, stored

MIN_COSINE = 0.9
SAMPLE = 16_384
#: Vectors for each inverted list, and the most lists; beyond it lists grow and are cut into blocks.
PER_LIST = 100
MAX_LISTS = 2048
#: Vectors of a list that one task holds together.
BLOCK = 1024
SUBSPACE = 4
CODES = 256
#: What single precision may add to a distance.
SLACK = np.float32(1e-3)
ROWS = 1024
#: Lengths of vectors whose links are stored together.
LENGTHS_AT_ONCE = 16


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids; empty clusters keep theirs."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        own = nearest(points, centres)
        sums = np.zeros((len(centres), points.shape[1]))
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([np.argmax(points[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(points), 4096)])


@dataclass
class Index:
    """Coarse centroids, and the codebook of each subspace with its columns."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, codes: int = CODES) -> Index:
        d = sample.shape[1]
        centres = kmeans(sample, lists)
        rest = sample - centres[nearest(sample, centres)]
        cuts = [(a, min(a + SUBSPACE, d)) for a in range(0, d, SUBSPACE)]
        return cls(centres, [kmeans(np.ascontiguousarray(rest[:, a:b]), codes) for a, b in cuts], cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, squared length of the coded vector, and the coding error."""
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([nearest(np.ascontiguousarray(rest[:, a:b]), book) for (a, b), book in zip(self.cuts, self.books, strict=True)], 1)
        coded = self.centres[own] + np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)
        return own, codes.astype(np.uint8), (coded * coded).sum(1), np.sqrt(((x - coded) ** 2).sum(1))

    def between(self) -> np.ndarray:
        """Distances between centroids."""
        c = self.centres.astype(np.float64)
        sq = (c * c).sum(1)
        return np.sqrt(np.maximum(sq[:, None] + sq - 2 * c @ c.T, 0))

    def probes(self, x: np.ndarray, own: np.ndarray, between: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and lists to ask: those whose plane to the own list is within half the radius."""
        far = (self.centres * self.centres).sum(1) - 2 * (x @ self.centres.T)
        ahead = far - far[np.arange(len(x)), own][:, None]
        return np.nonzero(ahead <= radius * between[own] + SLACK)

    def depth(self, x: np.ndarray, own: np.ndarray, other: int | np.ndarray) -> np.ndarray:
        """How far vectors are on their list's side of the plane, times the centroids' distance.

        Row by row in double precision, so that both vectors of a pair get the same from any batch.
        """
        a, b = self.centres[own].astype(np.float64), self.centres[other].astype(np.float64)
        return ((x - (a + b) / 2) * (a - b)).sum(1)


def rows_of(column: pa.Array, d: int) -> np.ndarray:
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).reshape(-1, d)


def in_range(x: np.ndarray) -> np.ndarray:
    """Vectors as doubles whose largest component lies between a half and one, so that no square leaves the range.

    They are scaled by powers of two, which changes no cosine, not even by rounding; what gets
    lost is less than 1e-300 of the largest component.
    """
    wide = x.astype(np.float64)
    _, power = np.frexp(np.abs(wide).max(1, initial=0.0))
    # In two steps, as the power itself may be out of range.
    half = -power // 2
    return np.ldexp(np.ldexp(wide, half[:, None]), (-power - half)[:, None])


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors of length one, in single precision: for search, not for the verdict."""
    wide = in_range(x)
    return (wide / np.sqrt((wide * wide).sum(1))[:, None]).astype(np.float32)


def _count(index: Index, d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = np.unique(nearest(scaled(rows_of(batch.column("vector"), d)), index.centres), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n, pa.int64())], names=["list", "n"])

    return run


def _fields(d: int, index: Index) -> dict[str, str]:
    """The vectors travel as doubles, scaled by powers of two: whatever their type was, the verdict is exact."""
    codes = f"V{len(index.cuts)}"
    return {"node": "i8", "copies": "i8", "home": "i4", "list": "i4", "vector": f"V{8 * d}", "codes": codes, "square": "f4", "error": "f4"}


def _deal(index: Index, d: int, blocks: np.ndarray, width: int, radius: float) -> Callable:
    """Every vector to the block of its list, and as a question to all blocks of the lists it asks."""
    first = np.cumsum(blocks) - blocks
    fields = _fields(d, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = index.between()
        for batch in batches:
            nodes, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            vectors = in_range(rows_of(batch.column("vector"), d))
            for at in range(0, len(nodes), 4096):
                raw, node = np.ascontiguousarray(vectors[at : at + 4096]), nodes[at : at + 4096]
                x = scaled(raw)
                own, codes, square, error = index.encode(x)
                block = first[own] + blobs.group_of_ids(node, 1 << 30) % blocks[own]
                packed = {"node": node, "copies": copies[at : at + 4096], "home": own, "list": block, "vector": raw.view(f"V{8 * d}").ravel()}
                packed |= {"codes": np.ascontiguousarray(codes).view(f"V{codes.shape[1]}").ravel(), "square": square, "error": error}
                yield _kind(blobs.pack(spread(block, width), packed, fields), 0)
                asked: list[tuple[np.ndarray, np.ndarray]] = []
                for i in range(0, len(x), ROWS):
                    row, lists = index.probes(x[i : i + ROWS], own[i : i + ROWS], between, radius)
                    n = blocks[lists]
                    row = np.repeat(row + i, n)
                    asked.append((row, np.repeat(first[lists], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)))
                row, block = (np.concatenate(c) for c in zip(*asked, strict=True))
                if len(row):
                    yield _questions(row, block, node, copies[at : at + 4096], own, raw)

    def _questions(row: np.ndarray, block: np.ndarray, node: np.ndarray, copies: np.ndarray, own: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        """A question goes to a partition once, with all blocks that it asks there."""
        part = spread(block, width)
        order = np.lexsort((block, row, part))
        row, block, part = row[order], block[order], part[order]
        lead = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])])
        count = np.diff(np.r_[lead, len(row)])
        columns = {"node": node[row[lead]], "copies": copies[row[lead]], "home": own[row[lead]], "list": count, "vector": raw.view(f"V{8 * d}").ravel()[row[lead]]}
        columns |= {"codes": np.zeros(len(lead), fields["codes"]), "square": np.zeros(len(lead)), "error": np.zeros(len(lead))}
        packed = blobs.pack(part[lead], columns, fields)
        lists = [pa.scalar(blobs.squeeze(b.astype("i4")), pa.binary()) for b in np.split(block, np.flatnonzero(part[1:] != part[:-1]) + 1)]
        return _kind(packed.set_column(packed.schema.get_field_index("codes"), "codes", pa.array([x.as_py() for x in lists], pa.binary())), 1)

    return run


def _kind(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([kind] * batch.num_rows, pa.int32())], names=[*batch.schema.names, "kind"])


def spread(block: np.ndarray, width: int) -> np.ndarray:
    return blobs.group_of_ids(block + 1, width)


def _answer(index: Index, d: int, min_cosine: float) -> Callable:
    """Rows of ``kind`` 0: a node and its links here; 1: an edge of the forest."""
    radius = np.float32(np.sqrt(2 - 2 * min_cosine))
    fields = _fields(d, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, tuple] = {}
        own: list[dict] = []
        forest = Forest()
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            indexed = batch.filter(pa.array(kinds == 0))
            if indexed.num_rows:
                own.append(blobs.unpack(indexed, fields))
            asked = batch.filter(pa.array(kinds == 1))
            if not asked.num_rows:
                continue
            if own:
                lists = _lists(own)
                own = []
            for i in range(asked.num_rows):
                row = asked.slice(i, 1)
                found = blobs.unpack(row.drop_columns(["codes"]), {k: v for k, v in fields.items() if k != "codes"})
                count = found["list"].astype(np.int64)
                blocks = blobs.expand(row.column("codes")[0].as_py(), "i4", int(count.sum()))
                x = np.frombuffer(found["vector"].tobytes(), np.float64).reshape(-1, d)
                yield from _search(found["node"], found["copies"], found["home"], x, count, blocks, lists, forest)
        nodes, roots = forest.edges()
        if len(nodes):
            yield _out(1, nodes, roots)

    def _lists(own: list[dict]) -> dict[int, tuple]:
        merged = {k: np.concatenate([x[k] for x in own]) for k in own[0]}
        order = np.argsort(merged["list"], kind="stable")
        names, at = np.unique(merged["list"][order], return_index=True)
        out = {}
        for name, mine in zip(names.tolist(), np.split(order, at[1:]), strict=True):
            raw = np.frombuffer(merged["vector"][mine].tobytes(), np.float64).reshape(-1, d)
            codes = merged["codes"][mine].view(np.uint8).reshape(len(mine), -1)
            home = int(merged["home"][mine[0]])
            length = np.sqrt((raw * raw).sum(1))
            out[name] = (merged["node"][mine], merged["copies"][mine], raw, length, codes, merged["square"][mine], merged["error"][mine], home)
        return out

    def _search(
        node: np.ndarray, own_copies: np.ndarray, own: np.ndarray, x: np.ndarray, count: np.ndarray, blocks: np.ndarray, lists: dict, forest: Forest
    ) -> Iterator[pa.RecordBatch]:
        links = np.zeros(len(node), np.int64)
        of = np.repeat(np.arange(len(node)), count)
        for at in range(0, len(node), ROWS):
            raw = x[at : at + ROWS]
            chunk, length = scaled(raw), np.sqrt((raw * raw).sum(1))
            tables = [chunk[:, a:b] @ book.T for (a, b), book in zip(index.cuts, index.books, strict=True)]
            mine = (of >= at) & (of < at + ROWS)
            rows, where = of[mine] - at, blocks[mine]
            order = np.argsort(where, kind="stable")
            names, first = np.unique(where[order], return_index=True)
            for name, asks in zip(names.tolist(), np.split(rows[order], first[1:]), strict=True):
                if name not in lists:
                    continue
                other, copies, vector, its_length, codes, square, error, home = lists[name]
                back = np.zeros(len(other), np.int64)
                dot = np.repeat((chunk[asks] @ index.centres[home])[:, None], len(other), 1)
                for i, table in enumerate(tables):
                    dot += table[asks][:, codes[:, i]]
                distance = np.sqrt(np.maximum(1 + square - 2 * dot, 0))
                a, b = np.nonzero(distance <= radius + error + SLACK)
                a = asks[a]
                for i in range(0, len(a), 1 << 16):
                    p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                    cosine = np.einsum("ij,ij->i", raw[p], vector[q]) / (length[p] * its_length[q])
                    linked = (cosine >= min_cosine) & (node[at + p] != other[q])
                    p, q = at + p[linked], q[linked]
                    across = own[p] != home
                    counts = ~across
                    if across.any():
                        a1, b1 = p[across], q[across]
                        mine_deep = index.depth(x[a1] / length[a1 - at, None], own[a1], home)
                        its_deep = index.depth(vector[b1] / its_length[b1, None], np.full(len(b1), home), own[a1])
                        counts[across] = (mine_deep < its_deep) | ((mine_deep == its_deep) & (node[a1] < other[b1]))
                    p, q, across = p[counts], q[counts], across[counts]
                    np.add.at(links, p, copies[q])
                    np.add.at(back, q[across], own_copies[p[across]])
                    new = across | (node[p] > other[q])
                    for one, two in zip(node[p[new]].tolist(), other[q[new]].tolist(), strict=True):
                        forest.join(one, two)
                if back.any():
                    yield _out(0, other[back > 0], back[back > 0])
        some = np.flatnonzero(links)
        yield _out(0, node[some], links[some])

    def _out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    return run


def _links(classes: DataFrame, d: int, min_cosine: float, per_list: int) -> DataFrame:
    """``kind, a, b``: links of each node found anywhere, and edges that connect them."""
    spark = classes.sparkSession
    width = blobs.width(spark)
    rows = classes.where(F.size("vector") == d).select("node", F.col("n").alias("copies"), "vector")
    picked = rows.orderBy(F.xxhash64(F.lit(11), "node")).limit(SAMPLE).select("vector").toArrow()
    sample = np.concatenate([scaled(rows_of(b.column("vector"), d)) for b in picked.to_batches()])
    lists = int(np.clip(rows.count() // per_list, 1, min(MAX_LISTS, max(1, len(sample) // 8))))
    index = Index.fit(sample, lists)
    counted = rows.select("vector").mapInArrow(_count(index, d), "list int, n bigint").groupBy("list").agg(F.sum("n").alias("n"))
    blocks = np.ones(len(index.centres), np.int64)
    for row in counted.collect():  # one row per list, MAX_LISTS at most
        blocks[row["list"]] = -(-row["n"] // BLOCK)
    packed = rows.mapInArrow(_deal(index, d, blocks, width, np.sqrt(2 - 2 * min_cosine)), f"{blobs.schema(_fields(d, index))}, kind int")
    return blobs.send(packed).sortWithinPartitions("kind").mapInArrow(_answer(index, d, min_cosine), "kind int, a bigint, b bigint")


def near_duplicates(
    vectors: DataFrame,
    min_cosine: float = MIN_COSINE,
    per_list: int = PER_LIST,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row.

    Vectors that are missing, empty, zero, or hold a missing or non-finite component link with nothing, and so do
    vectors of different lengths among each other: each length is searched by itself, one after another, however many
    there are. Components may be as large or small as doubles are. Equal vectors are linked. Rows that share an id count
    each. A missing id is never the smallest of a component that has another.
    """
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("vector"))
    own = F.concat_ws(":", F.xxhash64(F.lit(1), "vector").cast("string"), F.xxhash64(F.lit(2), "vector").cast("string"))
    rows = rows.withColumn("class", F.when(fine, own))
    grouped = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "vectors")
    lengths = [r[0] for r in classes.groupBy(F.size("vector").alias("d")).count().orderBy("d").collect()]
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "kind int, a bigint, b bigint")
    if not lengths:
        found = stored(found, "links")
    for at in range(0, len(lengths), LENGTHS_AT_ONCE):
        for d in lengths[at : at + LENGTHS_AT_ONCE]:
            found = found.union(_links(classes, d, min_cosine, per_list))
        found = stored(found, "links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 1").select("a", "b"))
    narrow = classes.select("node", "class", "rep", "n")
    nodes = narrow.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    figures = nodes.join(smallest, "root").select("class", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    joined = join_groups(rows.select("vec_id", "class"), figures, "class", "n", F.lit(max(1, vectors.count())))
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

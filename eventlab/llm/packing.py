"""Packs tokenised documents into sequences of a fixed length, by the sum-of-squares rule.

Documents are encoded and closed by an end id. Longer ones are cut: the first piece takes the
remainder, the others are full. Pieces are dealt evenly to groups, and every group packs its own:
longest first, a piece goes where the squared counts of open sequences per remaining gap become
smallest, so no gap becomes common without pieces that fill it. A group wastes a few sequences at most,
whatever its size, so many groups pack about as well as one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import width
from .tables import small_batches, stored
from .textblocks import text_blocks
from .tokens import ENCODED_BYTES, default_vocabulary, encoder

LENGTH = 1024
END_ID = 2
#: Documents in a group that is packed by one task.
GROUP_DOCS = 32_768

PIECES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
PLACES = {"sequence_id": pa.int64(), "offset": pa.int64()}


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids; only the first may be shorter."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *((at, length) for at in range(first, n, length))]


def _encode(vocabulary: str | None, length: int, end_id: int, with_ids: bool) -> Callable:
    names = [*PIECES, *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary or default_vocabulary()).encode
        end = np.array([end_id], "<u4")
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for block in text_blocks(batch.column("text"), ENCODED_BYTES):
                rows: list[tuple] = []
                for row, own_ids in enumerate(encode(block), block.first):
                    ids = memoryview(np.concatenate([own_ids, end]).tobytes())
                    for i, (start, size) in enumerate(cut(len(ids) // 4, length)):
                        own = ids[4 * start : 4 * (start + size)]
                        rows.append((docs[row], i, start, size, zlib.crc32(own), *([bytes(own)] if with_ids else [])))
                kinds = [*PIECES.values(), *([pa.binary()] if with_ids else [])]
                arrays = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece, in the order given.

    A new sequence is opened only if the piece fits into none.
    """
    counts = np.zeros(length + 1, np.int64)  # open sequences by gap; closed ones are not counted
    open_at: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    for i, size in enumerate(sizes.tolist()):
        # Moving one from gap g to g - size changes the sum of squares by 2 * (N[g - size] - N[g] + 1).
        before, after = counts[size:], counts[: length + 1 - size]
        change = after - before + 1
        change = np.where(before > 0, change + change, np.iinfo(np.int64).max)
        if before[0]:
            change[0] = 1 - 2 * before[0]  # it closes, which leaves no gap behind
        best = int(change.argmin())
        if before[best]:
            gap = best + size
            own = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, own = length, made
            made += 1
        sequence[i], offset[i] = own, length - gap
        if gap > size:
            counts[gap - size] += 1
            open_at[gap - size].append(own)
    return sequence, offset


def _pack(length: int, names: list[str]) -> Callable:
    """Packs batches that come sorted by group, and longest first in a group; holds one group at a time."""

    def packed(found: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(found)
        sequence, offset = sum_of_squares(table.column("length").to_numpy(), length)
        sequence += int(table.column("group")[0].as_py()) << 32
        table = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from table.select(names).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column("group").to_numpy()
            edges = np.flatnonzero(np.diff(group)) + 1
            for start, end in zip([0, *edges], [*edges, len(group)], strict=True):
                if start == end:
                    continue
                if own and own[0].column("group")[0].as_py() != group[start]:
                    yield from packed(own)
                    own = []
                own.append(batch.slice(start, end - start))
        if own:
            yield from packed(own)

    return run


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    group_docs: int = GROUP_DOCS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A missing text is an empty one; every document ends with the end id, so none is lost. Pieces are
    stored and dealt to groups by their place in the stored table: repeated rows and ids spread, and a lost
    executor, after which rows may come in another order, cannot deal a piece twice or not at all. ``with_ids``
    adds the ids as little-endian unsigned 32-bit numbers. Other columns are ignored.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    extra = ", ids binary" if with_ids else ""
    fields = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = stored(rows.mapInArrow(_encode(vocabulary, length, end_id, with_ids), f"{fields}{extra}"), "pieces")
    groups = max(1, -(-pieces.where("piece = 0").count() // group_docs))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    names = [*PIECES, *PLACES, *(["ids"] if with_ids else [])]
    # A task packs one group after another where there are more groups than partitions.
    dealt_out = pieces.withColumn("group", dealt).repartitionById(min(groups, width(docs.sparkSession)), "group")
    ordered = dealt_out.sortWithinPartitions("group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    return ordered.mapInArrow(_pack(length, names), f"{fields}, sequence_id bigint, offset bigint{extra}")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves: ``sequence_id, ids`` of `pack` with ids, one row per sequence."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))

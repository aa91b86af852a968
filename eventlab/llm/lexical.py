"""Ranked lexical search by Block-Max MaxScore over an inverted index in segments.

A task cuts its documents into segments of bounded text and inverts each: one row per segment and bucket of
terms, with the lists of those terms as blocks of gaps and counts in one, two or four bytes. A block
has its last document and its largest impact, which is exact as the corpus totals are counted first. A row of
bucket -1 has the segment's documents, by ascending id.

A search sends the lists of the asked terms to their segment. There every item is answered in windows of
documents. Lists whose bounds together cannot pass the tenth best score so far are non-essential: they
bring no candidates. Candidates of the other lists are looked up in them only while their score, the
largest impact of the block that would hold them and the bounds of the lists left could still pass; blocks that no
such candidate needs are never decoded. The best of all segments are merged by a limited window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blobs import expand, squeeze, width
from .tables import small_batches, stored
from .textblocks import Block, prefix_hash, span_hash, spans, take_spans, text_blocks

#: Text of a segment; a longer text is a segment of its own.
SEGMENT_BYTES = 8 << 20
BLOCK_POSTINGS = 128
WINDOW = 1024
BUCKET_BITS = 8
#: Distinct terms of the items that are answered together; their index entries and weights travel with the tasks.
TERMS_AT_ONCE = 1 << 16

#: Fixed values of the scoring rule.
SCALE, TF_PART, LENGTH_PART, BASE_LENGTH, LENGTH_SHARE = 1_000_000_000, 1000, 8, 10, 90

_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

INDEX = "segment bigint, bucket int, n int, m int, terms binary, dfs binary, last binary, peak binary, kind binary, data binary"
_NAMES = [f.split()[0] for f in INDEX.split(", ")]


def term_spans(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term of a block, A to Z in lower case."""
    data = block.data + np.where((block.data >= 0x41) & (block.data <= 0x5A), np.uint8(32), np.uint8(0))
    starts, ends, rows = spans(_TERM_BYTE[block.data], block.offsets)
    return span_hash(prefix_hash(data), starts, ends), rows


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def corpus_totals(docs: DataFrame) -> tuple[int, int]:
    """Number of documents with a term, and of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, terms = 0, 0
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                _, _, rows = spans(_TERM_BYTE[block.data], block.offsets)
                docs, terms = docs + len(_runs(rows)) if len(rows) else docs, terms + len(rows)
        yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "terms": pa.array([terms], pa.int64())})

    counted = small_batches(docs).select(F.col("text").cast("string")).mapInArrow(run, "docs bigint, terms bigint")
    total = counted.agg(F.sum("docs"), F.sum("terms")).first()
    return int(total[0] or 0), int(total[1] or 0)


def length_norm(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n.astype(np.int64) * docs) // max(terms, 1)


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return SCALE * tf // (TF_PART * tf + LENGTH_PART * norm)


def _bytes_needed(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


def _write(out: np.ndarray, values: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, at: np.ndarray, wide: np.ndarray) -> None:
    """The values of each block from byte ``at`` on, each in ``wide`` bytes of its block."""
    inside = np.arange(len(values)) - np.repeat(blocks, sizes)
    of = np.repeat(wide, sizes)
    first = np.repeat(at, sizes) + inside * of
    for k in range(4):
        has = of > k
        out[first[has] + k] = (values[has] >> (8 * k)) & 255


def invert(segment: int, ids: list, lengths: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, totals: tuple[int, int]) -> Iterator[tuple]:
    """The index rows of a segment; ``doc`` counts its documents in the order of ``ids``."""
    known = np.array([i is not None for i in ids], bool)
    numbers = np.array([i if i is not None else 0 for i in ids], np.int64)
    by_id = np.lexsort((numbers, ~known))
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    norm = length_norm(lengths, *totals)[by_id]
    yield (segment, -1, len(ids), 0, squeeze(numbers[by_id]), squeeze(known[by_id]), squeeze(norm), b"", b"", b"")
    if not len(term):
        return
    doc = place[doc]
    order = np.lexsort((doc, term))
    term, doc, tf = term[order], doc[order], tf[order].astype(np.int64)
    lists = _runs(term)
    df = np.diff(np.r_[lists, len(term)])
    blocks_of = -(-df // BLOCK_POSTINGS)
    blocks = take_spans(np.zeros(len(lists), np.int64), blocks_of) * BLOCK_POSTINGS + np.repeat(lists, blocks_of)
    sizes = np.diff(np.r_[blocks, len(term)])
    gaps = np.diff(np.r_[0, doc])
    gaps[lists] = doc[lists] + 1
    peak = np.maximum.reduceat(impact(tf, norm[doc]), blocks)
    wide_gap, wide_tf = (_bytes_needed(np.maximum.reduceat(v, blocks)) for v in (gaps, tf))
    ends = np.cumsum(sizes * (wide_gap + wide_tf))
    starts = ends - sizes * (wide_gap + wide_tf)
    data = np.zeros(int(ends[-1]), np.uint8)
    _write(data, gaps, blocks, sizes, starts, wide_gap)
    _write(data, tf, blocks, sizes, starts + sizes * wide_gap, wide_tf)
    last, kind = doc[blocks + sizes - 1], (wide_gap * 16 + wide_tf).astype(np.uint8)

    names = term[lists]
    buckets = (names >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cuts = np.r_[_runs(buckets), len(names)]
    block_cuts = np.r_[0, np.cumsum(blocks_of)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        p, q = int(block_cuts[a]), int(block_cuts[b])
        own = data[starts[p] : ends[q - 1]]
        yield (segment, int(buckets[a]), int(b - a), q - p, squeeze(names[a:b]), squeeze(df[a:b].astype(np.int32)), squeeze(last[p:q].astype(np.int32)), squeeze(peak[p:q].astype(np.int32)), squeeze(kind[p:q]), squeeze(own))


def build_index(docs: DataFrame, totals: tuple[int, int], segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The inverted index of all terms of all documents, to be stored. A missing text has no terms.

    ``totals`` are those of `corpus_totals`. The documents stay in the task that reads them.
    """

    def table(found: Iterable[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        parts: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            lengths, term, doc, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
            return table(invert(number, ids, lengths, term, doc, tf, totals))

        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            for block in text_blocks(batch.column("text")):
                hashes, rows = term_spans(block)
                order = np.lexsort((hashes, rows))
                hashes, rows = hashes[order], rows[order]
                first = _runs(rows, hashes) if len(rows) else np.zeros(0, np.int64)
                tf = np.diff(np.r_[first, len(rows)])
                parts.append((np.bincount(rows, minlength=len(block)), hashes[first], rows[first] + len(ids), tf))
                ids += own[block.first : block.last]
                size += len(block.data)
                if size >= segment_bytes:
                    yield close()
                    number, ids, parts, size = number + 1, [], [], 0
        if ids:
            yield close()

    slim = small_batches(docs).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return slim.mapInArrow(run, INDEX)


@dataclass
class Lists:
    """The asked lists of one segment."""

    numbers: np.ndarray
    known: np.ndarray
    norm: np.ndarray
    lists: dict[int, tuple] = field(default_factory=dict)
    decoded: dict[tuple[int, int], tuple] = field(default_factory=dict)

    def block(self, term: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block; kept, as items share common terms."""
        found = self.decoded.get((term, b))
        if found is None:
            last, _, kind, sizes, starts, data = self.lists[term]
            n, at, wide_gap, wide_tf = int(sizes[b]), int(starts[b]), int(kind[b]) >> 4, int(kind[b]) & 15
            gaps = np.frombuffer(data, f"<u{wide_gap}", n, at).astype(np.int64)
            tf = np.frombuffer(data, f"<u{wide_tf}", n, at + n * wide_gap).astype(np.int64)
            docs = np.cumsum(gaps) + (int(last[b - 1]) if b else -1)
            found = self.decoded[term, b] = docs, impact(tf, self.norm[docs])
        return found


def read_lists(rows: list[dict]) -> Lists:
    """The lists of a segment's rows, as `pick` leaves them."""
    about = next(r for r in rows if r["bucket"] < 0)
    n = about["n"]
    out = Lists(expand(about["terms"], "i8", n), expand(about["dfs"], "?", n), expand(about["last"], "i8", n))
    for r in rows:
        if r["bucket"] < 0:
            continue
        terms, df = expand(r["terms"], "u8", r["n"]), expand(r["dfs"], "i4", r["n"]).astype(np.int64)
        last, peak, kind = expand(r["last"], "i4", r["m"]), expand(r["peak"], "i4", r["m"]).astype(np.int64), expand(r["kind"], "u1", r["m"])
        sizes, starts, blocks = _block_places(df, kind)
        data = pa.decompress(r["data"], decompressed_size=int(starts[-1]), codec="zstd", asbytes=True)
        for i, term in enumerate(terms.tolist()):
            a, b = int(blocks[i]), int(blocks[i + 1])
            out.lists[term] = last[a:b], peak[a:b], kind[a:b], sizes[a:b], starts[a:b], data
    return out


def _block_places(df: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the blocks, their first bytes (and the end of the last), and each list's first block."""
    blocks = np.r_[0, np.cumsum(-(-df // BLOCK_POSTINGS))]
    sizes = np.full(len(kind), BLOCK_POSTINGS, np.int64)
    sizes[blocks[1:] - 1] = df - (np.diff(blocks) - 1) * BLOCK_POSTINGS
    ends = np.cumsum(sizes * ((kind >> 4).astype(np.int64) + (kind & 15)))
    return sizes, np.r_[0, ends], blocks


def pick(index: DataFrame, asked: np.ndarray) -> DataFrame:
    """The index rows with only the asked terms, which are sorted."""
    buckets = sorted({-1, *(int(x) for x in np.unique(asked >> np.uint64(64 - BUCKET_BITS)))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["bucket"] >= 0:
                    terms = expand(r["terms"], "u8", r["n"])
                    at = np.searchsorted(asked, terms)
                    wanted = np.flatnonzero(asked[np.minimum(at, len(asked) - 1)] == terms)
                    if not len(wanted):
                        continue
                    df, kind = expand(r["dfs"], "i4", r["n"]).astype(np.int64), expand(r["kind"], "u1", r["m"])
                    _, starts, blocks = _block_places(df, kind)
                    data = np.frombuffer(pa.decompress(r["data"], decompressed_size=int(starts[-1]), codec="zstd", asbytes=True), np.uint8)
                    a, b = blocks[wanted], blocks[wanted + 1]
                    own, bytes_ = take_spans(a, b - a), take_spans(starts[a], starts[b] - starts[a])
                    r |= {"n": len(wanted), "m": len(own), "terms": squeeze(terms[wanted]), "dfs": squeeze(df[wanted].astype(np.int32)), "kind": squeeze(kind[own]), "data": squeeze(data[bytes_])}
                    r |= {c: squeeze(expand(r[c], "i4", len(kind))[own]) for c in ("last", "peak")}
                out.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return index.where(F.col("bucket").isin(buckets)).mapInArrow(run, INDEX)


def document_counts(picked: DataFrame) -> dict[int, int]:
    """How many documents hold each asked term. One entry per term, so as bounded as the terms are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] >= 0:
                    for t, n in zip(expand(r["terms"], "i8", r["n"]).tolist(), expand(r["dfs"], "i4", r["n"]).tolist(), strict=True):
                        total[t] = total.get(t, 0) + n
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.int64()), "df": pa.array(list(total.values()), pa.int64())})

    counted = picked.select("bucket", "n", "terms", "dfs").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {int(np.int64(r["term"]).view(np.uint64)): r["df"] for r in counted.collect()}


def best_documents(held: Lists, query: list[tuple[int, int]], top: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of a segment's best documents for terms with weights; equal scores by place."""
    present = [(w * int(held.lists[t][1].max()), w, t) for t, w in query if t in held.lists]
    present = sorted(x for x in present if x[0] > 0)
    bounds = np.cumsum([x[0] for x in present])
    places, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for start in range(0, len(held.norm), window):
        first = int(np.searchsorted(bounds, least, "right"))  # lists before it cannot pass by themselves
        if first == len(present):
            break
        total = np.zeros(window, np.int64)
        for _, w, t in present[first:]:
            last = held.lists[t][0]
            for b in range(int(np.searchsorted(last, start)), len(last)):
                docs, value = held.block(t, b)
                a, z = np.searchsorted(docs, (start, start + window))
                total[docs[a:z] - start] += w * value[a:z]
                if last[b] >= start + window - 1:
                    break
        found = np.flatnonzero(total)
        score = total[found]
        found = found + start
        for j in range(first - 1, -1, -1):
            _, w, t = present[j]
            last, peak = held.lists[t][:2]
            alive = score + bounds[j] > least
            found, score = found[alive], score[alive]
            block = np.searchsorted(last, found)
            most = np.where(block < len(last), w * peak[np.minimum(block, len(last) - 1)], 0)
            alive = score + most + (bounds[j - 1] if j else 0) > least
            found, score, block = found[alive], score[alive], block[alive]
            if not len(found):
                break
            for b in np.unique(block[block < len(last)]).tolist():
                docs, value = held.block(t, b)
                mine = np.flatnonzero(block == b)
                at = np.minimum(np.searchsorted(docs, found[mine]), len(docs) - 1)
                hit = docs[at] == found[mine]
                score[mine[hit]] += w * value[at[hit]]
        places, scores = np.r_[places, found], np.r_[scores, score]
        order = np.lexsort((places, -scores))[:top]
        places, scores = places[order], scores[order]
        least = int(scores[-1]) if len(scores) == top else 0
    positive = scores > 0
    return places[positive], scores[positive]


def _answer(queries: list[list[tuple[int, int]]], top: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        held = read_lists(table.to_pylist())
        item, docs, known, score = [], [], [], []
        for i, query in enumerate(queries):
            places, scores = best_documents(held, query, top)
            item += [i] * len(places)
            docs += held.numbers[places].tolist()
            known += held.known[places].tolist()
            score += scores.tolist()
        doc_ids = [d if k else None for d, k in zip(docs, known, strict=True)]
        return pa.table({"query": pa.array(item, pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def query_terms(queries: DataFrame) -> DataFrame:
    """``item_id`` and the distinct hashes of each item's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                hashes, rows = term_spans(block)
                own = [np.unique(hashes[rows == i]).view(np.int64) for i in range(len(block))]
                ids = batch.column("item_id").slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.list_(pa.int64()))], names=["item_id", "terms"])

    slim = small_batches(queries).select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "item_id bigint, terms array<bigint>")


def _in_blocks(queries: DataFrame, terms_at_once: int) -> Iterator[list[tuple]]:
    """The items, a bounded number of terms at a time."""
    block: list[tuple] = []
    size = 0
    for row in query_terms(queries).toLocalIterator():
        terms = np.array(row["terms"], np.int64).view(np.uint64).tolist()
        if block and size + len(terms) > terms_at_once:
            yield block
            block, size = [], 0
        if terms:
            block.append((row["item_id"], terms))
            size += len(terms)
    if block:
        yield block


def search(
    index: DataFrame, totals: tuple[int, int], queries: DataFrame, top: int = 10, terms_at_once: int = TERMS_AT_ONCE
) -> DataFrame | None:
    """Each item's best documents ``(item_id, rank, doc_id, score)`` with a score above 0, or None without any term to ask.

    Items are answered in blocks of a bounded number of terms. Items that share an id are answered one by
    one. Equal scores go by ascending ``doc_id``, null last.
    """
    parts = []
    for block in _in_blocks(queries, terms_at_once):
        asked = np.unique(np.array([t for _, terms in block for t in terms], np.uint64))
        picked = stored(pick(index, asked), "lists")
        df = document_counts(picked)
        weight = {t: math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * n + 1))) for t, n in df.items()}
        weighted = [[(t, weight[t]) for t in terms if weight.get(t, 0) > 0] for _, terms in block]
        spark = index.sparkSession
        spread = picked.repartition(width(spark), "segment")
        found = spread.groupBy("segment").applyInArrow(_answer(weighted, top), "query int, doc_id bigint, score bigint")
        order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "query int, item_id bigint")
        parts.append(best.join(ids, "query").select("item_id", "rank", "doc_id", "score"))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def rank_documents(docs: DataFrame, queries: DataFrame, top: int = 10, segment_bytes: int = SEGMENT_BYTES, terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """Indexes the documents and returns each item's best ones: ``item_id, rank, doc_id, score``.

    Null, empty and wordless texts have no terms, so they are never found, and such items find nothing. Repeated
    documents are ranked each; other columns are ignored. Terms are compared by 64-bit hashes.
    """
    totals = corpus_totals(docs)
    index = stored(build_index(docs, totals, segment_bytes), "index")
    found = search(index, totals, queries, top, terms_at_once)
    return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if found is None else found

"""Repeated byte strings across documents, by a depth-limited radix sort of suffixes.

A byte is removed if a string of ``depth`` bytes covers it that also starts in a document
with a smaller id. Two suffixes share such a string if they are equal through ``depth``
bytes, so suffixes are sorted only that far, digit by digit from the front, and a group is
dropped as soon as it has one document left. Groups equal after the last digit are exactly
the repeated strings. Three kinds of passes keep this small:

1. The first digit is a key of `KEY` bytes. Not every suffix is sorted by it: of each run of
   ``depth`` bytes only the one with the smallest key hash (its anchor) is. Equal strings
   choose the same anchor, so a string can only repeat where an anchor does. Anchors of one
   document alone are dropped, which ends most of the work.
2. The second digit is the anchor's context, all bytes that any string with this anchor can
   cover. If a smaller document has the same context, the whole context is removed, and
   nothing else must be known about it. A group of thousands of copies ends here; each task
   has already merged its own occurrences, so a hot passage sends a few entries per task.
3. What is left are the smallest documents of different contexts around one key. All
   strings of ``depth`` bytes in these contexts are sorted by their actual bytes, eight at
   a time. A key with more than `HOT` contexts is dealt out by string instead of by key.

Passes 1 and 2 compare hashes of 40 and 48 bits within the bits that the partition adds.
A collision in pass 1 only adds work; pass 2 needs one in both.

Tables travel as packed arrays (`blobs`). Texts are shuffled once, by group of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .tables import small_batches
from .textblocks import BASE, BYTE_CODE, Block, mix, powers, prefix_hash, span_hash, text_blocks

KEY = 20
DEPTH = 50
HOT = 1000
#: Entries that a task merges before it sends them.
FLUSH = 500_000
#: Strings of hot keys that are hashed at one go.
DEALT = 20_000
#: Stands for a missing id, which is larger than any other.
LAST_ID = (1 << 63) - 1

_PLACE = np.uint64((1 << 26) - 1)
ANCHORS = {"key": "V5", "context": "V6", "doc": "i8", "tag": "u4", "pos": "u4", "done": "u1"}
REPLIES = {"doc": "i8", "tag": "u4", "pos": "u4", "kind": "u1"}
CONTEXTS = {"key": "u8", "bytes": "", "left": "u1", "right": "u1", "only": "i1", "doc": "i8", "tag": "u4", "pos": "u4", "done": "u1"}
HITS = {"doc": "i8", "tag": "u4", "pos": "u4", "mask": "u8", "done": "u1"}
COVERED, COMPARE, DEAL = 0, 1, 2


def _short(values: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of 64-bit numbers, as void values that sort and compare."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :size]).view(f"V{size}").ravel()


def _wide(values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(values), 8), np.uint8)
    out[:, :size] = values.view(np.uint8).reshape(-1, size)
    return out.view(np.uint64).ravel()


def _smallest(values: np.ndarray, window: int) -> np.ndarray:
    """Smallest value of every run of ``window`` values."""
    have = 1
    while have * 2 <= window:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = window - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(block: Block, sums: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, rows and key hashes of the anchors of all strings of ``depth`` bytes."""
    n, reach = len(block.data), depth - KEY + 1
    long = block.lengths >= depth
    if not long.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(n - KEY + 1)
    hashes = span_hash(sums, starts, starts + KEY)
    # A place shares a number with its hash, so longer blocks go by runs that count from their own start.
    step, found = int(_PLACE) + 2 - reach, []
    for first in range(0, max(len(hashes) - reach + 1, 1), step):
        run = hashes[first : first + step + reach - 1]
        least = _smallest((run & ~_PLACE) | np.arange(len(run), dtype=np.uint64), reach)
        found.append((least & _PLACE).astype(np.int64) + first)
    chosen = np.concatenate(found)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, block.offsets[:-1][long], 1)
    np.add.at(edge, block.offsets[1:][long] - depth + 1, -1)
    at = chosen[np.cumsum(edge)[: len(chosen)] > 0]
    at = at[np.r_[True, at[1:] != at[:-1]]]
    rows = np.searchsorted(block.offsets, at, "right") - 1
    return at, rows, hashes[at]


def text_tags(block: Block, sums: np.ndarray) -> np.ndarray:
    """32 bits of every text's hash; they tell texts apart that share a document id."""
    return (span_hash(sums, block.offsets[:-1], block.offsets[1:]) >> np.uint64(32)).astype(np.uint32)


def _find_anchors(width: int, depth: int) -> Callable:
    reach = depth - KEY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            key, context, doc, tag, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            both = key ^ mix(context)
            order = np.argsort(both, kind="stable")
            same = both[order]
            first = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
            least = np.minimum.reduceat(doc[order], first)
            covered = np.empty(len(key), bool)
            covered[order] = doc[order] > np.repeat(least, np.diff(np.r_[first, len(same)]))
            parts = (key >> np.uint64(40)) % np.uint64(width)
            # Covered entries know their fate; they go along to be sent back with the others.
            parts = np.where(covered, blobs.group_of_ids(doc, width), parts.astype(np.int64))
            columns = {"key": _short(key, 5), "context": _short(context, 6), "doc": doc, "tag": tag, "pos": pos, "done": covered}
            zero = np.zeros(1, np.uint64)
            columns["key"][covered] = _short(zero, 5)[0]
            columns["context"][covered] = _short(zero, 6)[0]
            return blobs.pack(parts, columns, ANCHORS)

        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for block in text_blocks(batch.column("text")):
                sums = prefix_hash(block.data)
                at, rows, key = anchors(block, sums, depth)
                if not len(at):
                    continue
                start = np.maximum(at - reach, block.offsets[rows])
                end = np.minimum(at + depth, block.offsets[rows + 1])
                context = mix(span_hash(sums, start, end) + (at - start).astype(np.uint64), 1)
                pos = (at - block.offsets[rows]).astype(np.uint32)
                held.append((key, context, ids[block.first + rows], text_tags(block, sums)[rows], pos))
                count += len(at)
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return run


def _group_anchors(groups: int, hot: int) -> Callable:
    """Pass 1 and 2 in the partition of the key: what is left of every anchor, sent to its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = blobs.gather(batches, ANCHORS)
        done = found["done"].astype(bool)
        doc, tag, pos = (found[x][~done] for x in ("doc", "tag", "pos"))
        key, context = _wide(found["key"][~done], 5), _wide(found["context"][~done], 6)
        kind = np.zeros(len(doc), np.uint8)
        keep = np.zeros(len(doc), bool)
        if len(doc):
            order = np.lexsort((doc, context, key))
            k, c, d = key[order], context[order], doc[order]
            new_key = np.r_[True, k[1:] != k[:-1]]
            new = new_key | np.r_[True, c[1:] != c[:-1]]
            least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            of_key = np.cumsum(new_key) - 1
            contexts = np.bincount(of_key, new)[of_key]
            covered = d > least
            compare = ~covered & (contexts > 1)
            # A key of one document only needs nothing, however many contexts it has there.
            first = np.flatnonzero(new_key)
            several = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first))[of_key]
            keep[order] = covered | (compare & several)
            kind[order] = np.where(covered, COVERED, np.where(contexts > hot, DEAL, COMPARE))
        back = {
            "doc": np.r_[doc[keep], found["doc"][done]],
            "tag": np.r_[tag[keep], found["tag"][done]],
            "pos": np.r_[pos[keep], found["pos"][done]],
            "kind": np.r_[kind[keep], np.full(int(done.sum()), COVERED, np.uint8)],
        }
        if len(back["doc"]):
            yield blobs.pack(blobs.group_of_ids(back["doc"], groups), back, REPLIES)

    return run


def _by_document(found: dict[str, np.ndarray]) -> Callable[[int, int], slice | np.ndarray]:
    """Looks up the entries of a document and text."""
    order = np.lexsort((found["pos"], found["tag"], found["doc"]))
    doc, tag = found["doc"][order], found["tag"][order]

    def entries(one: int, its_tag: int) -> np.ndarray:
        a, b = np.searchsorted(doc, one, "left"), np.searchsorted(doc, one, "right")
        c, d = np.searchsorted(tag[a:b], its_tag, "left"), np.searchsorted(tag[a:b], its_tag, "right")
        return order[a + c : a + d]

    return entries


def _string_keys(contexts: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Hashes of the string that starts at a place of each context."""
    string = np.take_along_axis(contexts, starts[:, None] + np.arange(depth), 1)
    with np.errstate(over="ignore"):
        return mix((BYTE_CODE[string] * powers(BASE, depth)).sum(1, dtype=np.uint64), 3)


def _cut_contexts(width: int, depth: int) -> Callable:
    """For every document: the contexts that must be compared, and those already covered."""
    reach, fields = depth - KEY, _context_fields(depth)
    size = depth + reach

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        none = pa.Table.from_batches([], schema=blobs.arrow_schema(fields))
        if not replies.num_rows or not texts.num_rows:
            return none
        found = blobs.unpack(replies, REPLIES)
        entries = _by_document(found)
        out: dict[str, list] = {name: [] for name in fields}

        def add(**columns: np.ndarray) -> None:
            for name, values in columns.items():
                out[name].append(values)

        for batch in texts.to_batches():
            ids = batch.column("doc").to_numpy()
            for block in text_blocks(batch.column("text")):
                tags = text_tags(block, prefix_hash(block.data))
                for row in range(len(block)):
                    one, tag = ids[block.first + row], tags[row]
                    mine = entries(one, tag)
                    if not len(mine):
                        continue
                    kind, pos = found["kind"][mine], found["pos"][mine].astype(np.int64)
                    n = int(block.offsets[row + 1] - block.offsets[row])
                    left, right = np.minimum(pos, reach), np.minimum(n - pos - KEY, reach)
                    text = block.data[block.offsets[row] : block.offsets[row + 1]]
                    window = pos[:, None] + np.arange(-reach, depth)
                    cut = np.where((window >= 0) & (window < n), text[np.clip(window, 0, n - 1)], 0).astype(np.uint8)
                    code = powers(BASE, KEY)
                    with np.errstate(over="ignore"):
                        key = mix((BYTE_CODE[cut[:, reach : reach + KEY]] * code).sum(1, dtype=np.uint64))
                    cut[kind == COVERED] = 0
                    deal = np.flatnonzero(kind == DEAL)
                    pick = np.flatnonzero(kind != DEAL)
                    only = np.full(len(pick), -1, np.int8)
                    if len(deal):
                        offset = np.tile(np.arange(reach + 1), len(deal))
                        deal = np.repeat(deal, reach + 1)
                        valid = (offset <= left[deal]) & (reach - offset <= right[deal])
                        deal, offset = deal[valid], offset[valid]
                        own = np.concatenate([_string_keys(cut[deal[i : i + DEALT]], reach - offset[i : i + DEALT], depth) for i in range(0, max(len(deal), 1), DEALT)])
                        key = np.r_[key[pick], own]
                        pick = np.r_[pick, deal]
                        only = np.r_[only, offset.astype(np.int8)]
                    k = len(pick)
                    add(key=key, bytes=np.ascontiguousarray(cut[pick]).view(f"V{size}").ravel(), only=only, done=kind[pick] == COVERED)
                    add(left=left[pick], right=right[pick], doc=np.full(k, one), tag=np.full(k, tag), pos=pos[pick])
        if not out["key"]:
            return none
        columns = {name: np.concatenate(values) for name, values in out.items()}
        parts = (columns["key"] >> np.uint64(8)) % np.uint64(width)
        return pa.Table.from_batches([blobs.pack(parts.astype(np.int64), columns, fields)])

    return run


def _context_fields(depth: int) -> dict[str, str]:
    return {**CONTEXTS, "bytes": f"V{2 * depth - KEY}"}


def radix_groups(key: np.ndarray, strings: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings within their keys, most significant digit first, eight bytes a pass.

    Returns the places of strings that a smaller document also has, and for the tests the
    number of strings left after each pass. ``strings`` has a row of bytes for each.
    """
    n, depth = strings.shape
    digits = np.zeros((n, -(-depth // 8) * 8), np.uint8)
    digits[:, :depth] = strings
    digits = digits.view(">u8")
    at = np.arange(n)
    group = key
    left = []
    for digit in range(-1, digits.shape[1]):
        if digit >= 0:
            order = np.lexsort((digits[at, digit], group))
            at, group = at[order], group[order]
            d = digits[at, digit]
            new = np.r_[True, (group[1:] != group[:-1]) | (d[1:] != d[:-1])] if len(at) else np.zeros(0, bool)
        else:
            order = np.argsort(group, kind="stable")
            at, group = at[order], group[order]
            new = np.r_[True, group[1:] != group[:-1]] if len(at) else np.zeros(0, bool)
        if len(at):
            first = np.flatnonzero(new)
            d = doc[at]
            several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            group = np.cumsum(new) - 1
            keep = several[group]
            at, group = at[keep], group[keep]
        left.append(len(at))
    if not len(at):
        return at, np.array(left)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.minimum.reduceat(doc[at], first)
    repeated = doc[at] > np.repeat(least, np.diff(np.r_[first, len(at)]))
    return at[repeated], np.array(left)


def _compare(groups: int, depth: int) -> Callable:
    """Pass 3 in the partition of the key, or of the string for hot keys."""
    reach, fields = depth - KEY, _context_fields(depth)
    size = depth + reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = blobs.gather(batches, fields)
        n = len(found["key"])
        if not n:
            return
        done = found["done"].astype(bool)
        cut = found["bytes"].view(np.uint8).reshape(n, size)
        left, right, only = (found[x].astype(np.int64) for x in ("left", "right", "only"))
        mask = np.zeros(n, np.uint64)
        for offset in range(reach + 1):
            valid = ~done & (left >= offset) & (right >= reach - offset) & ((only < 0) | (only == offset))
            some = np.flatnonzero(valid)
            if len(some) < 2:
                continue
            at, _ = radix_groups(found["key"][some], cut[some, reach - offset : reach - offset + depth], found["doc"][some])
            mask[some[at]] |= np.uint64(1 << offset)
        hit = done | (mask > 0)
        if hit.any():
            columns = {name: found[name][hit] for name in ("doc", "tag", "pos", "done")} | {"mask": mask[hit]}
            yield blobs.pack(blobs.group_of_ids(columns["doc"], groups), columns, HITS)

    return run


def removed_mask(n: int, pos: np.ndarray, mask: np.ndarray, done: np.ndarray, depth: int) -> np.ndarray:
    """Marks the bytes of a text of n bytes that its hits cover."""
    edge = np.zeros(n + 1, np.int32)
    reach = depth - KEY
    pos = pos.astype(np.int64)
    done = done.astype(bool)
    np.add.at(edge, np.maximum(pos[done] - reach, 0), 1)
    np.add.at(edge, np.minimum(pos[done] + depth, n), -1)
    for offset in range(reach + 1):
        at = pos[~done & ((mask >> np.uint64(offset)) & np.uint64(1) > 0)] - offset
        np.add.at(edge, at, 1)
        np.add.at(edge, at + depth, -1)
    return np.cumsum(edge[:n]) > 0


def _apply(depth: int, finish: Callable, schema: pa.Schema) -> Callable:
    def run(texts: pa.Table, hits: pa.Table) -> pa.Table:
        found = blobs.unpack(hits, HITS)
        entries = _by_document(found)
        out = []
        for batch in texts.to_batches():
            ids = batch.column("doc").to_numpy()
            masks = []
            for block in text_blocks(batch.column("text")):
                tags = text_tags(block, prefix_hash(block.data))
                for row in range(len(block)):
                    mine = entries(ids[block.first + row], tags[row])
                    text = block.data[block.offsets[row] : block.offsets[row + 1]]
                    gone = None
                    if len(mine):
                        gone = removed_mask(len(text), found["pos"][mine], found["mask"][mine], found["done"][mine], depth)
                    masks.append((text, gone))
            out.append(finish(batch, masks))
        return pa.Table.from_batches(out, schema=schema)

    return run


def _digest(batch: pa.RecordBatch, masks: list[tuple]) -> pa.RecordBatch:
    removed, runs, digests = [], [], []
    for text, gone in masks:
        if gone is None:
            removed.append(0)
            runs.append(0)
            digests.append(hashlib.sha256(text).hexdigest())
        else:
            removed.append(int(gone.sum()))
            runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            digests.append(hashlib.sha256(text[~gone]).hexdigest())
    sizes = [len(text) for text, _ in masks]
    columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=DIGEST)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Shrinks removed runs so that no character is cut: a character goes if all its bytes go."""
    lead = (data & 0xC0) != 0x80
    of = np.cumsum(lead) - 1
    first = np.flatnonzero(lead)
    if not len(first):
        return gone
    return np.minimum.reduceat(gone, first)[np.maximum(of, 0)]


def _texts(batch: pa.RecordBatch, masks: list[tuple]) -> pa.RecordBatch:
    kept, removed = [], []
    for text, gone in masks:
        if gone is not None:
            gone = whole_characters(text, gone)
        kept.append((text if gone is None else text[~gone]).tobytes().decode("utf-8", "replace"))
        removed.append(0 if gone is None else int(gone.sum()))
    missing = batch.column("text").is_null().to_pylist()
    kept = [None if m else x for x, m in zip(kept, missing, strict=True)]
    names = [x for x in batch.schema.names if x.startswith("row_") or x == "doc_id"]
    columns = [*(batch.column(x) for x in names), pa.array(kept, pa.string()), pa.array(removed, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "kept_text", "n_removed"])


def _hits(docs: DataFrame, depth: int, hot: int, extra: list) -> tuple:
    """The texts grouped by id, and the strings to remove, in the same groups."""
    if depth <= KEY or depth - KEY >= 64:
        raise ValueError(f"depth must be above {KEY} and below {KEY + 64}")
    spark = docs.sparkSession
    width = blobs.width(spark)
    groups = width * blobs.GROUPS
    doc = F.coalesce("doc_id", F.lit(LAST_ID))
    rows = small_batches(docs).select(F.col("doc_id").cast("bigint"), doc.cast("bigint").alias("doc"), F.col("text").cast("string"), *extra)
    found = rows.select("doc", "text").mapInArrow(_find_anchors(width, depth), blobs.schema(ANCHORS))
    replies = blobs.send(found).mapInArrow(_group_anchors(groups, hot), blobs.schema(REPLIES))
    texts = rows.withColumn("part", blobs.group_of(F.col("doc"), groups)).groupBy("part")
    cut = texts.cogroup(replies.groupBy("part")).applyInArrow(_cut_contexts(width, depth), blobs.schema(_context_fields(depth)))
    hits = blobs.send(cut).mapInArrow(_compare(groups, depth), blobs.schema(HITS))
    return texts, hits.groupBy("part")


def removed_spans(docs: DataFrame, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A missing text is empty, a missing id larger than any other. Rows that share an id do not
    remove anything from each other. Other columns are ignored.
    """
    texts, hits = _hits(docs, depth, hot, [])
    run = _apply(depth, _digest, DIGEST)
    return texts.cogroup(hits).applyInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """The documents with repeated strings cut out of ``text``, all other columns as they are.

    Cuts never split a character. A missing text stays missing; a text that repeats as a whole
    becomes empty. Columns that start with ``row_`` are fine: the others are carried in one struct.
    """
    others = [c for c in docs.columns if c != "text"]
    carried = F.to_json(F.struct(*[F.lit(1).alias("_")])) if not others else F.struct(*[F.col(f"`{c}`") for c in others])
    texts, hits = _hits(docs, depth, hot, [carried.alias("row_others")])
    kind = docs.select(carried.alias("row_others")).schema["row_others"].dataType.simpleString()
    cut = texts.cogroup(hits).applyInArrow(_apply(depth, _texts, None), f"doc_id bigint, row_others {kind}, kept_text string, n_removed bigint")
    columns = [F.col("kept_text").alias("text") if c == "text" else F.col(f"row_others.`{c}`").alias(c) for c in docs.columns]
    return cut.select(*columns)

"""Quality by perplexity, under an interpolated modified Kneser-Ney model of bytes.

The model is trained on all trusted texts. An n-gram of `ORDER` bytes is a number of that many
bytes, so counts need no dictionary. Documents, packed and compressed, are dealt to groups; a
group sends its different n-grams once to the shards, which hold the model's counts and answer
with log probabilities. Shards are chosen by the two bytes before the last one, which all levels
above the second share, so one shard answers a whole n-gram. The two lowest levels have at most
256 * 256 entries, whatever the input, and travel with the code.

A document has the perplexity of its whole text, and for each length in `WINDOWS` that of its worst run
of so many bytes: a long text may hide a junk passage, or a single word that trusted texts never have.
It is kept if each of them is within a high quantile of its language. The quantiles are taken over
trusted documents that the model has not seen, one in `HELD_OUT`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .tables import join_groups, small_batches, stored
from .textblocks import take_spans, text_blocks

ORDER = 5
#: Lengths in bytes of the runs that are judged by themselves: a passage, and a word.
WINDOWS = (64, 8)
QUANTILE = 0.99
#: Log probabilities are added as whole multiples of 1 / `UNIT`, so that sums do not depend on the order.
UNIT = 1 << 20
#: Trusted documents that set the thresholds instead of training the model: one in so many.
HELD_OUT = 5
#: Discount where the counts that it is estimated from do not occur, and the least of all.
NO_COUNTS, LEAST_DISCOUNT = 0.5, 0.1
#: Accuracy of the quantiles: one in so many rows.
ACCURACY = 10_000
#: Bytes of texts whose n-grams are sorted at one go.
CHUNK = 1 << 20

TEXTS = pa.schema(
    [("part", pa.int32()), ("rows", pa.binary()), ("sizes", pa.binary()), ("n", pa.int32()), ("bytes", pa.int64()), ("text", pa.binary())]
)
COUNTS = {"key": "u8", "count": "i8"}
ASKED = {"key": "u8", "value": "f4"}


def ngrams(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The n-gram that ends at every byte; before a text stand zeros."""
    pad = ORDER - 1
    starts = np.cumsum(sizes + pad) - sizes
    padded = np.zeros(len(data) + pad * len(sizes), np.uint8)
    at = take_spans(starts, sizes)
    padded[at] = data
    key = np.zeros(len(data), np.uint64)
    for i in range(pad, -1, -1):
        key = (key << np.uint64(8)) | padded[at - i]
    return key


def shard_of(keys: np.ndarray, width: int) -> np.ndarray:
    """By the two bytes before the last."""
    return blobs.group_of_ids(((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64) + 1, width)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _pack_texts(groups: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            part = blobs.group_of_ids(doc, groups)
            for block in text_blocks(batch.column("text"), 16 << 20):
                own = part[block.first : block.last]
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
                for mine in np.split(order, first[1:]):
                    sizes = block.lengths[mine]
                    text = block.data[take_spans(block.offsets[:-1][mine], sizes)]
                    codec = pa.Codec("zstd", compression_level=5)
                    at = block.first + mine
                    columns = [[int(own[mine[0]])], [blobs.squeeze(np.stack([doc[at], row[at]]))], [blobs.squeeze(sizes)], [len(mine)], [len(text)]]
                    columns.append([codec.compress(text.tobytes(), asbytes=True)])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TEXTS, strict=True)], schema=TEXTS)

    return run


def _unpack(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, row numbers, sizes and bytes of runs of texts of about `CHUNK` bytes."""
    for r in table.to_pylist():
        ids = blobs.expand(r["rows"], "i8", 2 * r["n"]).reshape(2, -1)
        sizes = blobs.expand(r["sizes"], "i8", r["n"])
        data = pa.decompress(r["text"], decompressed_size=r["bytes"], codec="zstd", asbytes=True) if r["bytes"] else b""
        data, ends = np.frombuffer(data, np.uint8), np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            before = int(ends[first] - sizes[first])
            last = max(first + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
            yield ids[0, first:last], ids[1, first:last], sizes[first:last], data[before : int(ends[last - 1])]
            first = last


def _train(width: int) -> Callable:
    """N-gram counts of the trusted documents of a group, to their shards."""

    def run(texts: pa.Table, trusted: pa.Table) -> pa.Table:
        good = np.unique(trusted.column("doc").to_numpy())
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for doc, _, sizes, data in _unpack(texts):
            here = np.isin(doc, good)
            if here.any():
                chosen = data[take_spans((np.cumsum(sizes) - sizes)[here], sizes[here])]
                found.append(counted(ngrams(chosen, sizes[here])))
        if not found:
            return pa.Table.from_batches([], schema=blobs.arrow_schema(COUNTS))
        key, count = merged(found)
        return pa.Table.from_batches([blobs.pack(shard_of(key, width), {"key": key, "count": count}, COUNTS)])

    return run


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, which, np.concatenate([c for _, c in found]))
    return key, count


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = blobs.gather(batches, COUNTS)
    if len(found["key"]):
        key, count = merged([(found["key"], found["count"])])
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(count)], names=["key", "c"])


def discounts(ones: int, twos: int, threes: int, fours: int) -> list[float]:
    """What a count of 1, 2, and 3 or more is lowered by, from how many n-grams have counts 1 to 4."""
    y = ones / (ones + 2 * twos) if ones else 0.0
    pairs = ((1, ones, twos), (2, twos, threes), (3, threes, fours))
    found = [k - (k + 1) * y * b / a if a else NO_COUNTS for k, a, b in pairs]
    # Something must stay for what was not seen, also where small counts are missing.
    return [min(max(d, LEAST_DISCOUNT), float(k)) for d, (k, _, _) in zip(found, pairs, strict=True)]


def train(counts: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """The model's entries above level 2 (``level, kind, key, value``), and those below as arrays.

    ``kind`` 0 is the discounted probability of an n-gram, 1 the weight that its context gives to the
    level below. Lower levels count the different bytes in front of an n-gram.
    """
    entries, low = None, {}
    level_counts = counts
    for level in range(ORDER, 0, -1):
        if level < ORDER:
            shorter = F.col("key").bitwiseAND(F.lit((1 << (8 * level)) - 1))
            level_counts = stored(level_counts.groupBy(shorter.alias("key")).agg(F.count("*").alias("c")), "counts")
        few = level_counts.agg(*[F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(1, 5)]).first()
        d = discounts(*[few[f"n{i}"] or 0 for i in range(1, 5)])
        c = F.col("c")
        lowered = F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        rows = level_counts.withColumn("context", F.shiftright("key", 8))
        contexts = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum(lowered).alias("taken"))
        terms = rows.join(contexts, "context").select("key", ((c - lowered) / F.col("total")).alias("value"))
        weights = contexts.select(F.col("context").alias("key"), (F.col("taken") / F.col("total")).alias("value"))
        if level > 2:
            both = terms.select(F.lit(level).alias("level"), F.lit(0).alias("kind"), "key", "value")
            both = both.union(weights.select(F.lit(level).alias("level"), F.lit(1).alias("kind"), "key", "value"))
            entries = both if entries is None else entries.union(both)
        else:
            # At most 256 ** level rows.
            for kind, table in (("a", terms), ("g", weights)):
                found = table.toArrow()
                filled = np.full(256**level if kind == "a" else 256 ** (level - 1), 0.0 if kind == "a" else 1.0)
                filled[found.column("key").to_numpy()] = found.column("value").to_numpy()
                low[f"{kind}{level}"] = filled
    return stored(entries, "model"), low


MODEL = {"key": "u8", "value": "f8"}


def _send_model(width: int) -> Callable:
    """Entries as numbers: level and kind above the bytes of the n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level, kind, key = (batch.column(c).to_numpy().astype(np.uint64) for c in ("level", "kind", "key"))
            # A context lacks the last byte; shifted, its last two bytes stand where shards look.
            place = np.where(kind == 1, key << np.uint64(8), key)
            tagged = key | (level << np.uint64(56)) | (kind << np.uint64(55))
            packed = blobs.pack(shard_of(place, width), {"key": tagged, "value": batch.column("value").to_numpy()}, MODEL)
            yield _with(packed, 0, -1)

    return run


def _with(batch: pa.RecordBatch, kind: int, group: int) -> pa.RecordBatch:
    n = batch.num_rows
    arrays = [*batch.columns, pa.array([kind] * n, pa.int32()), pa.array([group] * n, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "kind", "asker"])


def _ask(width: int) -> Callable:
    def run(texts: pa.Table) -> pa.Table:
        found = [counted(ngrams(data, sizes))[0] for _, _, sizes, data in _unpack(texts)]
        key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        packed = blobs.pack(shard_of(key, width), {"key": key, "value": np.zeros(len(key))}, MODEL)
        return pa.Table.from_batches([_with(packed, 1, texts.column("part")[0].as_py())])

    return run


def probabilities(key: np.ndarray, model: np.ndarray, value: np.ndarray, low: dict[str, np.ndarray]) -> np.ndarray:
    """Probability of the last byte of n-grams after the others; ``model`` is sorted."""

    def find(level: int, kind: int, part: np.ndarray, missing: float) -> np.ndarray:
        wanted = part | np.uint64((level << 56) | (kind << 55))
        at = np.minimum(np.searchsorted(model, wanted), max(len(model) - 1, 0))
        return np.where(model[at] == wanted, value[at], missing) if len(model) else np.full(len(part), missing)

    last, two = (key & np.uint64(0xFF)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.int64)
    p = low["a1"][last] + low["g1"][0] / 256
    p = low["a2"][two] + low["g2"][two >> 8] * p
    for level in range(3, ORDER + 1):
        own = key & np.uint64((1 << (8 * level)) - 1)
        p = find(level, 0, own, 0.0) + find(level, 1, own >> np.uint64(8), 1.0) * p
    return p


def _answer(low: dict[str, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict] = []
        model, value = np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            mine = batch.filter(pa.array(kinds == 0))
            if mine.num_rows:
                parts.append(blobs.unpack(mine, MODEL))
            asked = batch.filter(pa.array(kinds == 1))
            if asked.num_rows and parts:
                model, value = (np.concatenate([x[c] for x in parts] + [old]) for c, old in (("key", model), ("value", value)))
                order = np.argsort(model)
                model, value, parts = model[order], value[order], []
            for i in range(asked.num_rows):
                row = asked.slice(i, 1)
                key = blobs.unpack(row.select(["n", "key"]), {"key": "u8"})["key"]
                logs = np.log(np.maximum(probabilities(key, model, value, low), 1e-300))
                yield blobs.pack(np.full(len(key), row.column("asker")[0].as_py()), {"key": key, "value": logs}, ASKED)

    return run


SCORES = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("log_means", pa.list_(pa.float64()))])


def worst_runs(sums: np.ndarray, ends: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Smallest mean of a run of so many bytes in each text, or that of a whole shorter text.

    ``sums`` are running sums with a 0 in front; empty texts get 0.
    """
    starts = ends - sizes
    found = (sums[ends] - sums[starts]) / np.maximum(sizes, 1)
    long = np.flatnonzero(sizes > length)
    if len(long):
        runs = np.append(sums[length:] - sums[:-length], 0)
        edges = np.stack([starts[long], ends[long] - length + 1], axis=1).ravel()
        found[long] = np.minimum.reduceat(runs, edges)[::2] / length
    return found


def _score(windows: tuple[int, ...]) -> Callable:
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        found = blobs.unpack(answers, ASKED)
        order = np.argsort(found["key"])
        key, value = found["key"][order], np.rint(found["value"][order].astype(np.float64) * UNIT).astype(np.int64)
        out = []
        for doc, row, sizes, data in _unpack(texts):
            sums = np.zeros(len(data) + 1, np.int64)
            if len(data):
                np.cumsum(value[np.searchsorted(key, ngrams(data, sizes))], out=sums[1:])
            ends = np.cumsum(sizes)
            means = [(sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1), *(worst_runs(sums, ends, sizes, n) for n in windows)]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(means, axis=1).ravel() / UNIT), len(means))
            arrays = [*(pa.array(x) for x in (doc, row, sizes)), lists.cast(pa.list_(pa.float64()))]
            out.append(pa.RecordBatch.from_arrays(arrays, schema=SCORES))
        return pa.Table.from_batches(out, schema=SCORES)

    return run


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """``doc_id, lang, n_bytes, perplexity, threshold``, ``worst_N, worst_N_threshold`` for each window, ``kept``.

    One row per document. ``trusted`` has the ``doc_id`` of documents that the model learns from. The
    thresholds of a language (a missing one included) are the quantiles of its held-out trusted documents,
    or of all of these where it has none. ``worst_N`` is the highest perplexity of N bytes in a row, that of
    the whole text if it has no more. A document without text has no perplexity and is not kept; without
    held-out documents every document with text is kept. Perplexity is per byte, rounded to 6 places.
    """
    spark = docs.sparkSession
    width = blobs.width(spark)
    groups = width * blobs.GROUPS
    missing = F.lit((1 << 63) - 1)
    rows = small_batches(docs).select(
        F.coalesce(F.col("doc_id").cast("bigint"), missing).alias("doc"),
        F.xxhash64("lang", "text").alias("row"),
        F.col("lang").cast("string"),
        F.col("text").cast("string"),
    )
    packed = rows.select("doc", "row", "text").mapInArrow(_pack_texts(groups), "part int, rows binary, sizes binary, n int, bytes bigint, text binary")
    texts = packed.groupBy("part")
    good = trusted.select(F.col("doc_id").cast("bigint").alias("doc")).where("doc IS NOT NULL").distinct()
    good = good.withColumn("held_out", F.pmod(F.xxhash64(F.lit(3), "doc"), F.lit(HELD_OUT)) == 0)
    flagged = good.where("NOT held_out").select("doc").withColumn("part", blobs.group_of(F.col("doc"), groups))
    found = texts.cogroup(flagged.groupBy("part")).applyInArrow(_train(width), blobs.schema(COUNTS))
    counts = stored(blobs.send(found).mapInArrow(_sum_counts, "key bigint, c bigint"), "counts")
    model, low = train(counts)

    kinds = f"{blobs.schema(MODEL)}, kind int, asker int"
    asked = texts.applyInArrow(_ask(width), kinds).union(model.mapInArrow(_send_model(width), kinds))
    answers = blobs.send(asked).sortWithinPartitions("kind").mapInArrow(_answer(low), blobs.schema(ASKED))
    scored = texts.cogroup(answers.groupBy("part")).applyInArrow(_score(windows), "doc bigint, row bigint, n_bytes bigint, log_means array<double>")
    scores = stored(scored.distinct(), "scores")

    measures = ["perplexity", *(f"worst_{n}" for n in windows)]
    limit_of = {m: "threshold" if m == "perplexity" else f"{m}_threshold" for m in measures}
    values = [F.when(F.col("n_bytes") > 0, F.round(F.exp(-F.col("log_means")[i]), 6)).alias(m) for i, m in enumerate(measures)]
    names = rows.select("doc", "row", "lang")
    judged = names.join(scores, ["doc", "row"]).select("doc", "lang", "n_bytes", *values)
    judged = stored(judged.join(good, "doc", "left"), "judged")
    levels = {m: F.percentile_approx(F.when(F.col("held_out"), F.col(m)), quantile, ACCURACY) for m in measures}
    common = judged.agg(*[level.alias(m) for m, level in levels.items()], F.count("*").alias("docs")).first()
    own = [F.coalesce(level, F.lit(common[m]).cast("double")).alias(limit_of[m]) for m, level in levels.items()]
    limits = judged.groupBy("lang").agg(*own, F.count("*").alias("docs"))
    joined = join_groups(judged, limits, "lang", "docs", F.lit(max(1, common["docs"])))
    kept = F.col("perplexity").isNotNull()
    for m in measures:
        kept &= F.coalesce(F.col(m) <= F.col(limit_of[m]), F.lit(True))
    shown = [c for m in measures for c in (m, limit_of[m])]
    return joined.select(F.nullif(F.col("doc"), missing).alias("doc_id"), "lang", "n_bytes", *shown, kept.alias("kept"))

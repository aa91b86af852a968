"""Quality rules for documents, and what they say about whole hosts.

Every document is measured by itself. Failures of all rules are counted by host (the document's
source), and a host's failure rate is shrunk towards the other hosts by a beta prior that is fitted
to all hosts. A host whose shrunk rate lies above the upper end of that prior, or above
`MAX_HOST_RATE`, is distrusted, and its documents must also pass the stricter rules. On a trusted
host a document only goes if it breaks the base rules, or a stricter one by a wide margin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import free_name, join_groups, small_batches, stored, text_key
from .textblocks import Block, mix, prefix_hash, span_hash, spans, text_blocks, words

#: Fixed values of the rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Limits of the stricter rules: symbols per 100 word characters, repeated lines per 100 words.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 10
#: How many times over a stricter limit a document goes on a trusted host too.
WIDE_MARGIN = 2
#: Shrunk share of failing documents above which a host is distrusted, whatever the other hosts are like.
MAX_HOST_RATE = 0.1
#: A host is distrusted, too, if its rate is so many deviations of the prior above the prior's mean.
PRIOR_DEVIATIONS = 2

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _per_text(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _found_before(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks entries equal to another one of their row, and those equal to an earlier one."""
    key = hashes ^ mix(rows.astype(np.uint64), 5)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, before


def measure(block: Block) -> dict[str, np.ndarray]:
    """The metrics of every text of a block."""
    n, data, offsets = len(block), block.data, block.offsets
    starts, ends, rows = words(block)
    sums = prefix_hash(data)
    count = np.bincount(rows, minlength=n)

    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends[:-1] if len(ends) and ends[-1] == len(data) else ends] -= 1
    in_word = np.cumsum(inside[: len(data)], dtype=np.int8).astype(bool)
    chars = _per_text(in_word & ((data & 0xC0) != 0x80), offsets)

    line_start, line_end, line_row = spans(data != 10, offsets)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    _, earlier = _found_before(span_hash(sums, line_start, line_end), line_row)
    dup_lines = np.bincount(line_row[earlier], minlength=n)

    repeated = np.zeros(len(starts) + WINDOW, bool)
    if len(starts) >= WINDOW:
        word = span_hash(sums, starts, ends)
        k = len(word) - WINDOW + 1
        window = np.zeros(k, np.uint64)
        for i in range(WINDOW):
            window = mix(window ^ word[i : i + k], i)
        whole = np.flatnonzero(rows[:k] == rows[WINDOW - 1 :])
        again, _ = _found_before(window[whole], rows[whole])
        for i in range(WINDOW):
            repeated[whole[again] + i] = True
    repeats = np.bincount(rows[repeated[: len(rows)]], minlength=n)
    return {
        "n_words": count,
        "word_chars": chars,
        "n_symbols": _per_text(_IS_SYMBOL[data], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
    }


def _measure_batches(name: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {m: [np.zeros(0, np.int64)] for m in METRICS}
            for block in text_blocks(batch.column("text")):
                for metric, values in measure(block).items():
                    found[metric].append(values)
            arrays = [pa.array(np.concatenate(found[m]), pa.int64()) for m in METRICS]
            packed = pa.StructArray.from_arrays(arrays, names=METRICS)
            fields = [*batch.schema, pa.field(name, packed.type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], schema=pa.schema(fields))

    return run


def measured(docs: DataFrame, name: str = "measured") -> DataFrame:
    """The documents with a struct of `METRICS`. A missing text counts as an empty one."""
    kind = T.StructType([T.StructField(m, T.LongType()) for m in METRICS])
    out = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    return small_batches(docs).mapInArrow(_measure_batches(name), out)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def strict_failed(m: Column, margin: int = 1) -> Column:
    """The base rules and the stricter ones, whose limits are multiplied by the margin."""
    symbols = m["n_symbols"] * 100 > m["word_chars"] * MAX_SYMBOL_PERCENT * margin
    lines = m["n_dup_lines"] * 100 > m["n_words"] * MAX_DUP_LINE_PERCENT * margin
    return base_failed(m) | symbols | lines


def host_verdicts(rows: DataFrame, host: str, failed: Column, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: ``host_docs, host_failed, host_rate, host_limit, host_trusted, all_docs``.

    Rates follow a beta distribution whose mean and strength are fitted to all hosts by
    moments (the spread of the observed rates, less what the size of the hosts explains).
    With one host, or no spread beyond chance, all hosts get the common rate. The limit is the
    prior's mean and `PRIOR_DEVIATIONS` deviations, at most ``max_rate``.
    """
    counted = rows.groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(failed.cast("bigint")).alias("host_failed"))
    hosts = stored(counted, "hosts")
    size, bad = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    sums = {"hosts": F.count("*"), "docs": F.sum(size), "failed": F.sum(bad), "squares": F.sum(size * size), "moment": F.sum(bad * bad / size)}
    found = hosts.agg(*[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in sums.items()]).first()
    mean, strength = beta_prior(**found.asDict())
    limit = min(max_rate, mean + PRIOR_DEVIATIONS * beta_deviation(mean, strength))
    if strength is None:
        shrunk = F.lit(mean)
    else:
        shrunk = (bad + F.lit(mean * strength)) / (size + F.lit(strength))
    rated = hosts.withColumn("host_rate", shrunk).withColumn("host_limit", F.lit(limit))
    rated = rated.withColumn("host_trusted", F.col("host_rate") <= F.col("host_limit"))
    return rated.withColumn("all_docs", F.lit(int(found["docs"])))


def beta_prior(hosts: float, docs: float, failed: float, squares: float, moment: float) -> tuple[float, float | None]:
    """Mean and strength (the sum of both parameters) of the prior; no strength means equal rates.

    ``squares`` sums the squared sizes of the hosts, ``moment`` their size times the squared rate.
    """
    if docs == 0:
        return 0.0, None
    mean = failed / docs
    chance = mean * (1 - mean)
    spread = moment - docs * mean * mean
    # The spread that chance alone would give, and how fast it grows with the variance of the rates.
    free = docs - squares / docs
    variance = (spread - chance * (hosts - 1)) / free if free > 0 else 0.0
    if variance <= 0:
        return mean, None
    return mean, max(chance / variance - 1, 0.0)


def beta_deviation(mean: float, strength: float | None) -> float:
    """Standard deviation of the prior; none where all rates are equal."""
    return 0.0 if strength is None else (mean * (1 - mean) / (strength + 1)) ** 0.5


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id``, the host, the metrics, the host's figures, ``base_failed`` and ``kept``.

    One row per input row; a missing host is a host of its own. Other columns are ignored.
    """
    rows = measured(docs.select("doc_id", F.col(host).alias("host"), F.col("text").cast("string")))
    rows = stored(rows.select("doc_id", "host", "measured"), "quality")
    m = F.col("measured")
    hosts = host_verdicts(rows, "host", strict_failed(m))
    joined = join_groups(rows, hosts, "host", "host_docs", F.col("all_docs"))
    kept = ~strict_failed(m, WIDE_MARGIN) & (F.col("host_trusted") | ~strict_failed(m))
    figures = ["host_docs", "host_failed", "host_rate", "host_limit", "host_trusted"]
    return joined.select("doc_id", "host", "measured.*", *figures, base_failed(m).alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that `judge` keeps, with their columns as they are.

    Texts are measured twice rather than shuffled: once for the hosts, once to be filtered.
    """
    name = free_name(docs.columns, "measured")
    narrow = measured(docs.select(F.col(host).alias("host"), F.col("text").cast("string"))).select("host", "measured")
    hosts = host_verdicts(narrow, "host", strict_failed(F.col("measured")))
    hosts = hosts.select(text_key(F.col("host")).alias("host_key"), "host_docs", "host_trusted", "all_docs")
    rows = measured(docs, name)
    m = F.col(name)
    # Only rows that fail a stricter rule ask for their host; the others take keys that no host has.
    nobody = F.concat(F.lit("h"), F.monotonically_increasing_id().cast("string"))
    asked = F.when(strict_failed(m), text_key(F.col(f"`{host}`"))).otherwise(nobody)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = rows.where(~strict_failed(m, WIDE_MARGIN)).select(packed, asked.alias("host_key"))
    joined = join_groups(rows, hosts, "host_key", "host_docs", F.col("all_docs"))
    return joined.where(F.coalesce(F.col("host_trusted"), F.lit(True))).select("doc.*")

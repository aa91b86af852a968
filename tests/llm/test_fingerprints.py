"""One-permutation MinHash against a plain version, and against true similarities."""

import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402

from eventlab.llm import fingerprints as G

MASK = (1 << 64) - 1
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def chained(values):
    """Spark's xxhash64 of several values, as an unsigned number."""
    seed = 42
    for v in values:
        if isinstance(v, str):
            data = v.encode()
        else:
            bytes_, value = v  # a number and its width
            data = (value & ((1 << 8 * bytes_) - 1)).to_bytes(bytes_, "little")
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def plain(text):
    hashes = sorted({signed(chained(s)) for s in shingles(text)})
    if not hashes:
        return ""
    bins = {}
    for h in hashes:
        bins.setdefault((h >> 55) + 256, h)
    out = ""
    for b in range(512):
        own = b
        if b not in bins:
            tried = (signed(chained([(4, b), (4, t)])) % 512 for t in range(G.PROBES))
            own = next((c for c in tried if c in bins), None)
        if own is None:
            own = min((signed(chained([(4, b), (4, c)])), c) for c in bins)[1]
        value = bins[own]
        out += f"{value & 15:x}"
    return out


def likeness(a, b):
    if not a or not b:
        return float(a == b)
    share = sum(x == y for x, y in zip(a, b, strict=True)) / 512
    return max(0.0, (share - 1 / 16) / (15 / 16))


def texts():
    r = random.Random(3)
    return [None, "", " \t\n", "one", "one two three four", "one two three four five", *[cases.prose(i, r.choice([2, 7, 30, 200, 1500])) for i in range(30)]]


def test_equals_plain_version(spark):
    given = [(i, t) for i, t in enumerate(texts())]
    made = {r.doc_id: r for r in G.fingerprints(spark.createDataFrame(given, "doc_id bigint, text string")).collect()}
    for i, t in given:
        assert made[i].fingerprint == plain(t or ""), i
        assert made[i].n_chars == len(t or "")


def following(rows):
    """Documents in order, each with the text of the next one."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(chained([r[1] or ""]))))
    return [(i, t or "", ordered[(k + 1) % len(ordered)][1] or "") for k, (i, t) in enumerate(ordered)]


def expected(rows):
    out = []
    for i, own, after in following(rows):
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        a, b, c = plain(own), plain(edited), plain(after)
        out.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return Counter(out)


def compared(df):
    out = G.compare_edited(df)
    assert out.columns == COLUMNS
    return Counter((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in out.collect())


def test_edited_texts(spark):
    rows = [(r[0], r[1]) for r in cases.rows() if r[0] != 9] + [(40, "é" * 9), (41, "𝄞 x " * 5), (42, cases.prose(2, 40))]
    df = cases.frame(spark, [(i, t, "en", "a", None, "m", "d", 1, 2, 3, "r", 4) for i, t in rows]).repartition(4)
    assert compared(df) == expected(rows)


def test_repeated_rows_and_small_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    many = [(5, "a b c d e f g h")] * 40 + [(None, "x y z")] * 3 + [(6, "a b c d e f g h i")]
    for rows in (many, [(1, "only one here")], [(1, None)], [(None, None), (None, "q")], []):
        assert compared(frame(rows)) == (expected(rows) if rows else Counter())


def test_estimates_are_close(spark):
    """Without bias: the mean error of many pairs is small, so is that of each."""
    r = random.Random(9)
    pairs = []
    for k in range(60):
        base, other = cases.prose(2 * k, 600).split(), cases.prose(2 * k + 1, 600).split()
        cut = r.randrange(600)
        pairs.append((k, " ".join(base), " ".join(base[:cut] + other[cut:])))
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    packed = df.select("k", G.packed(F.col("a")).alias("a"), G.packed(F.col("b")).alias("b"))
    made = {x.k: x.near for x in packed.select("k", G.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    errors = []
    for k, a, b in pairs:
        x, y = set(shingles(a)), set(shingles(b))
        errors.append(made[k] - len(x & y) / len(x | y))
    assert abs(sum(errors) / len(errors)) < 0.015 and max(map(abs, errors)) < 0.12


def test_no_python_in_the_plan(spark, small_dir):
    out = G.compare_edited(spark.read.parquet(f"{small_dir}/documents.parquet"))
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))

"""Awkward documents that every operator must take, and brute-force helpers."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        T.StructField("measured", T.StringType()),
        T.StructField("Draw", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("tag", T.LongType()),
        T.StructField("row_others", T.StringType()),
        T.StructField("removed", T.LongType()),
    ]
)


def prose(seed: int, n: int, words: int = 400) -> str:
    """Invented words, the same for the same seed."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}{i % 7}" for i, (a, b) in enumerate((x, y) for x in ("lum", "ter", "ä", "qua", "siv", "ro") for y in ("mo", "nel", "üp", "fa", "k"))]
    return " ".join(r.choice(vocabulary) + str(r.randrange(words)) for _ in range(n))


def rows() -> list[tuple]:
    base = prose(1, 300)
    passage = prose(2, 60)
    texts = [
        (0, base, "en", "a"),
        (1, base, "en", "b"),  # exact copies, one of them a repeated row
        (1, base, "en", "b"),
        (2, base.replace("mo", "mo", 1) + " tail words here", "en", "a"),
        (3, prose(3, 80) + " " + passage + " " + prose(4, 80), "de", None),
        (4, passage + "\n" + prose(5, 40), "de", "c"),
        (5, None, None, None),
        (6, "", "en", "a"),
        (7, "   \n\t ", "en", "a"),
        (8, "one", "fr", "b"),
        (None, prose(6, 70), "en", "a"),
        (None, prose(6, 70), "en", "a"),
        (9, prose(7, 30_000), "en", "a"),  # very long
        (10, "Same Line.\n" * 200, "en", "c"),
        (11, "x" * 500, "en", "c"),
        (12, "é" * 120 + " ü" * 80, "fr", "c"),
        (13, "under the MIT license; Apache License, Version 2.0 and CC BY-NC 4", "en", "c"),
        (14, "tail <|endoftext|> of  two   spaces   and \x1c controls ", "en", "c"),
        (2, prose(8, 60), "es", "b"),  # an id that another text has
        (-3, prose(9, 55), "es", ""),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None, "m", "d", 1, 2, 3, "r", 4) for i, t, lang, s in texts]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)

"""Ranked search against every score in plain Python."""

import math
import random
import re

import numpy as np
import pytest

from eventlab.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, top=10):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    df = {}
    for _, bag in bags:
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 10 + (90 * len(bag) * n_docs) // max(total, 1)
            score = 0
            for t in set(terms(text)):
                if tf := bag.count(t):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:top])]
    return out


def corpus(seed, n, vocabulary=120):
    r = random.Random(seed)
    words = [f"{a}{i}" for i in range(vocabulary // 4) for a in ("Lum", "ter", "É", "qua")]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weights, k=r.choice([1, 3, 20, 60])))) for i in range(n)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(1, 9)))) for i in range(25)]
    return docs, items


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, score int, Segment string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int")
    out = X.rank_documents(d.repartition(3), q, **how)
    assert out.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
    return sorted(map(tuple, out.collect()), key=lambda x: x[:2])


@pytest.mark.parametrize("how", [{}, {"segment_bytes": 2000, "terms_at_once": 40}])
def test_equals_all_scores(spark, how):
    docs, items = corpus(1, 700)
    assert found(spark, docs, items, **how) == expected(docs, items)


def test_awkward_rows(spark):
    docs, items = corpus(2, 60)
    docs += [(None, docs[3][1]), (None, None), (7, docs[3][1]), (7, docs[3][1]), (90, ""), (91, " ,.;\t"), (92, "É É x" * 3), (93, "lum0 " * 70_000), (-5, "LUM0 lum0-Lum0")]
    items += [(50, None), (51, ""), (52, "lum0 LUM0, lum0!"), (53, "unseen"), (54, docs[3][1])]
    assert found(spark, docs, items) == expected(docs, items)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == []


def lists_of(docs, asked):
    totals = (sum(1 for _, t in docs if terms(t)), sum(len(terms(t)) for _, t in docs))
    names = {t: k + 1 for k, t in enumerate(sorted({t for _, x in docs for t in terms(x)}))}
    rows = [(names[t], d, terms(x).count(t)) for d, (_, x) in enumerate(docs) for t in set(terms(x))]
    term, doc, tf = (np.array(c) for c in zip(*rows, strict=True))
    lengths = np.array([len(terms(x)) for _, x in docs])
    made = [dict(zip(X._NAMES, r, strict=True)) for r in X.invert(0, [i for i, _ in docs], lengths, term.astype(np.uint64), doc, tf, totals)]
    return X.read_lists(made), {t: names[t] for t in asked if t in names}


@pytest.mark.parametrize("window", [64, 1000])
def test_windows_give_the_same(window):
    docs, _ = corpus(3, 900, 16)
    asked = ["lum0", "ter0", "qua3", "É1", "lum3"]
    held, names = lists_of(docs, asked)
    query = [(names[t], 10 * k + 1) for k, t in enumerate(names)]
    place, score = X.best_documents(held, query, 10, window)
    full = np.zeros(len(docs), np.int64)
    for t, w in query:
        for b in range(len(held.lists[t][0])):
            d, v = held.block(t, b)
            full[d] += w * v
    order = np.lexsort((np.arange(len(docs)), -full))[:10]
    assert place.tolist() == order.tolist() and score.tolist() == full[order].tolist()


def test_blocks_that_cannot_pass_are_not_decoded():
    """A common word of no weight is only looked up where a candidate needs it."""
    r = random.Random(5)
    docs = [(i, "common " * r.choice([1, 2]) + ("rare " * 5 if i < 12 else "other ") * 3) for i in range(20_000)]
    held, names = lists_of(docs, ["common", "rare"])
    X.best_documents(held, [(names["common"], 1), (names["rare"], 5000)], 10)
    blocks = len(held.lists[names["common"]][0])
    assert blocks > 150 and sum(1 for t, _ in held.decoded if t == names["common"]) < 20

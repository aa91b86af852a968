"""Near copies against all pairs, and the parts of the sketch."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import prose

from eventlab.llm import nearcopies, orderhash
from eventlab.llm.textblocks import text_blocks


def labelled(text):
    words = [w.encode().translate(bytes(orderhash.LOWER)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    found, seen = [], {}
    for i in range(max(1, len(words) - 4) if words else 0):
        shingle = tuple(words[i : i + 5])
        seen[shingle] = seen.get(shingle, 0) + 1
        found.append((shingle, seen[shingle]))
    return found


def aligned(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            row[j + 1], before = (before + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def components(texts):
    found = {k: labelled(t) for k, t in texts.items()}
    root = {k: k for k in texts}
    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n, m = len(found[a]), len(found[b])
            if not n or not m or len(set(found[a]) & set(found[b])) < 0.44 * (n + m):
                continue
            same = aligned(found[a], found[b])
            if same / (n + m - same) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


@pytest.fixture(scope="module")
def family():
    """Documents that drift away from one another, so that chains of links matter, and unrelated ones."""
    r = random.Random(4)
    texts, words = {}, prose(1, 120).split()
    for i in range(40):
        words = list(words)
        words[r.randrange(len(words))] = f"new{i}"
        if i % 9 == 8:
            words = words[40:] + words[:40]  # the same shingles in another order
        texts[100 - i] = " ".join(words)
    texts |= {200 + i: prose(50 + i, 100) for i in range(10)}
    texts |= {300: texts[100].upper(), 301: "  ".join(texts[100].split()), 302: "", 303: None, 304: "two words", 305: "two words"}
    return texts


def test_components(spark, family):
    df = spark.createDataFrame(list(family.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in nearcopies.near_duplicates(df).collect()}
    expected = components(family)
    assert got == {k: (root, k == root) for k, root in expected.items()}


def test_buckets_in_blocks_give_the_same(spark, family, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 4)
    df = spark.createDataFrame(list(family.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.near_duplicates(df).collect()}
    assert got == components(family)


def own(text):
    return orderhash.shingles(next(text_blocks(pa.array([text]))))[0]


def test_similarity_follows_order():
    words = prose(2, 200).split()
    text, moved = " ".join(words), " ".join(words[100:] + words[:100])
    assert orderhash.similarity(own(text), own(text)) == 1
    assert orderhash.similarity(own(text), own(moved)) == 0  # half of it is out of order
    assert orderhash.similarity(own(text), own(" ".join(words[:190]))) == pytest.approx(186 / 196)


def test_longest_increasing():
    r = np.random.default_rng(0)
    for _ in range(50):
        x = r.permutation(r.integers(0, 12))
        best = [1] * len(x)
        for i in range(len(x)):
            best[i] = 1 + max((best[j] for j in range(i) if x[j] < x[i]), default=0)
        assert orderhash.increasing(x) == max(best, default=0)


def test_sketches_are_found_as_often_as_planned():
    """Pairs at the limit of similarity share some sketch."""
    r = random.Random(1)
    missed = 0
    for seed in range(60):
        words = prose(seed, 150).split()
        other = list(words)
        for at in r.sample(range(5, 145), 3):
            other[at] = "changed"
        block = next(text_blocks(pa.array([" ".join(words), " ".join(other)])))
        value, rows, _ = orderhash.shingles(block)
        keys = orderhash.sketches(value, rows, 2)
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_sketches_by_definition():
    block = next(text_blocks(pa.array([prose(3, 90), "a b", "", prose(4, 6)])))
    value, rows, _ = orderhash.shingles(block)
    keys = orderhash.sketches(value, rows, 4)
    assert (keys[2] == 0).all() and (keys[[0, 1, 3]] != 0).all()
    single = [orderhash.sketches(value[rows == i], np.zeros((rows == i).sum(), int), 1)[0] for i in (0, 1, 3)]
    assert (np.stack(single) == keys[[0, 1, 3]]).all()

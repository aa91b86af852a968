"""Repeated byte strings against a plain search."""

import hashlib

import numpy as np
import pytest
from cases import frame, rows

from eventlab.llm import suffixes
from eventlab.llm.textblocks import Block, prefix_hash


def plain(data, depth):
    least = {}
    for doc, text in data:
        doc, text = suffixes.LAST_ID if doc is None else doc, (text or "").encode()
        for i in range(len(text) - depth + 1):
            string = text[i : i + depth]
            least[string] = min(doc, least.get(string, doc))
    out = []
    for doc, text in data:
        own, text = suffixes.LAST_ID if doc is None else doc, (text or "").encode()
        gone = bytearray(len(text))
        for i in range(len(text) - depth + 1):
            if least[text[i : i + depth]] < own:
                gone[i : i + depth] = b"\1" * depth
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out.append((doc, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1000, 1])
def test_awkward_rows(spark, hot):
    got = suffixes.removed_spans(frame(spark), hot=hot).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain([(r[0], r[1]) for r in rows()], suffixes.DEPTH)


@pytest.mark.parametrize("hot", [1000, 1])
def test_documents(spark, small_dir, hot):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").limit(120)
    data = [tuple(r) for r in docs.collect()]
    got = suffixes.removed_spans(spark.createDataFrame(data, docs.schema), hot=hot).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(data, suffixes.DEPTH)


def test_two_letter_texts(spark):
    """Many repeats of all lengths, inside and across documents, with another depth."""
    r = np.random.default_rng(3)
    data = [(int(i), "".join(r.choice(["a", "b"], r.integers(0, 120)))) for i in r.permutation(40)]
    got = suffixes.removed_spans(spark.createDataFrame(data, "doc_id bigint, text string"), depth=23).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(data, 23)


def test_radix_passes_drop_what_is_alone():
    strings = np.frombuffer(b"aaaaaaaaaaaa" b"aaaaaaaaaaab" b"aaaaaaaaaaaa" b"zzzzzzzzzzzz", np.uint8).reshape(4, 12)
    at, left = suffixes.radix_groups(np.zeros(4, np.uint64), strings, np.array([5, 6, 7, 8]))
    assert at.tolist() == [2]
    assert left.tolist() == [4, 3, 2]


def test_cuts_keep_characters_whole():
    data = np.frombuffer("aéb".encode(), np.uint8)
    assert suffixes.whole_characters(data, np.array([True, True, False, False])).tolist() == [True, False, False, False]


def test_anchors_of_long_texts(monkeypatch):
    """A text longer than a place can count gets the anchors that it would get if places were wider."""
    data = np.random.default_rng(4).integers(97, 123, 5000).astype(np.uint8)
    block = Block(0, 2, data, np.array([0, 4300, 5000]))
    expected = suffixes.anchors(block, prefix_hash(data), suffixes.DEPTH)
    monkeypatch.setattr(suffixes, "_PLACE", np.uint64((1 << 9) - 1))
    got = suffixes.anchors(block, prefix_hash(data), suffixes.DEPTH)
    assert expected[0].max() > 4300
    assert all((a == b).all() for a, b in zip(got, expected, strict=True))

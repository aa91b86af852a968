"""The prefix trie against nested dictionaries in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from eventlab.llm import prefixtrie as P
from eventlab.llm.perfecthash import PerfectHash


def expected(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        value = (len(m) - 1) * len([w for w in p[-1][1].replace("\t", " ").replace("\n", " ").split(" ") if w]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += value
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, X string")
    out = P.prefix_trie(df.repartition(3), **how)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def chats(seed, n):
    r = random.Random(seed)
    return [(c, k, "user" if k % 2 == 0 else "bot", " ".join(r.choice(["a", "b", "ccc"]) for _ in range(r.randrange(3)))) for c in r.sample(range(-60, 400), n) for k in range(r.randrange(1, 7))]


@pytest.mark.parametrize("limit", [1, 12, 4096])
def test_equals_dictionaries(spark, limit):
    rows = chats(1, 150)
    assert made(spark, rows, subtree_rows=limit) == expected(rows)


def test_awkward_rows(spark):
    r = chats(2, 30)
    same = [(c, k, "user", "hello there") for c in range(1000, 1100) for k in range(3)]  # copies
    ties = [(2000, 1, "user", "b"), (2000, 1, "user", "a"), (2000, 1, "user", "a"), (2000, None, "bot", "first"), (2000, 0, None, None)]
    odd = [(None, 0, "user", "no conversation"), (2001, None, None, None), (2002, 0, "", "  \t\n "), (2003, 0, "user", "word " * 50_000)]
    deep = [(3000, k, "user", f"turn {k}") for k in range(60)] + [(3001, k, "user", f"turn {k}") for k in range(60)]
    rows = r + same + ties + odd + deep
    assert made(spark, rows, subtree_rows=40) == expected(rows)
    assert made(spark, []) == []
    assert made(spark, odd[:1]) == []


def test_blocks_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)
    rows = [(c, k, "user", f"turn {k if k < 70 else c + k}") for c in (20, 21, 22) for k in range(150)]
    assert made(spark, rows, subtree_rows=30) == expected(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 20_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    slots = PerfectHash(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))

"""Sketches and similarity of the order MinHash operator: see `nearcopies`."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

from .textblocks import Block, mix, prefix_hash, span_hash, words

#: Words of a shingle, shingles of a sketch, sketches of a document.
SHINGLE = 5
PICKED = 4
SKETCHES = 24
MIN_SIMILARITY = 0.8
#: Shingles with small hashes from which a sketch is picked, on average; rows with too few take all.
CANDIDATES = 12

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Odd factors, one per sketch: together with `mix` they order the shingles anew each time.
FACTORS = mix(np.arange(1, 257, dtype=np.uint64), 77) | np.uint64(1)


def shingles(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled shingles of every text in order, their rows, and two hashes per text.

    Words are runs of non-space, with A-Z lower-cased. A text of fewer words has one shingle of all of them, an
    empty text none. The hashes per text tell apart sequences of words.
    """
    data = LOWER[block.data]
    starts, ends, rows = words(block)
    word = span_hash(prefix_hash(data), starts, ends)
    n = len(block)
    count = np.bincount(rows, minlength=n)
    first = np.cumsum(count) - count
    place = (np.arange(len(word)) - first[rows]).astype(np.uint64)
    whole = np.zeros((n, 2), np.uint64)
    if len(word):
        some = np.flatnonzero(count)
        for i in range(2):
            whole[some, i] = np.add.reduceat(mix(word ^ mix(place, 20 + i), 30 + i), first[some])
    last = np.maximum(count - size, 0)
    k = np.where(count > 0, last + 1, 0)
    own = np.repeat(np.arange(n), k)
    at = np.repeat(first, k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    length = np.minimum(count, size)[own]
    value = np.zeros(len(at), np.uint64)
    for i in range(size):
        inside = length > i
        value = np.where(inside, mix(value ^ word[np.minimum(at + i, max(len(word) - 1, 0))], i), value) if len(at) else value
    # The label: how often the shingle has come before in its text.
    key = value ^ mix(own.astype(np.uint64), 9)
    order = np.argsort(key, kind="stable")
    same = key[order]
    new = np.r_[True, same[1:] != same[:-1]] if len(same) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    label = np.zeros(len(key), np.uint64)
    if len(run) < len(key):
        label[order] = np.arange(len(key)) - run[np.cumsum(new) - 1]
    return mix(value + label, 11), own, whole


def sketches(value: np.ndarray, own: np.ndarray, n: int, picked: int = PICKED, count: int = SKETCHES) -> np.ndarray:
    """Sketch keys, one row per text. Rows of texts without shingles are zero."""
    out = np.zeros((n, count), np.uint64)
    size = np.bincount(own, minlength=n)
    share = np.minimum(1.0, CANDIDATES / np.maximum(size, 1))
    limit = np.where(share >= 1, np.iinfo(np.uint64).max, (share * 2.0**63).astype(np.uint64) * np.uint64(2))[own]
    need = np.minimum(picked, size)
    for j in range(count):
        with np.errstate(over="ignore"):
            drawn = value * FACTORS[j]
        chosen = np.flatnonzero(drawn <= limit)
        short = np.bincount(own[chosen], minlength=n) < need
        if short.any():
            chosen = np.flatnonzero((drawn <= limit) | short[own])
        order = chosen[np.lexsort((drawn[chosen], own[chosen]))]
        row = own[order]
        rank = np.arange(len(order)) - np.searchsorted(row, row)
        # The smallest ones, back in text order.
        kept = np.sort(order[rank < picked])
        row = own[kept]
        place = np.arange(len(kept)) - np.searchsorted(row, row)
        key = np.zeros(n, np.uint64)
        for i in range(picked):
            here = kept[place == i]
            key[own[here]] = mix(key[own[here]] ^ value[here], 40 + i)
        out[:, j] = np.where(size > 0, mix(key, 50 + j) | np.uint64(1), 0)
    return out


def increasing(places: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(places) < 2 or (np.diff(places) > 0).all():
        return len(places)
    tails: list[int] = []
    for p in places.tolist():
        at = bisect_left(tails, p)
        tails[at : at + 1] = [p]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float = MIN_SIMILARITY) -> float:
    """Share of labelled shingles that an alignment keeps in order: aligned / (both - aligned).

    Computed inside the band that a similarity of ``least`` allows; 0 if it is out of reach. Labelled
    shingles are unique in a text, so the alignment is the longest chain of matches that ascends
    in both texts.
    """
    n, m = len(a), len(b)
    need = int(np.ceil(least / (1 + least) * (n + m) - 1e-9))
    if not n or not m or min(n, m) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < need:
        return 0.0
    order = np.argsort(i)
    i, j = i[order], j[order]
    shift = j - i
    band = (shift >= need - n) & (shift <= m - need)
    aligned = increasing(j[band])
    return aligned / (n + m - aligned) if aligned >= need else 0.0

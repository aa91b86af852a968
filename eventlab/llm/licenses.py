"""License notices in texts, by matching statistics against a suffix automaton of templates.

The automaton holds every run of words of every template. Streamed through it, each word of a
file gets the length of the longest template run that ends there. Long maximal matches are
chained, template by template, into spans; a notice with changed words still forms one span.

Only stretches of template words that hold three consecutive words of a template, or the whole of a
shorter one, are streamed; nothing else can match as much. They are found for whole blocks at once.

Notices of one family share most of their words. Of spans that overlap by more than half of the shorter
one, the one that covers most words stays, and of equal ones the one whose template is covered best: a notice
with an additional clause, another version or another name gets the label of its own template.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches
from .textblocks import Block, prefix_hash, span_hash, spans, text_blocks

#: Phrases that are counted wherever they stand, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices of public licences, by label.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed"
        " to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF"
        " ANY KIND, either express or implied."
    ),
    "bsd-2": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
        " the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED"
        " BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE"
        " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "bsd-3": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
        " the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the"
        " copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without"
        " specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS"
        " OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR"
        " PURPOSE ARE DISCLAIMED."
    ),
    "gpl-2": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "gpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"
        " as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "lgpl-3": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "agpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}
#: One-line statements, by label.
STATEMENTS = {
    "Released under the MIT License": "mit",
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
}
#: Words of a match that counts, words between two matches of a span, and the share of a template
#: (or number of its words) that a span must cover to give its label.
MIN_MATCH = 4
MAX_GAP = 12
MIN_SHARE = 0.6
MIN_COVERED = 20
SEED_WORDS = 3

#: Lower-cases A-Z; letters, digits and bytes above 127 make words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def split_words(text: str) -> list[bytes]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = spans(IN_WORD[data], np.array([0, len(data)]))
    return [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


@dataclass
class Automaton:
    """A suffix automaton of several token sequences.

    ``ends[v]`` has, for each template that contains the strings of state v, where its first
    occurrence ends.
    """

    step: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[int, int]] = field(default_factory=lambda: [{}])

    def _state(self, size: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.size.append(size)
        self.ends.append({})
        return len(self.size) - 1

    def _split(self, parent: int, token: object) -> int:
        """The state that parent's longest string reaches with the token, cut off from longer ones."""
        target = self.step[parent][token]
        if self.size[target] == self.size[parent] + 1:
            return target
        copy = self._state(self.size[parent] + 1)
        self.step[copy] = dict(self.step[target])
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while parent >= 0 and self.step[parent].get(token) == target:
            self.step[parent][token] = copy
            parent = self.link[parent]
        return copy

    def add(self, tokens: list, template: int) -> int:
        """Adds a sequence and returns the state of the whole of it."""
        state, seen = 0, []
        for token in tokens:
            if token in self.step[state]:
                state = self._split(state, token)
            else:
                new, at = self._state(self.size[state] + 1), state
                while at >= 0 and token not in self.step[at]:
                    self.step[at][token] = new
                    at = self.link[at]
                self.link[new] = 0 if at < 0 else self._split(at, token)
                state = new
            seen.append(state)
        for end, state in enumerate(self._prefixes(tokens), 1):
            while state > 0 and template not in self.ends[state]:
                self.ends[state][template] = end
                state = self.link[state]
        return state

    def _prefixes(self, tokens: list) -> Iterator[int]:
        state = 0
        for token in tokens:
            state = self.step[state][token]
            yield state

    def finish(self) -> None:
        """Later sequences may split states: gives every state the ends of the states below it."""
        for state in sorted(range(1, len(self.size)), key=lambda v: -self.size[v]):
            above = self.ends[self.link[state]]
            for template, end in self.ends[state].items():
                above[template] = min(end, above.get(template, end))

    def find(self, tokens: list) -> int:
        state = 0
        for token in tokens:
            state = self.step[state][token]
        return state

    def stream(self, tokens: Iterator) -> Iterator[tuple[int, int]]:
        """State and match length after every token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.step[state]:
                state = self.link[state]
                length = self.size[state]
            state = self.step[state].get(token, 0)
            length = length + 1 if state else 0
            yield state, length


@dataclass
class Model:
    """The automaton, and what finds stretches worth streaming."""

    templates: list[tuple[str, int]]
    automaton: Automaton
    phrases: list[tuple[int, int, str]]
    vocabulary: dict[bytes, int]
    hashes: np.ndarray
    of_hash: np.ndarray
    #: Runs of one, two and three words that begin a stretch.
    seeds: dict[int, np.ndarray]


@lru_cache(maxsize=4)
def model(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Model:
    """Built once per process from (text, label) pairs."""
    texts = [(split_words(text), label) for text, label in (*templates, *phrases)]
    if not all(tokens for tokens, _ in texts):
        raise ValueError("a phrase or a template has no word")
    vocabulary: dict[bytes, int] = {}
    for tokens, _ in texts:
        for token in tokens:
            vocabulary.setdefault(token, len(vocabulary) + 1)
    automaton = Automaton()
    for i, (tokens, _) in enumerate(texts):
        automaton.add([vocabulary[t] for t in tokens], i)
    automaton.finish()
    found = [(split_words(text), label) for text, label in phrases]
    places = [(automaton.find([vocabulary[t] for t in tokens]), len(tokens), label) for tokens, label in found]
    n = len(vocabulary) + 1
    seeds: dict[int, set[int]] = {k: set() for k in range(1, SEED_WORDS + 1)}
    for tokens, _ in texts:
        ids = [vocabulary[t] for t in tokens]
        size = min(len(ids), SEED_WORDS)
        for i in range(len(ids) - size + 1):
            seeds[size].add(sum(x * n**k for k, x in enumerate(reversed(ids[i : i + size]))))
    listed = [np.frombuffer(t, np.uint8) for t in vocabulary]
    joined = np.concatenate(listed)
    ends = np.cumsum([len(x) for x in listed])
    hashes = span_hash(prefix_hash(joined), ends - [len(x) for x in listed], ends)
    order = np.argsort(hashes)
    sizes = [(label, len(tokens)) for tokens, label in texts]
    return Model(sizes, automaton, places, vocabulary, hashes[order], order + 1, {k: np.array(sorted(v)) for k, v in seeds.items() if v})


def standard_templates() -> tuple[tuple[str, str], ...]:
    return tuple((text, label) for label, text in TEMPLATES.items()) + tuple(STATEMENTS.items())


def stretches(block: Block, m: Model) -> tuple[np.ndarray, list[tuple[int, int, list[bytes]]]]:
    """Words of every text, and the stretches to stream: row, first word in the text, the words."""
    data = LOWER[block.data]
    starts, ends, rows = spans(IN_WORD[block.data], block.offsets)
    counts = np.bincount(rows, minlength=len(block))
    if not len(starts):
        return counts, []
    hashes = span_hash(prefix_hash(data), starts, ends)
    at = np.minimum(np.searchsorted(m.hashes, hashes), len(m.hashes) - 1)
    ids = np.where(m.hashes[at] == hashes, m.of_hash[at], 0).astype(np.int64)
    known = ids > 0
    n = len(m.vocabulary) + 1
    begun = []
    for size, wanted in m.seeds.items():
        last = len(ids) - size + 1
        if last <= 0:
            continue
        whole = rows[:last] == rows[size - 1 :]
        code = np.zeros(last, np.int64)
        for k in range(size):
            whole &= known[k : k + last]
            code = code * n + ids[k : k + last]
        at = np.flatnonzero(whole)
        place = np.minimum(np.searchsorted(wanted, code[at]), len(wanted) - 1)
        begun.append(at[wanted[place] == code[at]])
    seeds = np.unique(np.concatenate(begun)) if begun else np.empty(0, np.int64)
    if not len(seeds):
        return counts, []
    before = np.searchsorted(starts, block.offsets)
    first, last, _ = spans(known, before)
    run = np.unique(np.searchsorted(first, seeds, "right") - 1)
    out = []
    for i in run.tolist():
        a, b = int(first[i]), int(last[i])
        row = int(rows[a])
        out.append((row, a - int(before[row]), [data[x:y].tobytes() for x, y in zip(starts[a:b], ends[a:b], strict=True)]))
    return counts, out


def scan_stretch(tokens: list[bytes], m: Model) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, int]]]:
    """Places of phrases (start, label), and long maximal matches (start, end, template, its end there)."""
    automaton = m.automaton
    places, matches = [], []
    ended: tuple[int, int] | None = None
    # A last token that matches nothing closes the last match.
    ids = [m.vocabulary.get(t, 0) for t in tokens] + [0]
    for i, (state, length) in enumerate(automaton.stream(iter(ids))):
        if ended and length != ended[1] + 1 and ended[1] >= MIN_MATCH:
            matches += [(i - ended[1], i, template, end) for template, end in automaton.ends[ended[0]].items()]
        ended = (state, length) if length else None
        for phrase, size, label in m.phrases:
            if length >= size:
                at = state
                while automaton.size[automaton.link[at]] >= size:
                    at = automaton.link[at]
                if at == phrase:
                    places.append((i - size + 1, label))
    return places, matches


def chain(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (template, start, end, words covered) of matches that follow each other in file and template."""
    spans_: list[list[int]] = []
    open_: dict[int, tuple[int, int]] = {}
    for start, end, template, there in sorted(matches):
        begun = there - (end - start)
        if template in open_:
            at, last = open_[template]
            span = spans_[at]
            # A match may overlap the one before; only its new part counts.
            new = end - max(start, span[2])
            if start - span[2] <= MAX_GAP and begun >= last - (span[2] - start if start < span[2] else 0) and new > 0:
                span[2] = end
                span[3] += new
                open_[template] = (at, there)
                continue
        spans_.append([template, start, end, end - start])
        open_[template] = (len(spans_) - 1, there)
    return [tuple(s) for s in spans_]


def resolve(found: list[tuple[str, int, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The spans (label, start, end, words covered, share) that no better one overlaps by over half of the shorter, without the words covered."""
    kept: list[tuple[str, int, int, float]] = []
    for label, start, end, _, share in sorted(found, key=lambda s: (-s[3], -s[4], s[1], s[0])):
        if all(2 * (min(end, b) - max(start, a)) <= min(end - start, b - a) for _, a, b, _ in kept):
            kept.append((label, start, end, share))
    return sorted(kept, key=lambda s: s[1])


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
    ]
)


def _scan(templates: tuple, phrases: tuple) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(templates, phrases)
        for batch in batches:
            counts, places, found = [], [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for block in text_blocks(batch.column("text")):
                words, runs = stretches(block, m)
                counts.append(words)
                matches: dict[int, list] = {}
                for row, first, tokens in runs:
                    here, long = scan_stretch(tokens, m)
                    places[block.first + row] += [(first + at, label) for at, label in here]
                    matches.setdefault(row, []).extend((first + a, first + b, t, end) for a, b, t, end in long)
                for row, own in matches.items():
                    spanned = []
                    for template, start, end, covered in chain(own):
                        label, size = m.templates[template]
                        share = covered / size
                        # Templates of a few words are phrases; they are places, not spans.
                        if size > MIN_MATCH and (share >= MIN_SHARE or covered >= MIN_COVERED):
                            spanned.append((label, start, end, covered, min(1.0, share)))
                    found[block.first + row] += resolve(spanned)
            columns = [
                batch.column("doc_id"),
                pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                pa.array([[{"word": w, "label": x} for w, x in p] for p in places], RESULT.field("places").type),
                pa.array([[dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in f] for f in found], RESULT.field("spans").type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=RESULT)

    return run


def scan(files: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``doc_id, n_words, places, spans``, one row per file.

    ``places`` are phrases (first word and label), ``spans`` stretches covered by a template (label,
    first word, word after the last, share of the template). Templates and phrases map texts to
    labels; a phrase may have any number of words, a template makes spans if it has more than
    `MIN_MATCH`. One without words is an error. A missing text is empty; other columns are ignored.
    """
    used = standard_templates() if templates is None else tuple(templates.items())
    rows = small_batches(files).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    struct = "places array<struct<word: bigint, label: string>>, spans array<struct<label: string, start: bigint, end: bigint, share: double>>"
    return rows.mapInArrow(_scan(used, tuple(phrases.items())), f"doc_id bigint, n_words bigint, {struct}")


def summary(scanned: DataFrame) -> DataFrame:
    """Per file: the counted phrases, all labels, and a score: 1 with a phrase, else the best share of a template."""
    words = F.transform("places", lambda p: p["word"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    more = F.transform("spans", lambda s: s["label"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )

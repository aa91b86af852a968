"""Token ids of texts by a public vocabulary, quickly and exactly as its library gives them.

A byte-level vocabulary splits a text into pieces that never reach over a space followed by
anything but white space. So a block of texts is cut at such spaces, every different word of the
block is encoded once, and the ids are put together again. A test compares them with the
library's.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from .textblocks import Block, prefix_hash, span_hash, take_spans

#: Fixed value: how the vocabulary's byte-level splitter cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Block of texts whose different words are encoded once.
ENCODED_BYTES = 3 << 20
#: Bytes that a word after a cut does not start with: ASCII white space, and those that start other white space.
_NO_CUT = np.zeros(256, bool)
_NO_CUT[[0x20, *range(0x09, 0x0E), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            about = json.load(f)
        self.library = Tokenizer.from_file(vocabulary)
        self.special = [x["content"] for x in about.get("added_tokens") or []]
        splitter = about.get("pre_tokenizer") or {}
        plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        self.fast = None
        if plain and about.get("normalizer") is None and about["model"]["type"] == "BPE":
            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in token): i for token, i in about["model"]["vocab"].items() if token not in self.special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.token_bytes[i] = len(token)

    def _cut_ids(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that follow each other in the data, and how many each has."""
        ids = np.array(self.fast.encode_ordinary(data.decode()), np.int64)
        places = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(np.r_[0, places])

    def encode(self, block: Block) -> list[np.ndarray]:
        """The ids of every text of a block."""
        if self.fast is None:
            texts = [block.data[a:b].tobytes().decode() for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
            return self._library(texts)
        data, offsets, n = block.data, block.offsets, len(block.data)
        cut = np.zeros(n + 1, bool)
        cut[: n - 1] = (data[:-1] == 0x20) & ~_NO_CUT[data[1:]]
        last = offsets[1:][block.lengths > 0] - 1
        cut[last] = False  # a space at the end of a text
        cut[offsets] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.r_[starts[1:], n].astype(np.int64) if len(starts) else starts
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        first = first[starts]
        hashes = span_hash(prefix_hash(data), starts, ends)
        hashes[first] ^= np.uint64(1)  # the same bytes after a space and at a start may differ in ids
        _, where, which = np.unique(hashes, return_index=True, return_inverse=True)

        # Words after a space are encoded at one go, those at a start one by one.
        lead = first[where]
        sizes = (ends - starts)[where]
        count = np.zeros(len(where), np.int64)
        after = np.flatnonzero(~lead)
        joined = data[take_spans(starts[where[after]], sizes[after])].tobytes()
        ids, count[after] = self._cut_ids(joined, sizes[after]) if len(after) else (np.zeros(0, np.int64), 0)
        place = np.zeros(len(where), np.int64)
        place[after] = np.cumsum(count[after]) - count[after]
        at_start = [np.array(self.fast.encode_ordinary(data[starts[i] : ends[i]].tobytes().decode()), np.int64) for i in where[lead]]
        count[lead] = [len(x) for x in at_start]
        place[lead] = len(ids) + np.cumsum(count[lead]) - count[lead]
        ids = np.concatenate([ids, *at_start]).astype("<u4")

        flat = ids[take_spans(place[which], count[which])]
        before = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(count[which], out=before[1:])
        bounds = before[np.searchsorted(starts, offsets)]
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return self._with_special(block, out)

    def _with_special(self, block: Block, out: list[np.ndarray]) -> list[np.ndarray]:
        """Texts that hold the text of a special id are left to the library."""
        whole = block.data.tobytes()
        odd = {int(np.searchsorted(block.offsets, m.start(), "right")) - 1 for s in self.special for m in re.finditer(re.escape(s.encode()), whole)}
        if odd:
            texts = [block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().decode() for i in sorted(odd)]
            for i, ids in zip(sorted(odd), self._library(texts), strict=True):
                out[i] = ids
        return out

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.library.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)

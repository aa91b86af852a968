"""A minimal perfect hash: n different keys to the slots 0 to n - 1, in a few bits a key.

Keys are thrown into a bit array twice their number. Those alone in their place stay, the others go
on to a smaller array, until none is left. A key's slot is the number of stayed keys before its place.
"""

from __future__ import annotations

import numpy as np

from .textblocks import mix

ROOM = 2


class PerfectHash:
    """Slots of unsigned 64-bit keys, which must differ."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        before = 0
        while len(keys):
            size = max(64, ROOM * len(keys))
            at = self._places(keys, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, before + np.cumsum(alone) - 1))
            before += int(alone.sum())
            keys = keys[~alone[at]]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys, level) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key. Keys it was not made of get any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (alone, slot) in enumerate(self.levels):
            at = self._places(keys[rest], level, len(alone))
            found = alone[at]
            out[rest[found]] = slot[at[found]]
            rest = rest[~found]
        return out

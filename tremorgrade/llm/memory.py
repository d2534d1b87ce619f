"""Ids of distinct words, each encoded once as long as it is remembered.

A full memory forgets the words that came up in one call only, which are most, and keeps those
that came up again; so it can be small without encoding common words over and over.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, filterfalse

import numpy as np

KEPT_WORDS = 500_000


class Memory:
    """Numbers words; the ids of word i are flat[starts[i] : starts[i] + lengths[i]]."""

    def __init__(
        self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT_WORDS
    ) -> None:
        self.encode, self.kept = encode, kept
        self.known: dict[str, int] = {}
        self.flat = self.seen = np.zeros(0, np.int32)
        self.lengths = self.starts = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Words that came up again stay, half of a full memory at most, those of most calls first."""
        again = np.flatnonzero(self.seen > 1)
        most = np.argsort(-self.seen[again], kind="stable")[: self.kept // 2]
        again = np.sort(again[most])
        words = list(self.known)
        self.flat = self.ids(again)
        self.lengths = self.lengths[again]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.known = {words[n]: k for k, n in enumerate(again.tolist())}
        self.seen = self.seen[again] // 2  # calls long ago count less

    def numbers(self, *lists: list[str]) -> list[np.ndarray]:
        """The numbers of all words of these lists, valid until the next call."""
        if len(self.known) > self.kept:
            self._forget()
        known = self.known
        new = list(dict.fromkeys(filterfalse(known.__contains__, chain.from_iterable(lists))))
        if new:
            ids, lengths = self.encode(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.flat = np.concatenate((self.flat, ids.astype(np.int32)))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.seen = np.concatenate((self.seen, np.zeros(len(new), np.int32)))
            self.starts = np.cumsum(self.lengths) - self.lengths
        found = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in lists]
        for numbers in found:
            self.seen[numbers] += 1
        return found

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these words one after another."""
        sizes = self.lengths[numbers]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.starts[numbers] - before, sizes) + np.arange(sizes.sum())]

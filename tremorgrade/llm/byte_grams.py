"""Identifiers of byte strings, named piece by piece, for a buffer of whole texts.

The identifier of a string of 2h bytes is made from the identifiers of its two
halves, that of any other length from two overlapping pieces. So the identifiers
of every long string of a buffer take a few array operations and no reading back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GAP = 400
"""Positions between two texts of a buffer, more than any string looked up reaches out."""

_BUFFER = 1 << 17
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K1
    x ^= x >> np.uint64(32)
    x += b
    x *= _K2
    x ^= x >> np.uint64(29)
    x *= _K3
    return x


#: Identifiers of single bytes; the last stands for every position outside the text.
_BYTES = _pair(np.arange(257, dtype=np.uint64), np.full(257, 7, dtype=np.uint64))


class Grams:
    """Identifiers by length for texts laid out one after another with gaps between."""

    def __init__(self, texts: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = GAP + np.concatenate(([0], np.cumsum(self.lengths + GAP)[:-1])).astype(np.int64)
        symbols = np.full(int(self.starts[-1] + self.lengths[-1] + GAP), 256, dtype=np.int16)
        for start, text in zip(self.starts, texts, strict=True):
            symbols[start : start + len(text)] = np.frombuffer(text, dtype=np.uint8)
        self._by_power = {1: _BYTES[symbols]}

    def _power(self, size: int) -> np.ndarray:
        if size not in self._by_power:
            half = self._power(size // 2)
            self._by_power[size] = _pair(half[: -(size // 2)], half[size // 2 :])
        return self._by_power[size]

    def of_length(self, size: int) -> np.ndarray:
        """Identifiers of the strings of this length, at every position where one fits."""
        power = 1 << (size.bit_length() - 1)
        ids = self._power(power)
        return ids if power == size else _pair(ids[: len(ids) - (size - power)], ids[size - power :])

    def at(self, positions: np.ndarray, size: int) -> np.ndarray:
        """Identifiers of the strings of this length at these positions only."""
        power = 1 << (size.bit_length() - 1)
        ids = self._power(power)
        return ids[positions] if power == size else _pair(ids[positions], ids[positions + (size - power)])

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every window (string of `window` bytes) is dealt to the first least gram in it.

        Returns the positions of these grams and, for each, its first and its last
        window. To which gram a window is dealt depends on its own bytes alone.
        """
        ids = self.of_length(gram)
        span = window - gram + 1
        least = _sliding(ids, span, np.minimum)
        fits = np.zeros(len(least) + 1, dtype=np.int32)
        whole = self.lengths >= window
        np.add.at(fits, self.starts[whole], 1)
        np.add.at(fits, (self.starts + self.lengths - window + 1)[whole], -1)
        least[np.cumsum(fits[:-1]) == 0] = 0
        padded = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
        most = _sliding(padded, span, np.maximum)
        found = np.flatnonzero(most[: len(ids)] == ids)
        text = self.text_of(found)
        inside = (text >= 0) & (found + gram <= self.starts[text] + self.lengths[text])
        found, text = found[inside], text[inside]
        values = ids[found]
        before = _nearest(found, values, -1, span)
        after = _nearest(found, values, 1, span)
        first = np.maximum(np.maximum(before + 1, found - span + 1), self.starts[text])
        last = np.minimum(np.minimum(found, after - span), self.starts[text] + self.lengths[text] - window)
        own = first <= last
        return found[own], first[own], last[own]

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _sliding(values: np.ndarray, span: int, pick: np.ufunc) -> np.ndarray:
    """pick over values[i : i + span] for every i where that fits."""
    size, best = 1, values
    while size * 2 <= span:
        best = pick(best[:-size], best[size:])
        size *= 2
    return best if size == span else pick(best[: len(best) - (span - size)], best[span - size :])


def _nearest(found: np.ndarray, values: np.ndarray, step: int, span: int) -> np.ndarray:
    """The next gram to one side, less than `span` away, that goes before this one."""
    far = found + step * (1 << 40)
    open_ = np.arange(len(found))
    distance = 0
    while len(open_):
        distance += step
        other = open_ + distance
        kept = (other >= 0) & (other < len(found))
        open_, other = open_[kept], other[kept]
        near = np.abs(found[other] - found[open_]) < span
        open_, other = open_[near], other[near]
        wins = values[other] <= values[open_] if step < 0 else values[other] < values[open_]
        far[open_[wins]] = found[other[wins]]
        open_ = open_[~wins]
    return far


def blocks(texts: Iterator[tuple[int, bytes]], overlap: int) -> Iterator[tuple[list[tuple[int, int, int]], Grams]]:
    """Buffers of bounded size; a long text is cut into pieces that overlap.

    With each buffer: (key, offset of the piece in its text, length of the text).
    """
    pieces: list[tuple[int, int, int]] = []
    held: list[bytes] = []
    size = 0
    for key, text in texts:
        step = _BUFFER
        for offset in range(0, max(1, len(text) - overlap), step):
            piece = text[offset : offset + step + overlap]
            pieces.append((key, offset, len(text)))
            held.append(piece)
            size += len(piece) + GAP
            if size >= _BUFFER:
                yield pieces, Grams(held)
                pieces, held, size = [], [], 0
    if held:
        yield pieces, Grams(held)

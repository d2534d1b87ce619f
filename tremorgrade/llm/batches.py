"""Arrow batches in pieces of bounded size, and the words of whole texts as arrays."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_PIECE_BYTES = 1 << 20


def pieces(
    batches: Iterator[pa.RecordBatch], column: str, size: int = _PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with some `size` bytes of this text column each, or one longer row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return memory that a task no longer needs to the system. Workers outlive their tasks and
    share an executor, so what one keeps is missing to the others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes; null is empty."""
    return pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()


@dataclass
class Words:
    """Words of some texts: one hash per place, and where each text's words begin and end."""

    hashes: np.ndarray
    bounds: np.ndarray

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words, text by text, with each text's bounds.

        A text with fewer words has its whole sequence as its only run; one without
        words has none.
        """
        counts = np.diff(self.bounds)
        runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        bounds = np.concatenate(([0], np.cumsum(runs)))
        text = np.repeat(np.arange(len(counts)), runs)
        first = self.bounds[text] + np.arange(bounds[-1]) - bounds[text]
        length = np.minimum(counts, size)[text]
        found = length.astype(np.uint64)
        for k in range(size):
            inside = k < length
            word = self.hashes[np.where(inside, first + k, 0)] if len(self.hashes) else found
            mixed = _mix(found * np.uint64(0x9E3779B97F4A7C15) + word)
            found = np.where(inside, mixed, found)
        return found, bounds


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text with A-Z lower-cased, as 64-bit hashes."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    lengths = np.diff(split.offsets.to_numpy()).astype(np.int64)
    coded = flat.dictionary_encode()
    known = coded.dictionary.to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()
    real = (known != "")[codes] if len(known) else np.zeros(0, bool)
    hashes = pd.util.hash_array(known, categorize=False) if len(known) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(text[real], minlength=len(lengths))
    return Words(hashes[codes[real]], np.concatenate(([0], np.cumsum(counts))))

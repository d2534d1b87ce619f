"""Terms of whole texts where every separator is an ASCII character."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE, _UPPER = 0x20, range(0x41, 0x5B)


def byte_table(kept: str) -> np.ndarray:
    """What each byte becomes: A-Z lower-cased, these ASCII characters and all bytes from
    0x80 on as they are, every other one a space. So UTF-8 stays UTF-8."""
    table = np.full(256, _SPACE, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    for code in map(ord, kept):
        table[code] = code + _SPACE if code in _UPPER else code
    return table


def terms(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts one after another, and how many each text has; null has none."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)
    bounds = bounds[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    kind = pa.LargeStringArray if wide else pa.StringArray
    cleaned = kind.from_buffers(len(texts), pa.py_buffer(bounds - bounds[0]), pa.py_buffer(table[raw]))
    split = pc.ascii_split_whitespace(cleaned)
    found = split.flatten()
    real = pc.not_equal(found, "").to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    return found.filter(pa.array(real)), np.bincount(text[real], minlength=len(texts))

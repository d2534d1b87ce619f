"""Whole texts on their way through a shuffle, compressed to less than half."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tremorgrade.llm.batches import as_bytes, pieces

_LEVEL = 3


def packed(documents: DataFrame, *others: str) -> DataFrame:
    """(doc_id, packed) and other columns as they are: the UTF-8 bytes of each text; null is empty."""
    chosen = documents.select("doc_id", "text", *others)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("packed", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=_LEVEL).compress
        for batch in pieces(batches, "text"):
            column = pa.array([pack(t) for t in as_bytes(batch["text"])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], column, *(batch[c] for c in others)],
                names=["doc_id", "packed", *others],
            )

    return chosen.mapInArrow(run, T.StructType([*fields, *chosen.schema.fields[2:]]))


def unpacked(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(p) for p in column.to_pylist()]

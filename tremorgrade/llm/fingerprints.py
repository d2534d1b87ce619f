"""Document fingerprints: every shingle hash below a fixed fraction, one half.

The fraction is the same for all texts, so sketches of parts merge by union, and a short
text's sketch can be looked for in a long one's: the share found estimates the containment.
Shingles are one, two and five words (A-Z lower-cased): one changed word takes all five-word
shingles of a text of six to nine words or most of them, but at most one of one word and two
of two. A shorter text is one shingle of five. So a text of six distinct words with one
changed has eight shingles in common with what it was, of which none is retained in 1 of
256 cases; estimates for texts of a few words are as coarse as their few hashes.

A fingerprint is the hash of the whole text, a colon and the sketch in hex, so equal
texts, and they alone, have equal fingerprints. Likeness is the sketches' Jaccard
similarity; it is 1 for equal texts and 0 where both sketches are empty but the texts
differ. Null texts are empty texts. Rows that share a doc_id are ordered by text, rows without
one come last. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorgrade.llm.batches import pieces, words

SCALE = 2
"""One in so many shingle hashes is retained."""
SHINGLES = (1, 2, 5)


class Sketch:
    """The retained hashes of one text."""

    __slots__ = ("hashes", "text_hash")

    def __init__(self, text_hash: int, hashes: np.ndarray) -> None:
        self.text_hash, self.hashes = text_hash, hashes

    def fingerprint(self) -> str:
        return f"{self.text_hash:016x}:{self.hashes.astype('>u8').tobytes().hex()}"

    def shared(self, other: Sketch) -> int:
        return len(np.intersect1d(self.hashes, other.hashes, assume_unique=True))

    def likeness(self, other: Sketch) -> float:
        if self.text_hash == other.text_hash:
            return 1.0
        shared = self.shared(other)
        union = len(self.hashes) + len(other.hashes) - shared
        return shared / union if union else 0.0

    def containment(self, other: Sketch) -> float:
        """Share of this text to be found in the other one."""
        if self.text_hash == other.text_hash:
            return 1.0
        return self.shared(other) / len(self.hashes) if len(self.hashes) else 0.0


def sketches(texts: list[str], scale: int = SCALE) -> list[Sketch]:
    found = words(pa.array(texts, pa.string()))
    sizes = []
    for size in SHINGLES:
        hashes, bounds = found.shingles(size)
        low = np.flatnonzero(hashes <= np.uint64((2**64 - 1) // scale))
        sizes.append((hashes[low], np.searchsorted(low, bounds)))
    return [
        Sketch(
            xxhash.xxh64_intdigest(text.encode()),
            np.unique(np.concatenate([kept[cuts[i] : cuts[i + 1]] for kept, cuts in sizes])),
        )
        for i, text in enumerate(texts)
    ]


def sketch_documents(documents: DataFrame, scale: int = SCALE) -> DataFrame:
    """(doc_id, fingerprint, sketch) of every document; the sketch as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = sketches([t or "" for t in batch["text"].to_pylist()], scale)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([s.fingerprint() for s in found], pa.string()),
                    pa.array([s.hashes.view(np.int64) for s in found], pa.list_(pa.int64())),
                ],
                names=["doc_id", "fingerprint", "sketch"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, fingerprint string, sketch array<long>"
    )


def merge_sketches(sketched: DataFrame, by: str) -> DataFrame:
    """The sketch of all texts of each group together, one hash a row; no group is gathered."""
    return sketched.select(by, F.explode("sketch").alias("hash")).distinct()


def containment(small: Column, large: Column) -> Column:
    """Estimated share of the text of one sketch to be found in the other's."""
    return F.when(F.size(small) > 0, F.size(F.array_intersect(small, large)) / F.size(small))


_ROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("contained_in_edited", pa.float64()),
        ("contained_in_next", pa.float64()),
    ]
)
_SQL_ROW = (
    "doc_id long, n_chars long, edited_sha256 string, "
    "fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "contained_in_edited double, contained_in_next double"
)
_PARTS = 4
"""Ranges of doc_id for each shuffle partition, so that these are of about one size."""


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(pairs: list[tuple[int | None, str, Sketch, str, Sketch]]) -> pa.RecordBatch:
    changed = [edited(text, following) for _, text, _, following, _ in pairs]
    hashes = [hashlib.sha256(new.encode()).hexdigest() for new in changed]
    marks = sketches(changed)
    del changed
    owns, others = [own for _, _, own, _, _ in pairs], [other for _, _, _, _, other in pairs]
    columns = [
        [doc_id for doc_id, *_ in pairs],
        [len(text) for _, text, *_ in pairs],
        hashes,
        (own.fingerprint() for own in owns),
        (mark.fingerprint() for mark in marks),
        [own.likeness(mark) for own, mark in zip(owns, marks, strict=True)],
        [own.likeness(other) for own, other in zip(owns, others, strict=True)],
        [own.containment(mark) for own, mark in zip(owns, marks, strict=True)],
        [own.containment(other) for own, other in zip(owns, others, strict=True)],
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type, size=len(pairs)) for values, field in zip(columns, _ROW, strict=True)],
        schema=_ROW,
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each with the one after it, but for the last of each range, which is the
    first text of the next range again."""
    held = None
    for batch in pieces(batches, "text"):
        texts = batch["text"].to_pylist()
        rows = zip(batch["doc_id"].to_pylist(), texts, sketches(texts), strict=True)
        pairs = []
        for (doc_id, text, own), last in zip(rows, batch["last"].to_pylist(), strict=True):
            if held is not None:
                pairs.append((*held, text, own))
            held = None if last else (doc_id, text, own)
        yield _compared(pairs)


def compare_with_next(documents: DataFrame) -> DataFrame:
    """Every document against its edited text and the document next below it in doc_id
    (the last against the first).

    Texts are dealt by ranges of doc_id, once. Inside a range neighbours follow each
    other; the first text of the next range is dealt to the end of each, so nothing has to
    be brought together afterwards. Equal ids are ordered by text; null ids come last.
    """
    spark = documents.sparkSession
    n = _PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = documents.select("doc_id").where("doc_id IS NOT NULL")
    cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})
    part = F.size(F.filter(F.lit(cuts) if cuts else F.array(), lambda c: c > F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(part)
    rows = documents.select(part.alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tops = {r.part: r.top for r in rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}  # a number a range
    order = sorted(tops)
    heads = spark.createDataFrame(
        [(b, tops[b], a) for a, b in zip(order, order[1:] + order[:1], strict=True)],
        "part int, top long, before int",
    )
    first = (
        rows.join(F.broadcast(heads), "part")
        .where("doc_id <=> top")
        .groupBy("before")
        .agg(F.min("text").alias("text"))
        .select(F.col("before").alias("part"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("last"))
    )
    return (
        rows.withColumn("last", F.lit(False))
        .union(first)
        .repartition("part")
        .sortWithinPartitions("part", "last", F.col("doc_id").desc_nulls_last(), "text")
        .select("doc_id", "text", "last")
        .mapInArrow(_neighbours, _SQL_ROW)
    )


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))

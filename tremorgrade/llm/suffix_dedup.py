"""Suffix-array dedup: every byte of a string of 200 that starts anywhere else goes.

The order of suffixes is needed only as far as it tells strings of 200 bytes apart, so
suffixes are kept in buckets, as in bucket-pointer refinement, and never written out.
The bucket of a string is an identifier made from those of its parts, and a bucket is
refined by the identifiers found at later offsets:

1. The first buckets hold grams of 64 bytes. Not every position enters one: each string
   of 200 is dealt to the first least gram in it, so a gram stands for a run of strings,
   and equal strings are dealt to equal grams at equal offsets. A bucket with one
   member is final: nothing dealt to it repeats. Equal members of one text whose bytes
   overlap or touch are one row with their number: a text that repeats a few words
   makes one row, not one a repetition.
2. Members of the others are refined by the identifier of all bytes their run covers.
   If two agree, all their strings repeat and they are final.
3. One member of each refined bucket goes on, with the number it stands for. Its run is
   cut into stretches of 16 strings on a grid common to the bucket. A stretch whose
   inner bytes (those all its strings have in common) occur once is final: nothing
   repeats. One all of whose bytes occur twice is final: everything repeats.
4. What is left, mostly where a copy begins or ends, is refined string by string.

Buckets are refined by counting, merged before each shuffle, so a bucket with a third of
all members is no burden; joins back to members can be split where a bucket is large.
Identifiers have 64 bits and always stand beside the bucket's own 64.

Null texts are empty; empty texts and those under 200 bytes lose nothing unless they
share 200 bytes. Rows that repeat a doc_id are copies of each other as any others are;
their ranges are joined by a key of id and text, which only equal rows share. Rows without doc_id are left as they are and not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorgrade.llm.batches import as_bytes, pieces
from tremorgrade.llm.byte_grams import Grams, blocks
from tremorgrade.llm.packed import packed, unpacked
from tremorgrade.llm.row_keys import keyed
from tremorgrade.llm.store import stored

LENGTH = 200
GRAM = 64
STRETCH = 16
_SPAN = LENGTH - GRAM + 1


def _long(ids: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(ids).view(np.int64))


def _of_runs(grams: Grams, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Identifiers of all bytes of each run of strings, and of where in the run the gram is."""
    found = np.zeros(len(first), np.uint64)
    spans = last - first + LENGTH
    for size in np.unique(spans):
        rows = np.flatnonzero(spans == size)
        found[rows] = grams.at(first[rows], int(size))
    return found * np.uint64(0x9E3779B97F4A7C15) + (((at - first) << 16) | (at - last)).astype(np.uint64)


def _folded(
    bucket: np.ndarray, run: np.ndarray, piece: np.ndarray, first: np.ndarray, last: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for equal members of a piece whose bytes overlap or touch: the row of the first,
    the number of bytes from its start to the end of the last, and how many they are."""
    order = np.argsort(run, kind="stable")  # members of a run stay in the order of the text
    same = [c[order[1:]] == c[order[:-1]] for c in (run, bucket, piece)]
    near = first[order[1:]] <= last[order[:-1]] + LENGTH
    heads = np.flatnonzero(np.concatenate(([True], ~(same[0] & same[1] & same[2] & near)))[: len(order)])
    times = np.diff(np.append(heads, len(order)))
    rows = order[heads]
    return rows, last[order[heads + times - 1]] + LENGTH - first[rows], times


def _extent(times: np.ndarray, size: np.ndarray, runs: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Four numbers as one: how many members a row stands for, the bytes they cover together (20
    bits; a piece has fewer), how far the last string of one is from its first, and the gram."""
    return (times << 36) | (size << 16) | (runs << 8) | gram


def _times(extent: Column) -> Column:
    return F.shiftright(extent, 36)


def _size(extent: Column) -> Column:
    return F.shiftright(extent, 16).bitwiseAND(0xFFFFF)


def _anchors(documents: DataFrame) -> DataFrame:
    """(bucket, run, doc_id, first, extent): the members of all first buckets. ``first`` is the
    start of the first string dealt to the gram; ``extent`` see ``_extent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"]), strict=True)
            for held, grams in blocks(rows, LENGTH - 1):
                at, first, last = grams.anchors(LENGTH, GRAM)
                bucket, run, piece = grams.at(at, GRAM), _of_runs(grams, first, last, at), grams.text_of(at)
                own, size, times = _folded(bucket, run, piece, first, last)
                at, first, last, piece = at[own], first[own], last[own], piece[own]
                ids = np.array([h[0] for h in held], np.int64)[piece]
                moved = np.array([h[1] for h in held], np.int64)[piece] - grams.starts[piece]
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(bucket[own]),
                        _long(run[own]),
                        pa.array(ids),
                        pa.array(first + moved, pa.int64()),
                        pa.array(_extent(times, size, last - first, at - first), pa.int64()),
                    ],
                    names=["bucket", "run", "doc_id", "first", "extent"],
                )

    rows = documents.select("doc_id", "text").where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "bucket long, run long, doc_id long, first long, extent long")


def _covered(members: DataFrame) -> DataFrame:
    """(doc_id, start, stop) of the bytes of whole runs."""
    stop = F.col("first") + _size(F.col("extent"))
    return members.select("doc_id", F.col("first").alias("start"), stop.alias("stop"))


_STRINGS = "doc_id long, bucket long, cell int, id long, inner long, start long, stop long, weight long"


def _with_texts(chosen: DataFrame, texts: DataFrame, whole: bool) -> DataFrame:
    """Identifiers of the stretches (``whole``) or single strings of chosen parts of runs.

    chosen: doc_id, bucket, at (start of the gram), first, last (starts of strings), weight.
    """
    by_doc = chosen.groupBy("doc_id").agg(
        F.collect_list(F.struct("bucket", "at", "first", "last", "weight")).alias("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(unpacked(batch["packed"])):
                parts = batch["parts"][i].values.flatten()
                columns = [p.to_numpy(zero_copy_only=False) for p in parts]
                make = _stretches if whole else _strings
                yield from make(batch["doc_id"][i].as_py(), text, *columns)

    return by_doc.join(texts, "doc_id").mapInArrow(run, _STRINGS)


def _local(text: bytes, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, int, Grams]]:
    """Parts of a text by blocks of bounded size: (rows, offset of the block, its identifiers)."""
    order = np.argsort(first, kind="stable")
    block = 1 << 17
    done = 0
    while done < len(order):
        begin = max(0, int(first[order[done]]) - LENGTH)
        stop = int(np.searchsorted(first[order], begin + block, side="right"))
        rows = order[done:stop]
        end = int(last[rows].max()) + 2 * LENGTH
        yield rows, begin, Grams([text[begin:end]])
        done = stop


def _rows(doc_id: int, bucket, cell, ids, inner, start, stop, weight) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, doc_id, np.int64)),
            pa.array(bucket, pa.int64()),
            pa.array(cell, pa.int32()),
            _long(ids),
            _long(inner),
            pa.array(start, pa.int64()),
            pa.array(stop, pa.int64()),
            pa.array(weight, pa.int64()),
        ],
        names=["doc_id", "bucket", "cell", "id", "inner", "start", "stop", "weight"],
    )


def _stretches(doc_id, text, bucket, at, first, last, weight) -> Iterator[pa.RecordBatch]:
    """Every run cut where its distance from the gram passes a multiple of STRETCH."""
    for rows, begin, grams in _local(text, first, last):
        move = grams.starts[0] - begin
        cells = (at[rows] - first[rows]) // STRETCH - (at[rows] - last[rows]) // STRETCH + 1
        owner = np.repeat(rows, cells)
        step = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        cell = np.repeat((at[rows] - last[rows]) // STRETCH, cells) + step
        lowest, highest = at[owner] - cell * STRETCH - STRETCH + 1, at[owner] - cell * STRETCH
        start, stop = np.maximum(lowest, first[owner]), np.minimum(highest, last[owner])
        ids = _of_runs(grams, start + move, stop + move, at[owner] + move)
        inner = grams.at(highest + move, LENGTH - STRETCH + 1)
        yield _rows(doc_id, bucket[owner], cell, ids, inner, start, stop, weight[owner])


def _strings(doc_id, text, bucket, at, first, last, weight) -> Iterator[pa.RecordBatch]:
    for rows, begin, grams in _local(text, first, last):
        move = grams.starts[0] - begin
        count = last[rows] - first[rows] + 1
        owner = np.repeat(rows, count)
        start = first[owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ids = grams.at(start + move, LENGTH)
        cell = (at[owner] - start).astype(np.int32)
        yield _rows(doc_id, bucket[owner], cell, ids, ids, start, start, weight[owner])


def repeated(documents: DataFrame) -> DataFrame:
    """(doc_id, start, stop): byte ranges, overlapping, that together are all bytes to go."""
    anchors = _anchors(documents)
    # Stored, so that both sides of the join come straight from a shuffle and hot buckets split.
    number = F.sum(_times(F.col("extent")))
    shared = anchors.groupBy("bucket").agg(number.alias("in_bucket")).where("in_bucket > 1")
    members = stored(anchors.join(stored(shared, "shared"), "bucket"), "members")
    runs = members.groupBy("bucket", "run").agg(
        number.alias("n"),
        F.min(F.struct("doc_id", "first", "extent")).alias("member"),
        F.max("in_bucket").alias("in_bucket"),
    )
    runs = stored(runs, "runs")
    whole = members.join(runs.where("n > 1").select("bucket", "run"), ["bucket", "run"])

    # Buckets with one run only are final: that run has all of the bucket's members.
    start, extent = F.col("member.first"), F.col("member.extent")
    chosen = runs.where("in_bucket > n").select(
        F.col("member.doc_id").alias("doc_id"),
        "bucket",
        (start + extent.bitwiseAND(0xFF)).alias("at"),
        start.alias("first"),
        (start + F.shiftright(extent, 8).bitwiseAND(0xFF)).alias("last"),
        F.col("n").alias("weight"),
    )
    texts = packed(documents).join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = stored(texts, "texts")

    stretches = stored(_with_texts(chosen, texts, whole=True), "stretches")
    alive = stretches.groupBy("bucket", "cell", "inner").agg(F.sum("weight").alias("k")).where("k > 1")
    stretches = stretches.join(stored(alive.drop("k"), "inner"), ["bucket", "cell", "inner"])
    counts = stretches.groupBy("bucket", "cell", "id").agg(F.sum("weight").alias("total"))
    stretches = stored(stretches.join(counts, ["bucket", "cell", "id"]), "alive")
    # Members a chosen one stands for are covered already: only their partners need its strings.
    full = stretches.where("total > 1 AND weight = 1")
    left = (
        stretches.join(
            chosen.select("doc_id", "bucket", "at", F.col("first").alias("a"), F.col("last").alias("z")),
            ["doc_id", "bucket"],
        )
        .where("start >= a AND stop <= z")
        .select("doc_id", "bucket", "at", "id", F.col("cell"), "start", "stop", "total", "weight")
    )
    # One of each kind of equal stretches is enough, with the number of all of them.
    left = left.groupBy("bucket", "cell", "id").agg(
        F.min(F.struct("doc_id", "at", "start", "stop")).alias("one"), F.max("total").alias("weight")
    )
    kinds = left.groupBy("bucket", "cell").agg(F.count("*").alias("kinds")).where("kinds > 1")
    left = left.join(kinds.select("bucket", "cell"), ["bucket", "cell"]).select(
        "one.doc_id", "bucket", "one.at", F.col("one.start").alias("first"), F.col("one.stop").alias("last"), "weight"
    )
    strings = stored(_with_texts(left, texts, whole=False), "strings")
    twice = strings.groupBy("bucket", "cell", "id").agg(F.sum("weight").alias("total")).where("total > 1")
    single = strings.where("weight = 1").join(twice.drop("total"), ["bucket", "cell", "id"])
    ranges = [r.select("doc_id", "start", (F.col("stop") + LENGTH).alias("stop")) for r in (full, single)]
    return _covered(whole).union(ranges[0]).union(ranges[1])


def cut_repeats(documents: DataFrame, *others: str) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) and other columns as they are: what is left of each
    document's bytes, and the maximal removed runs as (start, stop)."""
    columns = "n_bytes long, kept binary, spans array<struct<start:long,stop:long>>"
    return _cut_rows(documents, others, _as_bytes_left, columns)


def cut_texts(documents: DataFrame, *others: str) -> DataFrame:
    """(doc_id, text, length) and other columns as they are: what is left of each document as
    text, without characters cut in two, and its number of characters. Made where the bytes
    are cut, so that a task needs one Python worker, not two at once."""
    return _cut_rows(documents, others, _as_text_left, "text string, length long")


_Spans = list[list[tuple[int, int]]]


def _as_bytes_left(kept: list[bytes], spans: _Spans, sizes: list[int]) -> list[pa.Array]:
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    marked = [[{"start": a, "stop": b} for a, b in own] for own in spans]
    return [pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(marked, pa.list_(span))]


def _as_text_left(kept: list[bytes], spans: _Spans, sizes: list[int]) -> list[pa.Array]:
    texts = [k.decode("utf-8", "ignore") for k in kept]
    return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]


_Shape = Callable[[list[bytes], _Spans, list[int]], list[pa.Array]]


def _cut_rows(documents: DataFrame, others: tuple[str, ...], shape: _Shape, columns: str) -> DataFrame:
    rows = keyed(documents)
    if rows is None:
        return _cut(documents, others, shape, columns)
    own = rows.select(F.col("row").alias("doc_id"), "text", F.col("doc_id").alias("own_id"), *others)
    found = _cut(own, ("own_id", *others), shape, columns)
    return found.drop("doc_id").withColumnRenamed("own_id", "doc_id").select("doc_id", *_names(columns), *others)


def _names(columns: str) -> list[str]:
    return T.StructType.fromDDL(columns).names


def _cut(documents: DataFrame, others: tuple[str, ...], shape: _Shape, columns: str) -> DataFrame:
    """The same where only equal rows share a doc_id."""
    ranges = repeated(documents)
    spans = ranges.groupBy("doc_id").agg(
        F.collect_set(F.struct("start", "stop")).alias("ranges")  # a document's own, no more than its bytes
    )
    names = ["doc_id", *_names(columns), *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch["ranges"]
            kept, spans, sizes = [], [], []
            for i, text in enumerate(unpacked(batch["packed"])):
                own = _merged(ranges[i], len(text))
                at, rest = 0, []
                for start, stop in own:
                    rest.append(text[at:start])
                    at = stop
                kept.append(b"".join([*rest, text[at:]]))
                spans.append(own)
                sizes.append(len(text))
            found = [batch["doc_id"], *shape(kept, spans, sizes), *(batch[c] for c in others)]
            yield pa.RecordBatch.from_arrays(found, names=names)

    texts = packed(documents, *others)
    schema = T.StructType([*T.StructType.fromDDL(f"doc_id long, {columns}"), *texts.schema.fields[2:]])
    # A merge join in any case: texts are packed before its shuffle, in a task of their own.
    return texts.join(spans.hint("merge"), "doc_id", "left").mapInArrow(run, schema)


def _merged(ranges: pa.Scalar, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the ranges' union."""
    if not ranges.is_valid or not len(ranges.values):
        return []
    start, stop = (c.to_numpy(zero_copy_only=False) for c in ranges.values.flatten())
    marks = np.zeros(size + 1, np.int32)
    np.add.at(marks, start, 1)
    np.add.at(marks, stop, -1)
    inside = np.concatenate(([0], (np.cumsum(marks)[:-1] > 0).astype(np.int8), [0]))
    edges = np.diff(inside)
    return list(
        zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = batch["kept"].to_pylist(), batch["spans"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["n_bytes"],
                    pa.array([sum(s["stop"] - s["start"] for s in own) for own in spans], pa.int64()),
                    pa.array([len(own) for own in spans], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    cut = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )

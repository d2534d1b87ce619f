"""Token ids in Parquet files that allow selective reads.

Documents are dealt by ranges of doc_id and written in that order, one row each:
doc_id, the number of ids, where they begin in the file, and the ids as a list
column. Ids get a dictionary (a vocabulary fits into one, so an id takes 16 bits or
fewer), the numbers delta encoding; row groups and pages are small, and Parquet's page
indexes let a reader fetch the pages of a few documents, or the numbers alone. A
manifest of one row a file, its first id and its number of ids, turns places in a file
into places in the whole.

Encoding is the tokenizers library's, word by word: this vocabulary's pre-tokenizer
never joins across white space, so each distinct word of a piece of text is encoded
once and the ids of texts are put together from that. Null texts are empty and get
the end id alone; equal doc_ids are ordered by text.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorgrade.llm.batches import pieces
from tremorgrade.llm.memory import Memory
from tremorgrade.llm.store import new_path

END_ID = 2
_MARKS = string.punctuation.replace("'", "")
_CUT_BEHIND = r"[\p{L}\p{N}]$"
_ENDS_IN_MARK = (
    r"[\x{130}\x{958}-\x{95F}\x{9DC}-\x{9DD}\x{9DF}\x{A33}\x{A36}\x{A59}-\x{A5B}\x{A5E}\x{B5C}-\x{B5D}"
    r"\x{F43}\x{F4D}\x{F52}\x{F57}\x{F5C}\x{F69}\x{FB1D}\x{FB1F}\x{FB2A}-\x{FB4E}]$"
)
"""Letters that end in a combining mark once normalized and lower-cased: marks join that one."""


@dataclass(frozen=True)
class Layout:
    row_group_bytes: int = 16 << 20
    page_bytes: int = 128 << 10
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.compression,
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#doc_id": "false",
            "parquet.enable.dictionary#file_start": "false",
            "parquet.enable.dictionary#n_tokens": "false",
        }


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids of words, each distinct one encoded once as long as it is remembered."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.memory = Memory(self._encode_words)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, each text's with the end id, and their numbers."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        cores, cut, tails = _cut(coded.dictionary)
        core, tail, none = self.memory.numbers(_as_list(cores.dictionary), tails, [""])
        pairs = np.stack((core[cores.indices.to_numpy()], np.repeat(none, len(cores))), axis=1)
        pairs[cut, 1] = tail
        parts = pairs[coded.indices.to_numpy()]
        sizes = self.memory.lengths[parts].sum(axis=1)
        words = np.diff(split.offsets.to_numpy()).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(words)]
        counts = np.diff(np.concatenate(([0], ends)))
        return np.insert(self.memory.ids(parts.ravel()), ends, END_ID), counts + 1

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of lower-case Latin letters, which normalizer and pre-tokenizer leave as they
        are, go to the vocabulary's model at once; all others through the whole tokenizer."""
        found: list[list[int] | None] = []
        others = []
        for word in words:
            if word.isascii():
                plain, written = word.isalpha() and word.islower(), word
            else:
                plain = word.isalpha() and max(word) < "ƀ" and word == word.lower()
                written = "".join([self.letters[b] for b in word.encode()]) if plain else ""
            if plain:
                found.append([t.id for t in self.model.tokenize(written)])
            else:
                others.append(word)
                found.append(None)
        rest = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        every = [next(rest).ids if f is None else f for f in found]
        lengths = np.array([len(ids) for ids in every], np.int64)
        return np.fromiter((i for ids in every for i in ids), np.int32), lengths


def _as_list(words: pa.Array) -> list[str]:
    """What to_pylist gives, without an object of Arrow's for each word."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _cut(words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, list[str]]:
    """Lower-cased words without the marks that follow a last letter or digit; which words had
    such marks, and the marks of these.

    Words that might hold a special token are left whole and as they are.
    """
    lower = pc.ascii_lower(words)
    core = pc.ascii_rtrim(lower, characters=_MARKS)
    ends = pc.and_not(pc.match_substring_regex(core, _CUT_BEHIND), pc.match_substring_regex(core, _ENDS_IN_MARK))
    core = pc.if_else(ends, core, lower)
    core = pc.if_else(pc.match_substring(words, "<|"), words, core)
    shorter = pc.less(pc.binary_length(core), pc.binary_length(lower))
    cut = np.flatnonzero(shorter.to_numpy(zero_copy_only=False))
    short, whole = _as_list(core.take(pa.array(cut))), _as_list(lower.take(pa.array(cut)))
    return core.dictionary_encode(), cut, [w[len(c) :] for c, w in zip(short, whole, strict=True)]


_SQL_ROW = "doc_id long, n_tokens long, file_start long, ids array<int>, part int"


def write_tokens(documents: DataFrame, path: str, file: str, layout: Layout | None = None) -> None:
    """Token files under ``path``/tokens, the manifest under ``path``/manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file)
        part, start = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text"):
            ids, counts = encoder.encode(batch["text"])
            offsets = np.concatenate(([0], np.cumsum(counts)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(counts),
                    pa.array(start + offsets[:-1]),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(np.full(len(counts), part, np.int32)),
                ],
                names=["doc_id", "n_tokens", "file_start", "ids", "part"],
            )
            start += int(offsets[-1])

    ordered = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    )
    spark = documents.sparkSession
    encoded = ordered.mapInArrow(run, _SQL_ROW)
    encoded.write.options(**(layout or Layout()).options()).parquet(f"{path}/tokens")
    totals = (
        spark.read.parquet(f"{path}/tokens")
        .groupBy("part")
        .agg(F.sum("n_tokens").alias("n_tokens"))
        .orderBy("part")
        .collect()  # one row a file; partitions are ranges in order
    )
    manifest, first = [], 0
    for part, n_tokens in totals:
        manifest.append((part, first, n_tokens))
        first += n_tokens
    spark.createDataFrame(manifest, "part int, first long, n_tokens long").write.parquet(
        f"{path}/manifest"
    )


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(file: str) -> WordEncoder:
    """One for each Python worker, which serves many tasks."""
    if file not in _ENCODERS:
        _ENCODERS[file] = WordEncoder(file)
    return _ENCODERS[file]


def read_tokens(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """doc_id, start in the whole, n_tokens and ids, or some of these columns."""
    tokens = spark.read.parquet(f"{path}/tokens")
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "first")
    placed = tokens.join(F.broadcast(manifest), "part")  # one row a file
    found = placed.select("doc_id", (F.col("first") + F.col("file_start")).alias("start"), "n_tokens", "ids")
    return found.select(*columns) if columns else found


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, number of ids and the CRC-32 of the ids as little-endian 32-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            offsets = lists.offsets.to_numpy()
            values = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["start"],
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        path,
        public_tokenizers.path("word_bpe_49k.json"),
    )
    return checksums(read_tokens(spark, path))

"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and their order come from a public vocabulary file. It holds merge ranks, not
probabilities, so a piece of rank r gets the log score -log(r + 1), as frequencies
fall with rank; pieces without a rank get the lowest one. A character no piece covers
costs ten more than the lowest score and becomes its bytes' pieces.

Blanks are written into the pieces themselves: one goes before every text, and
decoding takes it off. No piece reaches over the start of a run of blanks or over a
line break, so the best split of a text is the best split of the stretches between,
and each distinct stretch of a batch is split once, all of them side by side in arrays;
a long stretch, as of text without blanks, goes by itself, place by place in blocks.
The white-space marker U+2581 counts as a blank, so such a text does not decode to
itself; all others do. Null texts are empty: no ids, decoded to the empty text.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorgrade.llm.batches import pieces
from tremorgrade.llm.memory import Memory
from tremorgrade.llm.row_keys import put_back, set_aside

MARKER = "▁"
_UNKNOWN_COST = 10.0
_CHUNK_BYTES = 100_000
_BLOCK = 512
_KEPT = 300_000
_LONG = 512
"""A stretch of more bytes goes by itself."""
_LONG_BLOCK = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes with blanks for markers; scores; the piece of each byte."""

    pieces: list[bytes]
    scores: np.ndarray
    normal: np.ndarray
    of_byte: np.ndarray


@functools.cache
def load(file: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    size = model.vocab_size()
    texts = [model.id_to_piece(i) for i in range(size)]
    special = np.array([model.is_control(i) or model.is_unknown(i) for i in range(size)])
    as_byte = np.array([model.is_byte(i) for i in range(size)])
    of_byte = np.full(256, -1, np.int64)
    for i in np.flatnonzero(as_byte):
        of_byte[int(texts[i][3:5], 16)] = i
    normal = ~special & ~as_byte
    ranks = np.array([-model.get_score(i) for i in range(size)])
    ranked = normal & (ranks < size)
    scores = np.full(size, -np.log(ranks[ranked].max() + 2))
    scores[ranked] = -np.log(ranks[ranked] + 1)
    encoded = [
        bytes([int(t[3:5], 16)]) if b else (b"" if s else t.replace(MARKER, " ").encode())
        for t, b, s in zip(texts, as_byte, special, strict=True)
    ]
    for piece in (p for p, n in zip(encoded, normal, strict=True) if n):
        if b"\n" in piece or b" " in piece.lstrip(b" "):
            raise ValueError(f"a piece reaches over a cut: {piece!r}")
    return Vocabulary(encoded, scores, normal, of_byte)


class DoubleArray:
    """A trie in two arrays: the child of state s by byte b is base[s] + b if its check is s."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        size = 1 << 16
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        self.check[0] = 0
        self.first_free = 1
        level = [(0, sorted(keys.items()), 0)]
        while level:
            deeper = []
            for state, items, depth in level:
                children: dict[int, list[tuple[bytes, int]]] = {}
                for key, value in items:
                    if len(key) == depth:
                        self.value[state] = value
                    else:
                        children.setdefault(key[depth], []).append((key, value))
                if not children:
                    continue
                base = self._room_for(list(children))
                self.base[state] = base
                for label, below in children.items():
                    self.check[base + label] = state
                    deeper.append((base + label, below, depth + 1))
            level = deeper

    def _room_for(self, labels: list[int]) -> int:
        """The first base that leaves all these children a free place, searched blockwise."""
        while self.check[self.first_free] >= 0:
            self.first_free += 1
        start = max(1, self.first_free - min(labels))
        while True:
            while start + _BLOCK + 256 > len(self.check):
                self._grow()
            free = self.check[start + labels[0] : start + labels[0] + _BLOCK] < 0
            for label in labels[1:]:
                free &= self.check[start + label : start + label + _BLOCK] < 0
            if free.any():
                return start + int(free.argmax())
            start += _BLOCK

    def _grow(self) -> None:
        more = len(self.base)
        self.base = np.concatenate((self.base, np.zeros(more, np.int32)))
        self.check = np.concatenate((self.check, np.full(more, -1, np.int32)))
        self.value = np.concatenate((self.value, np.full(more, -1, np.int32)))

    def matches(self, text: np.ndarray, at: np.ndarray, stop: np.ndarray):
        """All keys in ``text`` that begin at ``at`` and end by ``stop``: (index in at, length, value)."""
        state = np.zeros(len(at), np.int64)
        index = np.arange(len(at))
        found = []
        length = 0
        while len(index):
            inside = at[index] + length < stop[index]
            index, state = index[inside], state[inside]
            following = self.base[state] + text[at[index] + length]
            there = self.check[following] == state
            there &= following != 0
            index, state = index[there], following[there].astype(np.int64)
            length += 1
            value = self.value[state]
            hit = value >= 0
            found.append((index[hit], np.full(int(hit.sum()), length), value[hit]))
        return [np.concatenate(part) for part in zip(*found, strict=True)] if found else [index] * 3


class Unigram:
    """Best splits of many stretches at once."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        keys = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.normal[i]}
        self.trie = DoubleArray(keys)
        self.memory = Memory(self.split_all, _KEPT)
        self.unknown = float(vocabulary.scores[vocabulary.normal].min()) - _UNKNOWN_COST

    def split_all(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches, and the number for each, in chunks of bounded size."""
        encoded = [s.encode() for s in stretches]
        bounds = np.concatenate(([0], np.cumsum([len(e) for e in encoded])))
        ids, sizes = [], []
        start = 0
        while start < len(encoded):
            if len(encoded[start]) > _LONG:
                ids.append(self.split_long(encoded[start]))
                sizes.append(np.array([len(ids[-1])]))
                start += 1
                continue
            stop = int(np.searchsorted(bounds, bounds[start] + _CHUNK_BYTES, side="right")) - 1
            stop = next((i for i in range(start, stop) if len(encoded[i]) > _LONG), stop)
            own = np.frombuffer(b"".join(encoded[start:stop]), np.uint8).astype(np.int64)
            found, count = self.split(own, bounds[start : stop + 1] - bounds[start])
            ids.append(found)
            sizes.append(count)
            start = stop
        return np.concatenate(ids), np.concatenate(sizes)

    def split(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches text[bounds[i] : bounds[i + 1]], and the number for each."""
        size = len(text)
        stretch = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        heads = np.flatnonzero((text & 0xC0) != 0x80)
        at, lengths, ids = self.trie.matches(text, heads, bounds[stretch[heads] + 1])
        char = np.diff(np.append(heads, size))
        char = np.minimum(char, bounds[stretch[heads] + 1] - heads)
        covered = np.zeros(len(heads), bool)
        covered[at[lengths == char[at]]] = True
        bare = np.flatnonzero(~covered)
        starts = np.concatenate((heads[at], heads[bare]))
        ends = starts + np.concatenate((lengths, char[bare]))
        scores = np.concatenate((self.vocabulary.scores[ids], np.full(len(bare), self.unknown)))
        ids = np.concatenate((ids, np.full(len(bare), -1))).astype(np.int64)
        best, from_, piece = self._forward(size, bounds, stretch, starts, ends, scores, ids)
        return self._backward(text, bounds, stretch, from_, piece)

    def split_long(self, encoded: bytes) -> np.ndarray:
        """The ids ``split`` gives for one stretch, in time and memory that grow with its length.

        Every edge is followed from its start, starts in order, so the first of equal scores
        is the longest piece here too.
        """
        text = np.frombuffer(encoded, np.uint8)
        size = len(text)
        heads = np.append(np.flatnonzero((text & 0xC0) != 0x80), size)
        length, piece = np.zeros(size + 1, np.int32), np.full(size + 1, -1, np.int32)
        best = [0.0]  # of places from the block's first
        for a in range(0, len(heads) - 1, _LONG_BLOCK):
            block = heads[a : a + _LONG_BLOCK + 1]
            origin, char = int(block[0]), np.diff(block)
            block = block[:-1]
            at, lengths, ids = self.trie.matches(text, block, np.full(len(block), size))
            covered = np.zeros(len(block), bool)
            covered[at[lengths == char[at]]] = True
            bare = np.flatnonzero(~covered)
            starts = np.concatenate((block[at], block[bare])) - origin
            stops = starts + np.concatenate((lengths, char[bare]))
            scores = np.concatenate((self.vocabulary.scores[ids], np.full(len(bare), self.unknown)))
            ids = np.concatenate((ids, np.full(len(bare), -1)))
            order = np.lexsort((stops, starts))
            most = int(stops.max())
            best += [-np.inf] * (most + 1 - len(best))
            from_, by = [-1] * (most + 1), [-1] * (most + 1)
            edges = (x[order].tolist() for x in (starts, stops, scores, ids))
            for start, stop, score, number in zip(*edges, strict=True):
                total = best[start] + score
                if total > best[stop]:
                    best[stop], from_[stop], by[stop] = total, start, number
            places = np.array(from_)
            new = np.flatnonzero(places >= 0)
            length[origin + new] = new - places[new]
            piece[origin + new] = np.array(by)[new]
            done = int(heads[min(a + _LONG_BLOCK, len(heads) - 1)]) - origin
            best = best[done:]
        return self._walk_back(encoded, length, piece)

    def _walk_back(self, encoded: bytes, length: np.ndarray, piece: np.ndarray) -> np.ndarray:
        found = array("q")
        at = len(encoded)
        while at:
            start, number = at - int(length[at]), int(piece[at])
            if number >= 0:
                found.append(number)
            else:  # a character without a piece becomes the pieces of its bytes
                found.extend(int(self.vocabulary.of_byte[b]) for b in reversed(encoded[start:at]))
            at = start
        return np.array(found, np.int64)[::-1]

    def _forward(self, size, bounds, stretch, starts, ends, scores, ids):
        """Best score up to each position; edges are taken in order of their end's place in
        the stretch, ties go to the longest piece."""
        origin = bounds[stretch[starts]]
        place = ends - origin
        order = np.lexsort((starts, ends, place))
        starts, ends, scores, ids, place = (a[order] for a in (starts, ends, scores, ids, place))
        best = np.full(size + 1, -np.inf)
        from_ = np.zeros(size + 1, np.int64)
        piece = np.full(size + 1, -1, np.int64)
        cuts = np.flatnonzero(np.diff(place)) + 1
        first = bounds[:-1]
        is_first = np.zeros(size + 1, bool)
        is_first[first] = True
        for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
            s, e = starts[a:b], ends[a:b]
            total = np.where(is_first[s], 0.0, best[s]) + scores[a:b]
            group = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
            top = np.maximum.reduceat(total, group)
            sizes = np.diff(np.append(group, len(e)))
            hit = np.flatnonzero(total == np.repeat(top, sizes))
            winner = hit[np.searchsorted(hit, group)]
            best[e[winner]] = top
            from_[e[winner]] = s[winner]
            piece[e[winner]] = ids[a:b][winner]
        return best, from_, piece

    def _backward(self, text, bounds, stretch, from_, piece):
        at = bounds[1:].copy()
        which = np.arange(len(at))
        steps = []
        while True:
            live = at > bounds[which]
            at, which = at[live], which[live]
            if not len(at):
                break
            steps.append((which, from_[at], at.copy(), piece[at]))
            at = from_[at]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
        which, start, end, ids = (np.concatenate(part) for part in zip(*steps, strict=True))
        order = np.argsort(start, kind="stable")
        which, start, end, ids = which[order], start[order], end[order], ids[order]
        # A character without a piece becomes the pieces of its bytes.
        repeat = np.where(ids < 0, end - start, 1)
        offset = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        ids, start, which = np.repeat(ids, repeat), np.repeat(start, repeat), np.repeat(which, repeat)
        ids = np.where(ids < 0, self.vocabulary.of_byte[text[start + offset]], ids)
        return ids, np.bincount(which, minlength=len(bounds) - 1)


def encode_texts(model: Unigram, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number for each text."""
    plain = pc.replace_substring(pc.fill_null(texts, ""), MARKER, " ")
    empty = pc.equal(plain, "").to_numpy(zero_copy_only=False)
    plain = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, ""))
    if isinstance(plain, pa.ChunkedArray):
        plain = plain.combine_chunks()
    plain = pa.concat_arrays([plain])
    offsets = np.frombuffer(plain.buffers()[1], np.int32)[: len(plain) + 1].astype(np.int64)
    data = plain.buffers()[2]
    text = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    previous = np.concatenate(([0], text[:-1]))
    cut = ((text == 32) & (previous != 32)) | (text == 10) | (previous == 10)
    cut[offsets[:-1][~empty]] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(text)).astype(np.int32)
    stretches = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), data)
    coded = stretches.dictionary_encode()
    (numbers,) = model.memory.numbers(coded.dictionary.to_pylist())
    places = numbers[coded.indices.to_numpy()]
    all_ids, lengths = model.memory.ids(places), model.memory.lengths[places]
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(text_of, weights=lengths, minlength=len(texts)).astype(np.int64)
    return all_ids, counts


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        sizes = np.array([len(p) for p in vocabulary.pieces], np.int64)
        self.text = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Bytes of each text ids[bounds[i] : bounds[i + 1]], without the first blank."""
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        before = ends[:-1]
        text = self.text[np.repeat(self.starts[ids] - before, sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[bounds]
        return [
            text[a + 1 : b] if text[a : a + 1] == b" " else text[a:b]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ]


@functools.cache
def _unigram(file: str) -> Unigram:
    """One for each Python worker."""
    return Unigram(load(file))


def _encode(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    model = _unigram(file)
    for batch in pieces(batches, "text"):
        ids, counts = encode_texts(model, batch["text"])
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        column = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, column], names=[*batch.schema.names, "token_ids"]
        )


def encode(documents: DataFrame, file: str) -> DataFrame:
    """The documents with their ids as column ``token_ids``; one of that name is replaced."""
    documents = documents.drop("token_ids")
    ids = T.StructField("token_ids", T.ArrayType(T.IntegerType()))
    aside = set_aside(documents)
    encoded = aside.mapInArrow(lambda batches: _encode(batches, file), T.StructType([*aside.schema.fields, ids]))
    return put_back(encoded, documents.withColumn("token_ids", F.lit(None)), token_ids="token_ids")


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """(doc_id, decoded) of rows with doc_id and token_ids; bytes that are not UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load(file))
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in _decoded(decoder, batch)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "decoded"]
            )

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, decoded string")


def _decoded(decoder: Decoder, batch: pa.RecordBatch) -> list[bytes]:
    lists = batch["token_ids"]
    offsets = lists.offsets.to_numpy().astype(np.int64)
    ids = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    return decoder.decode(ids, offsets - offsets[0])


_DIGESTS = {
    "doc_id": "long", "n_tokens": "long", "n_byte_pieces": "long",
    "ids_crc32": "long", "decoded_crc32": "long", "round_trip": "boolean",
}


def _digest(
    batches: Iterator[pa.RecordBatch], file: str, others: tuple[str, ...]
) -> Iterator[pa.RecordBatch]:
    vocabulary = load(file)
    decoder = Decoder(vocabulary)
    is_byte = np.zeros(len(vocabulary.pieces), bool)
    is_byte[vocabulary.of_byte[vocabulary.of_byte >= 0]] = True
    for batch in batches:
        lists = batch["token_ids"]
        offsets = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy()
        fallen = np.concatenate(([0], np.cumsum(is_byte[ids])))
        decoded = _decoded(decoder, batch)
        texts = pc.fill_null(batch["text"].cast(pa.binary()), b"").to_pylist()
        values = memoryview(ids.astype("<u4")).cast("B")
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array(np.diff(offsets)),
                pa.array(fallen[offsets[1:]] - fallen[offsets[:-1]]),
                pa.array(
                    [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)],
                    pa.int64(),
                ),
                pa.array([zlib.crc32(t) for t in decoded], pa.int64()),
                pa.array([a == b for a, b in zip(decoded, texts, strict=True)]),
                *(batch[c] for c in others),
            ],
            names=[*_DIGESTS, *others],
        )


def round_trips(documents: DataFrame, file: str, *others: str) -> DataFrame:
    """Each document encoded and decoded again, by the same task: number of ids, of byte pieces,
    CRC-32 of the ids (little-endian 32-bit), CRC-32 of the decoded bytes, whether they are the
    text's, and other columns as they are, ``token_ids`` among them if asked for."""
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema} | {"token_ids": "array<int>"}
    kinds = _DIGESTS | {c: kinds[c] for c in others}
    chosen = documents.select("doc_id", "text", *[c for c in others if c != "token_ids"])
    return chosen.mapInArrow(
        lambda batches: _digest(_encode(batches, file), file, others),
        ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file = public_tokenizers.path("piece_bpe_32k.model")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trips(documents, file)

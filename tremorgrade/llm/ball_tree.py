"""Exact ranked lexical search with sparse ball trees.

A document is a sparse vector: per query term its weight times the term's impact in the
document, whole numbers. Its score for a query is the inner product with the query's term
counts. Documents are indexed where they lie: every task builds trees over runs of
documents, each node with the centroid c of its vectors and two radii: r, the farthest any
vector x below lies from it, and sparsely, for each term t some of them have, r_t, the most
any lies above it along t. So no product is above <q, c> + min(|q| r, sum of q_t r_t).
Texts share few terms, which leaves r alone too wide to prune; the r_t make the difference.
Bounds are rounded up by more than doubles can err. Per query a tree is searched best bound
first, until no bound reaches the k-th best score known in the task; leaves are scored in
whole numbers. What is left, k documents a task and query, is ranked together.

Every text is read once a block of queries; vectors go to the shared folder, the corpus
counts N, L and df come from them. Queries are taken in blocks of some TERMS terms, so what
the driver and the tasks hold does not grow with their number.

Null and empty texts, and texts without a term, are not counted and never found. A query
without a term, or whose terms no document has, has no rows. Equal scores go by doc_id,
nulls last; a repeated doc_id is ranked once a row. A repeated item_id is answered once a
row. Empty tables give no rows. Other columns of either table are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorgrade.llm import ascii_terms
from tremorgrade.llm.batches import pieces
from tremorgrade.llm.store import stored

TERMS = 20_000
"""Terms of a block of queries; a longer query is a block of its own."""
_TREE_ENTRIES = 400_000
"""Vector entries a tree holds at most, unless one document has more."""
_LEAF = 32
_TABLE = ascii_terms.byte_table("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Relative slack of bounds; doubles err by less than the number of terms times 2**-52.
_SLACK = 1e-9


@dataclass(frozen=True)
class Query:
    item_id: object
    counts: dict[str, int]


@dataclass(frozen=True)
class Corpus:
    """What scoring needs: documents with a term, all their terms, and per query term its weight."""

    documents: int
    terms: int
    weights: np.ndarray


def search(documents: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each query
    (item_id, text), scores above 0 only."""
    spark = documents.sparkSession
    kinds = (queries.schema["item_id"].dataType, documents.schema["doc_id"].dataType)
    found = [_search_block(documents, block, k, kinds) for block in _blocks(queries)]
    schema = T.StructType(
        [
            T.StructField("item_id", kinds[0]),
            T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", kinds[1]),
            T.StructField("score", T.LongType()),
        ]
    )
    result = spark.createDataFrame([], schema)
    for rows in found:
        result = result.unionByName(rows) if result is not None else rows
    return result


def _blocks(queries: DataFrame) -> Iterator[list[Query]]:
    block: list[Query] = []
    size = 0
    for item_id, text in queries.select("item_id", "text").toLocalIterator():
        found, _ = ascii_terms.terms(pa.array([text], pa.string()), _TABLE)
        counts = Counter(found.to_pylist())
        if not counts:
            continue
        if block and size + len(counts) > TERMS:
            yield block
            block, size = [], 0
        block.append(Query(item_id, dict(counts)))
        size += len(counts)
    if block:
        yield block


def _search_block(documents: DataFrame, block: list[Query], k: int, kinds) -> DataFrame:
    vocabulary = sorted({term for query in block for term in query.counts})
    vectors = stored(term_counts(documents, vocabulary), "vectors")
    corpus = _corpus(vectors, len(vocabulary))
    number = {term: i for i, term in enumerate(vocabulary)}
    asked = [
        (
            np.array([number[t] for t in q.counts], np.int64),
            np.array(list(q.counts.values()), np.int64),
        )
        for q in block
    ]
    best = vectors.where("size(terms) > 0").mapInArrow(
        lambda batches: _best(batches, corpus, asked, k),
        T.StructType(
            [
                T.StructField("query", T.IntegerType()),
                T.StructField("doc_id", kinds[1]),
                T.StructField("score", T.LongType()),
            ]
        ),
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = documents.sparkSession.createDataFrame(
        [(i, q.item_id) for i, q in enumerate(block)],
        T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", kinds[0])]),
    )
    # One row a query of the block.
    return ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")


def term_counts(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (its terms), and of the vocabulary the terms it has (as places) and how often;
    a row for each document with a term."""
    kind = documents.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for piece in pieces(batches, "text"):
            found, n = ascii_terms.terms(piece["text"], _TABLE)
            place = pc.fill_null(pc.index_in(found, known), -1).to_numpy().astype(np.int64)
            text = np.repeat(np.arange(len(n)), n)[place >= 0]
            keys, counts = np.unique(
                text * len(vocabulary) + place[place >= 0], return_counts=True
            )
            ends = np.searchsorted(keys, np.arange(1, len(n) + 1) * len(vocabulary))
            some = np.flatnonzero(n)
            sizes = np.diff(ends, prepend=0)[some]
            bounds = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            places = pa.array((keys % len(vocabulary)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    piece["doc_id"].take(pa.array(some)),
                    pa.array(n[some].astype(np.int64)),
                    pa.ListArray.from_arrays(bounds, places),
                    pa.ListArray.from_arrays(bounds, pa.array(counts.astype(np.int64))),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _corpus(vectors: DataFrame, size: int) -> Corpus:
    """One row of sums, and one row per query term of the block."""
    documents, terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(size, np.int64)
    for term, df in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    return Corpus(documents, terms, weights)


def impacts(n: np.ndarray, counts: np.ndarray, corpus: Corpus) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 12 * m) for terms of documents with n terms."""
    if int(n.max(initial=0)) * corpus.documents * 25 < 2**63:
        longer = 25 * n * corpus.documents // corpus.terms
    else:
        longer = np.array([25 * int(x) * corpus.documents // corpus.terms for x in n], np.int64)
    m = 100 - 25 + longer
    return 1_000_000_000 * counts // (1000 * counts + 12 * m)


def _best(batches, corpus: Corpus, asked, k: int) -> Iterator[pa.RecordBatch]:
    tops = [Top(k) for _ in asked]
    kind = pa.int64()
    for batch in batches:
        kind = batch["doc_id"].type
        for ids, vectors in _runs(batch, corpus):
            tree = BallTree(vectors, len(corpus.weights))
            for (terms, counts), top in zip(asked, tops, strict=True):
                tree.search(terms, counts, top, ids)
    rows = [(i, doc_id, score) for i, top in enumerate(tops) for score, doc_id in top.rows]
    if rows:
        numbers, ids, scores = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(ids, kind), pa.array(scores, pa.int64())],
            names=["query", "doc_id", "score"],
        )


def _runs(batch: pa.RecordBatch, corpus: Corpus) -> Iterator[tuple[list, Vectors]]:
    """Documents of a batch in runs of bounded size, as vectors."""
    terms, counts = batch["terms"], batch["counts"]
    sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    columns = terms.flatten().to_numpy().astype(np.int64)
    tf = counts.flatten().to_numpy()
    n = np.repeat(batch["n"].to_numpy(), sizes)
    values = corpus.weights[columns] * impacts(n, tf, corpus)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _TREE_ENTRIES, side="right")))
        bounds = np.concatenate(([0], ends[start:stop] - before))
        part = slice(before, int(ends[stop - 1]))
        yield (
            batch["doc_id"].slice(start, stop - start).to_pylist(),
            Vectors(bounds, columns[part], values[part]),
        )
        start = stop


class Top:
    """The k best (score, doc_id): higher scores first, then smaller ids, null last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows: list[tuple[int, object]] = []

    @property
    def least(self) -> int:
        """Scores below this cannot enter."""
        return self.rows[-1][0] if len(self.rows) >= self.k else 1

    def add(self, rows: list[tuple[int, object]]) -> None:
        self.rows += rows
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        del self.rows[self.k :]


@dataclass
class Vectors:
    """Sparse rows: entries bounds[i] : bounds[i + 1] are row i. No row is empty."""

    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> Vectors:
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        entries = np.repeat(self.bounds[rows] - bounds[:-1], sizes) + np.arange(bounds[-1])
        return Vectors(bounds, self.columns[entries], self.values[entries])

    def part(self, first: int, stop: int) -> Vectors:
        a, b = self.bounds[first], self.bounds[stop]
        return Vectors(self.bounds[first : stop + 1] - a, self.columns[a:b], self.values[a:b])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * dense[self.columns], self.bounds[:-1])

    def dense(self, row: int, size: int) -> np.ndarray:
        found = np.zeros(size)
        a, b = self.bounds[row], self.bounds[row + 1]
        found[self.columns[a:b]] = self.values[a:b]
        return found


class BallTree:
    """Nodes in one list; node i holds rows first[i] : stop[i] of the reordered vectors."""

    def __init__(self, vectors: Vectors, size: int) -> None:
        self.rows = np.arange(len(vectors))
        self.vectors = vectors
        self.size = size
        self.first: list[int] = []
        self.stop: list[int] = []
        self.children: list[tuple[int, int] | None] = []
        centroids: list[np.ndarray] = []
        radii: list[float] = []
        reaches: list[np.ndarray] = []
        waiting = [(0, len(vectors), -1)]
        while waiting:
            first, stop, parent = waiting.pop()
            node = len(self.first)
            if parent >= 0:
                self.children[parent] = (*self.children[parent], node)
            self.first.append(first)
            self.stop.append(stop)
            part = self.vectors.part(first, stop)
            centre, radius, order = self._ball(part, stop - first > _LEAF)
            centroids.append(centre)
            radii.append(radius)
            reaches.append(_most(part, size) - centre)
            self.children.append(None if order is None else ())
            if order is not None:
                self._reorder(first, stop, order)
                middle = first + (stop - first) // 2
                waiting += [(first, middle, node), (middle, stop, node)]
        self.centroids = np.array(centroids).T.copy()
        self.radii = np.array(radii)
        self.reaches = np.array(reaches).T.copy()

    def _ball(self, part: Vectors, split: bool):
        """Centroid, radius rounded up, and the order that puts one half before the other."""
        values = part.values.astype(np.float64)
        norms = np.add.reduceat(values * values, part.bounds[:-1])
        centre = np.bincount(part.columns, values, self.size) / len(part)
        around = _far(norms, part.dot(centre), centre)
        scale = norms.max() + centre @ centre
        radius = math.sqrt(max(around.max(), 0.0) + _SLACK * scale)
        if not split:
            return centre, radius, None
        one = part.dense(int(around.argmax()), self.size)
        other = part.dense(int(_far(norms, part.dot(one), one).argmax()), self.size)
        return centre, radius, np.argsort(part.dot(other - one), kind="stable")

    def _reorder(self, first: int, stop: int, order: np.ndarray) -> None:
        moved = self.vectors.part(first, stop).take(order)
        a, b = self.vectors.bounds[first], self.vectors.bounds[stop]
        self.vectors.bounds[first : stop + 1] = moved.bounds + a
        self.vectors.columns[a:b], self.vectors.values[a:b] = moved.columns, moved.values
        self.rows[first:stop] = self.rows[first:stop][order]

    def bounds(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per node what no product with a row below exceeds."""
        ball = math.sqrt(float(counts @ counts)) * self.radii
        spread = np.minimum(ball, counts @ self.reaches[terms])
        return (counts @ self.centroids[terms] + spread) * (1 + _SLACK) + 1

    def search(self, terms: np.ndarray, counts: np.ndarray, top: Top, ids: list) -> int:
        """Put what is better than the last of `top` into it; says how many rows were scored."""
        bounds = self.bounds(terms, counts)
        wanted = np.zeros(self.size, np.int64)
        wanted[terms] = counts
        heap = [(-bounds[0], 0)]
        scored = 0
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < top.least:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bounds[child] >= top.least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            first = self.first[node]
            scores = self.vectors.part(first, self.stop[node]).dot(wanted)
            scored += len(scores)
            better = np.flatnonzero(scores >= top.least)
            if len(better):
                top.add([(int(scores[i]), ids[self.rows[first + i]]) for i in better])
        return scored


def _most(part: Vectors, size: int) -> np.ndarray:
    """The greatest value along each term."""
    found = np.zeros(size)
    np.maximum.at(found, part.columns, part.values)
    return found


def _far(norms: np.ndarray, products: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of rows from a centre."""
    return norms - 2 * products + centre @ centre


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every document scored for every item, without an index.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
size AS (SELECT count(DISTINCT r) AS n_docs, count(*) AS n_terms FROM d),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, size GROUP BY term),
impact AS (SELECT r, doc_id, term,
    w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))) AS x
    FROM tf JOIN n USING (r) JOIN w USING (term), size),
scored AS (SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(x)::BIGINT AS score
    FROM q JOIN impact USING (term) GROUP BY i, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

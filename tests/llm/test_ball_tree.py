"""The lexical search against every document scored."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tests.llm.tables import documents, same, twin
from tremorgrade.llm import ascii_terms, ball_tree

SF = "/root/testdata/sf0.001"
QUERIES = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain(docs, queries, k=20):
    """item_id, rank, doc_id, score by scoring everything."""
    counted = [(i, Counter(terms(text))) for i, text in docs]
    counted = [(i, c) for i, c in counted if c]
    n, size = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in queries:
        asked, scores = Counter(terms(text)), []
        for i, c in counted:
            m = 100 - 25 + 25 * c.total() * n // size
            score = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, q in asked.items()
                if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        rows += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return rows


def found(spark, docs, queries, k=20):
    table = documents(spark, [(i, text, "en", "s") for i, text in docs])
    result = ball_tree.search(table, spark.createDataFrame(queries, QUERIES), k)
    return sorted(map(tuple, result.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_equals_sql(spark):
    same(ball_tree.op13_lexical_search(spark, SF), *twin(ball_tree.OP13_SQL, SF, "documents", "benchmark"))


def test_random_cases(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "A1", "x_y", "9"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(0, 40)))) for i in range(300)]
    docs += [(i, docs[0][1]) for i in range(300, 340)]  # ties
    queries = [(i, "-".join(draw.choices(words, k=draw.randint(0, 12)))) for i in range(25)]
    assert found(spark, docs, queries) == sorted(plain(docs, queries), key=repr)


def test_odd_rows(spark):
    docs = [
        (1, "Alpha beta"), (1, "Alpha beta"), (None, "alpha"), (2, None), (3, ""), (4, " .\x00. "),
        (5, "ALPHA\x7Fgamma " * 40_000), (6, "alpha alpha delta"),
    ]
    queries = [(1, "alpha alpha"), (1, "alpha"), (None, "beta"), (3, None), (4, "?!"), (5, "unknown")]
    assert found(spark, docs, queries) == sorted(plain(docs, queries), key=repr)
    assert found(spark, docs, queries, 2) == sorted(plain(docs, queries, 2), key=repr)


@pytest.mark.parametrize("docs, queries", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, queries):
    assert found(spark, docs, queries) == []


def test_other_columns_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "TERMS", 2)
    docs = documents(spark, [(i, f"a b{i % 3} c{i}", "en", "s") for i in range(30)])
    clashing = docs.selectExpr("*", "1 AS n", "2 AS terms", "3 AS score", "4 AS rank", "5 AS `a.b`")
    queries = [(i, f"b{i} a") for i in range(3)]
    table = spark.createDataFrame(queries, QUERIES).selectExpr("*", "7 AS doc_id", "8 AS query")
    rows = ball_tree.search(clashing, table)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    expected = plain([(i, f"a b{i % 3} c{i}") for i in range(30)], queries)
    assert sorted(map(tuple, rows.collect())) == sorted(expected)


def test_bounds_hold_and_prune():
    """No product lies above its node's bound; clustered rows are not all scored."""
    draw = np.random.default_rng(3)
    size, rows = 200, []
    for i in range(600):
        columns = np.sort(draw.choice(np.arange(20) + 20 * (i % 10), 8, replace=False))
        rows.append((columns, draw.integers(1, 1_000_000, 8)))
    bounds = np.arange(0, 8 * 601, 8)
    vectors = ball_tree.Vectors(bounds, np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]))
    tree = ball_tree.BallTree(vectors, size)
    assert sorted(tree.rows) == list(range(600))
    scored = 0
    for q in range(30):
        asked = np.arange(20 * (q % 10), 20 * (q % 10) + 5)
        counts = draw.integers(1, 4, 5)
        wanted = np.zeros(size, np.int64)
        wanted[asked] = counts
        upper = tree.bounds(asked, counts)
        assert (upper <= (counts @ tree.centroids[asked] + math.sqrt(counts @ counts) * tree.radii) * 1.01).all()
        for node, (a, b) in enumerate(zip(tree.first, tree.stop, strict=True)):
            assert tree.vectors.part(a, b).dot(wanted).max() <= upper[node]
        top = ball_tree.Top(5)
        scored += tree.search(asked, counts, top, list(range(600)))
        every = sorted(((-int(v[np.isin(c, asked)] @ wanted[c[np.isin(c, asked)]]), i) for i, (c, v) in enumerate(rows)))
        assert top.rows == [(-s, i) for s, i in every[:5] if s < 0]
    assert scored < 0.7 * 600 * 30


def test_terms_of_slices_and_nulls():
    table = ascii_terms.byte_table("0123456789abc")
    texts = pa.array(["zz", " aXb ", None, "", "äö\x00c9", "a b"])
    found, n = ascii_terms.terms(texts.slice(1), table)
    assert found.to_pylist() == ["a", "b", "äö", "c9", "a b"]
    assert n.tolist() == [2, 0, 0, 2, 1]
    found, n = ascii_terms.terms(texts.slice(1).cast(pa.large_string()), table)
    assert found.to_pylist() == ["a", "b", "äö", "c9", "a b"]

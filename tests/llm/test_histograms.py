"""The quality rules against counts by hand and their SQL."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.tables import documents, same, twin
from tremorgrade.llm import histograms

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def base(text):
    """The base columns of one text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(runs)
    inside = {i + k for i, run in enumerate(runs) if often[run] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def test_equals_sql(spark):
    same(histograms.op12_quality_rules(spark, SF), *twin(histograms.OP12_SQL, SF, "documents"))


def test_base_counts(spark):
    draw = random.Random(2)
    words = ["a", "bb", "c#", "é漢", "|", "\x00", "d\x1ce", "f g"]
    blanks = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\n\n", " \n"]
    texts = [None, "", " \n\t", "a", "\n a a \n a a \n", "x " * 50_000, "w" * 1_000_000]
    texts += [
        "".join(draw.choice(words[: draw.randint(2, 8)]) + draw.choice(blanks) for _ in range(draw.randint(0, 60)))
        for _ in range(150)
    ]
    block = [f"k{i}" for i in range(12)]
    texts += [" ".join(block + [f"u{i}" for i in range(40)] + block), " ".join(["z"] * 9), " ".join(["z"] * 8)]
    rows = histograms.judge(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert tuple(row)[1:7] == base(texts[row.doc_id]), texts[row.doc_id]
        assert not (row.base_failed and row.kept)


def test_distance(spark):
    ones, others = [3, 0, 5, 2], [1, 4, 0, 5]
    p, q = [[x / sum(c) for x in c] for c in (ones, others)]
    parts = [a * math.log2(2 * a / (a + b)) if a else 0 for a, b in zip(p, q)]
    parts += [b * math.log2(2 * b / (a + b)) if b else 0 for a, b in zip(p, q)]
    made = spark.range(1).select(
        *[
            histograms.js_distance(F.lit(a), F.lit(b)).alias(n)
            for n, a, b in (("some", ones, others), ("none", ones, ones), ("all", [1, 0], [0, 2]))
        ]
    ).first()
    assert made.some == pytest.approx(math.sqrt(sum(parts) / 2))
    assert (made.none, made["all"]) == (0.0, 1.0)


def prose(draw, size=120):
    return " ".join(draw.choices(["the", "of", "and", "house", "tree", "to", "river", "stone", "in"], k=size))


def test_odd_documents_fail_and_short_ones_are_left_alone(spark):
    draw = random.Random(9)
    docs = [(i, prose(draw), "en", "s") for i in range(200)]
    docs += [(1000, " ".join(f"{draw.randint(10**5, 10**6)}#" for _ in range(100)), "en", "s")]
    docs += [(1001, " ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(100)), "en", "s")]
    docs += [(1002, " ".join(f"{draw.randint(1000, 9999)}" for _ in range(30)), "en", "s")]
    docs += [(1003, " ".join(f"w{draw.random()}" for _ in range(90)), None, "s")]
    kept = {r.doc_id: r.kept for r in histograms.judge(documents(spark, docs)).collect()}
    assert not kept[1000] and not kept[1001]
    assert kept[1002], "too short for either histogram"
    assert kept[1003], "its language is itself"
    assert all(kept[i] for i in range(200))


def test_references_beyond_the_broadcast(spark, monkeypatch):
    draw = random.Random(1)
    docs = documents(spark, [(i, prose(draw), draw.choice(["en", "fr", None]), "s") for i in range(60)])
    few = sorted(map(tuple, histograms.judge(docs).collect()))
    monkeypatch.setattr(histograms, "BROADCAST_LANGS", 0)
    assert sorted(map(tuple, histograms.judge(docs).collect())) == few


def test_empty_table_nulls_and_other_columns(spark):
    assert histograms.judge(documents(spark, [])).collect() == []
    docs = documents(spark, [(None, None, None, None), (1, "a b", "en", "s"), (1, "a b", "en", "s")])
    clashing = docs.selectExpr("*", "1 AS classes", "2 AS common", "3 AS f", "4 AS n_words", "5 AS `a.b`")
    rows = histograms.judge(clashing)
    assert rows.columns == NAMES
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, histograms.judge(docs).collect()))
    assert rows.count() == 3


def test_no_python_in_the_plan(spark):
    plan = histograms.op12_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

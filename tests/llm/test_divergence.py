"""The divergence audit against a dense evaluation."""

import random
import re
from collections import Counter

import pytest

from tests.llm.tables import documents, same, twin
from tremorgrade.llm import divergence

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain(docs, least, top):
    """Rows from whole vectors of counts."""
    docs = [(text or "", lang or "", source or "") for _, text, lang, source in docs]
    rows = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        df = Counter(t for text, _, _ in own for t in set(terms(text)))
        kept = sorted(t for t in df if df[t] >= least)
        counts = {s: Counter() for _, _, s in own}
        for text, _, source in own:
            counts[source].update(t for t in terms(text) if t in set(kept))

        def shares(c):
            n = c.total() + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            over = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                rows += [(lang, s, part, i, -v, r) for r, (v, _, i) in enumerate(items, 1)]
    return rows


def check(spark, docs, least=3, top=10):
    rows = divergence.audit(documents(spark, docs), least, top)
    same(rows, ["lang", "source", "part", "item", "value", "rank"], plain(docs, least, top))


def test_equals_sql(spark):
    same(divergence.op11_divergence(spark, SF), *twin(divergence.OP11_SQL, SF, "documents"))


def test_random_cases(spark):
    draw = random.Random(11)
    words = ["the", "The", "of", "and", "Été", "ete", "x1y", "漢字", "zz"] + [f"w{c}" for c in "abcdefghijkl"]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 25))) for _ in range(60)]
    docs = [
        (i, draw.choice(texts), draw.choice(["en", "fr", None, ""]), draw.choice(["a", "b", "c", None, "é"]))
        for i in range(400)
    ]
    check(spark, docs)
    check(spark, docs, least=20, top=2)


def test_odd_rows(spark):
    docs = [
        (None, None, None, None), (1, "", "en", "only empty"), (1, "", "en", "only empty"),
        (2, "12 34 !", "en", "no term"), (3, "a b", "one", "alone"), (3, "a b", "one", "alone"),
        (4, "same text here", "en", "x"), (4, "same text here", "en", "y"), (5, "same Text", "en", "x"),
        (6, "long " * 200_000, "en", "y"), (7, "\x00a\x7Fb", "en", "x"),
    ]
    check(spark, docs, least=2)
    check(spark, docs, least=100)


def test_a_third_is_one_text(spark):
    docs = [(i, "common text of many copies", "en", f"s{i % 3}") for i in range(3000)]
    docs += [(i, f"text {chr(97 + i % 26)} of its own", "en", f"s{i % 5}") for i in range(600)]
    check(spark, docs, least=10)
    merged = divergence.collapsed(documents(spark, docs))
    assert merged.count() == 27


def test_empty_table(spark):
    assert divergence.audit(documents(spark, [])).collect() == []


def test_other_columns(spark):
    docs = [(i, f"a b w{'xyz'[i % 3]}", "en", f"s{i % 2}") for i in range(30)]
    table = documents(spark, docs).selectExpr("*", "1 AS n", "2 AS key", "3 AS term", "4 AS `a.b`", "5 AS value")
    rows = divergence.audit(table, 3)
    same(rows, ["lang", "source", "part", "item", "value", "rank"], plain(docs, 3, 10))


@pytest.mark.parametrize("count, n, v", [(0, 0, 1), (10**13, 10**15, 10**6), (10**18, 10**18, 1)])
def test_shares_are_exact_at_any_size(spark, count, n, v):
    sql = divergence.share(f"{count}L", f"{n}L", f"{v}L")
    assert spark.range(1).selectExpr(f"{sql} AS p").first().p == 1 + 10**9 * (count + 2) // (n + 2 * v)


def test_counts_handed_on_early_add_up(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_HELD_ROWS", 5)
    docs = [(i, f"a b c d e f g h {'ijk'[i % 3]}", "en", f"s{i % 4}") for i in range(50)]
    check(spark, docs)

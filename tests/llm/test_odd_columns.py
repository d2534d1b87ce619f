"""Further columns of any name, rows without id and empty tables, through operators that pass rows on."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402
from tests.llm.tables import documents  # noqa: E402
from tremorgrade.llm import contamination, jaccard_join, licenses, quality, suffix_dedup, unigram  # noqa: E402
from tremorgrade.llm.row_keys import put_back, set_aside  # noqa: E402

NAMES = [
    "row", "repeated", "kept", "packed", "ranges", "spans", "n_bytes", "token_ids", "others", "document",
    "count", "seed", "near", "hash", "component", "first", "a.b", "a b", "back`tick", "length", "x",
]


@pytest.fixture(scope="module")
def table(spark):
    """Documents with odd columns; one id on two rows, one row without id, a null and an empty text."""
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(400)]
    prose = lambda n: " ".join(draw.choices(words, k=n))
    passage, copy = prose(50), prose(80)
    texts = [prose(60) for _ in range(12)] + [f"{prose(30)} {passage}", f"{passage} {prose(30)}", copy, copy + " end"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += [(3, prose(40), "fr", "t"), (None, prose(40), "en", "s"), (50, None, None, None), (51, "", "en", "s")]
    plain = documents(spark, rows)
    return plain.selectExpr("*", *[f"{k} AS `{n.replace('`', '``')}`" for k, n in enumerate(NAMES)])


def same_columns(rows, table):
    assert rows.columns == table.columns
    found = rows.collect()
    start = len(table.columns) - len(NAMES)
    assert all(list(row)[start:] == list(range(len(NAMES))) for row in found)
    return found


def test_set_aside_and_back(table):
    rows = put_back(set_aside(table), table)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, table.collect()))


@pytest.mark.parametrize("repeated_ids", [True, False])
def test_first_rows_and_leaks(spark, table, repeated_ids):
    if not repeated_ids:
        table = table.where("doc_id IS NOT NULL AND NOT (doc_id = 3 AND lang = 'fr')")
    n = table.count()
    assert len(same_columns(jaccard_join.keep_first(table), table)) == n - 1  # one near copy
    leaked = table.where("doc_id IS NULL" if repeated_ids else "doc_id = 5").first().text
    items = spark.createDataFrame([(1, leaked)], "item_id long, text string")
    kept = same_columns(contamination.decontaminate(table, items), table)
    assert len(kept) == n - 1 and leaked not in {r.text for r in kept}


def test_cut_and_encode(spark, table):
    cut = same_columns(corpus_pipeline.cut_repeats(spark, table, ""), table)
    texts = {r.doc_id: r.text for r in cut}
    assert all(r.n_chars == len(r.text or "") for r in cut)
    assert len(texts[12]) < 200 < len(texts[0])
    file = public_tokenizers.path("piece_bpe_32k.model")
    encoded = unigram.encode(table, file)
    assert sorted(encoded.columns) == sorted(table.columns)
    assert all(isinstance(r.token_ids, list) for r in encoded.collect())


def test_classifier_passes_all_columns(spark, table, tmp_path):
    labels = [(i, int(i % 2 == 0), 0) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    same_columns(corpus_pipeline.keep_good(spark, table, str(tmp_path)), table)
    spark.read.parquet(f"{tmp_path}/labels.parquet").where("false").write.parquet(f"{tmp_path}/none/labels.parquet")
    kept = corpus_pipeline.keep_good(spark, table, f"{tmp_path}/none")
    assert kept.count() == table.count(), "nothing taught, nothing rejected"
    assert corpus_pipeline.keep_good(spark, table.where("false"), str(tmp_path)).count() == 0


def test_empty_tables(spark, table):
    none = table.where("false")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert jaccard_join.keep_first(none).count() == 0
    assert contamination.decontaminate(none, items).count() == 0
    assert contamination.decontaminate(table, items.where("false")).count() == table.count()
    assert corpus_pipeline.cut_repeats(spark, none, "").count() == 0


@pytest.mark.parametrize(
    ("text", "labels", "expressions"),
    [
        (
            "SPDX-License-Identifier: MIT code SPDX-License-Identifier: GPL-3.0-only",
            "gpl,mit",
            ["MIT", "GPL-3.0-only"],
        ),
        ("SPDX-License-Identifier: MIT and then some words", "mit", ["MIT"]),
        ("SPDX-License-Identifier: MIT, and see LICENSE", "mit", ["MIT"]),
        ("SPDX-License-Identifier: mit or apache-2.0", "apache,mit", ["mit apache-2.0 OR"]),
        ("SPDX-License-Identifier: LicenseRef-Own", "", ["LicenseRef-Own"]),
        ("SPDX-License-Identifier: (MIT AND (ISC", "isc,mit", ["MIT ISC AND"]),
        ("SPDX-License-Identifier:", "", []),
        ("SPDX-License-Identifier: ? MIT", "", []),
    ],
)
def test_tags(spark, text, labels, expressions):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = licenses.scan_licenses(frame).first()
    assert (row.labels, row.expressions) == (labels, expressions)

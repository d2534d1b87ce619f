"""Audit how far the sources of a language differ in their words.

Equal texts of one language are collapsed first: a row per text with how often each source
has it. Each such text is split into terms once; its document and term counts are weighted
by those multiplicities. Of the terms that enough documents of the language hold, only the
counts above 0 are kept, as one list of (source, count) a term.

Two sources are compared on all kept terms without a row for counts of 0: the value is
that of V absent terms, put right for the terms that one source has, and again for those
both have. As a value depends on the two counts alone, terms are counted by their pair of
counts before anything is computed. All arithmetic is on whole numbers: shares are
quotients of decimals, wide enough for any corpus.

Null lang, source and text are read as ''. Texts without a term count for nothing, but
their source is still a group; so with empty texts. A language in which no term reaches the
bound has pairs of value 0. Equal values rank by the item's UTF-8 bytes. Repeated rows
count each. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorgrade.llm import ascii_terms
from tremorgrade.llm.batches import pieces
from tremorgrade.llm.store import stored

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
_UNIT = 1_000_000_000
_HELD_ROWS = 1_000_000
"""Counts a task holds before it hands them on."""
_TABLE = ascii_terms.byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_GROUP = ["lang", "source"]


def audit(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank; see the module."""
    rows = _filled(documents)
    terms = stored(kept_terms(collapsed(rows), least_documents), "divergence-terms")
    groups = stored(_groups(rows, terms), "divergence-groups")
    return pair_values(terms, groups).unionByName(term_values(terms, groups, top))


def _filled(documents: DataFrame) -> DataFrame:
    return documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def collapsed(rows: DataFrame) -> DataFrame:
    """lang, text, and per source how many rows have this text; a row per (lang, text).

    Copies are merged inside every batch first, so a text that a third of all rows share
    comes to its task as a few rows a batch.
    """
    key = F.xxhash64("text").alias("key")  # short keys sort faster; texts are compared too
    return (
        rows.mapInArrow(_merge_copies, "lang string, source string, text string, n long")
        .select(key, "lang", "text", "source", "n")
        .repartition("key", "lang")
        .groupBy("key", "lang", "text", "source")
        .agg(F.sum("n").alias("n"))
        .groupBy("key", "lang", "text")
        .agg(F.collect_list(F.struct("source", "n")).alias("sources"))
        .select("lang", "text", "sources")
    )


def _merge_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        codes = [batch[c].dictionary_encode().indices for c in ("lang", "source", "text")]
        groups = pa.table([*codes, pa.array(np.arange(len(batch)))], names=["a", "b", "c", "at"])
        groups = groups.group_by(["a", "b", "c"]).aggregate([("at", "min"), ("at", "count")])
        first = batch.take(groups["at_min"].combine_chunks())
        yield pa.RecordBatch.from_arrays(
            [first["lang"], first["source"], first["text"], groups["at_count"].combine_chunks()],
            names=["lang", "source", "text", "n"],
        )


def kept_terms(texts: DataFrame, least_documents: int) -> DataFrame:
    """lang, term, total and counts, a list of (source, count): terms of enough documents."""
    return (
        texts.mapInArrow(_count, "lang string, source string, term string, count long, docs long")
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum("count").alias("total"),
            F.collect_list(F.struct("source", "count")).alias("counts"),
        )
        .where(F.col("docs") >= least_documents)
        .select("lang", "term", "total", "counts")
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0
    for piece in pieces(batches, "text"):
        held.append(_count_piece(piece))
        size += held[-1].num_rows
        if size > _HELD_ROWS:
            merged = _merged(held)
            held, size = [merged], merged.num_rows
            if size > _HELD_ROWS // 2:
                yield from merged.to_batches()
                held, size = [], 0
    if held:
        yield from _merged(held).to_batches()


_NAMES = ["lang", "source", "term"]


def _merged(parts: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(parts).group_by(_NAMES).aggregate([("count", "sum"), ("docs", "sum")])
    return sums.select([*_NAMES, "count_sum", "docs_sum"]).rename_columns([*_NAMES, "count", "docs"])


def _count_piece(piece: pa.RecordBatch) -> pa.Table:
    """Weighted counts of a few texts: each is split once, then counted for all its sources."""
    found, n = ascii_terms.terms(piece["text"], _TABLE)
    coded = found.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    text = np.repeat(np.arange(len(n)), n)
    keys, tf = np.unique(text * size + coded.indices.to_numpy(), return_counts=True)
    text, term = keys // size, keys % size

    copies = piece["sources"]
    many = pc.list_value_length(copies).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = copies.flatten()
    sources = inner.field("source").dictionary_encode()
    weights = inner.field("n").to_numpy()
    starts = np.cumsum(many) - many
    # A row for every (text, term) and source of the text.
    repeats = many[text]
    before = np.cumsum(repeats) - repeats
    copy = np.repeat(starts[text] - before, repeats) + np.arange(repeats.sum())
    text, term, tf = (np.repeat(x, repeats) for x in (text, term, tf))

    langs = piece["lang"].dictionary_encode()
    parts = pa.table(
        [
            pa.DictionaryArray.from_arrays(langs.indices.take(pa.array(text)), langs.dictionary).dictionary_decode(),
            pa.DictionaryArray.from_arrays(sources.indices.take(pa.array(copy)), sources.dictionary).dictionary_decode(),
            pa.array(term),
            pa.array(tf * weights[copy]),
            pa.array(weights[copy]),
        ],
        names=["lang", "source", "term", "count", "docs"],
    )
    sums = _merged([parts])
    return sums.set_column(2, "term", coded.dictionary.take(sums["term"].combine_chunks()))


def _groups(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Every (lang, source) with its kept terms' occurrences, the language's, and V."""
    own = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(
        F.sum("c.count").alias("n")
    )
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    zero = F.lit(0).cast("long")
    return (
        rows.groupBy(*_GROUP)
        .agg(F.count(F.lit(1)).alias("documents"))
        .join(own, _GROUP, "left")
        .join(langs, "lang", "left")
        .select(*_GROUP, *[F.coalesce(c, zero).alias(c) for c in ("n", "v", "lang_n")])
    )


def share(count: str, n: str, v: str) -> str:
    """1 + floor(10**9 * (count + 2) / (n + 2 * v)) as SQL; a long. Nothing asks for it if v is 0."""
    wide = "CAST({} AS DECIMAL(28,0))".format
    return f"(1 + {wide(f'{count} + 2')} * {_UNIT} DIV {wide(f'greatest({n} + 2 * {v}, 1)')})"


def apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) DIV ({p} + {q}))"


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    one = groups.selectExpr("lang", "source AS a", "n AS a_n", "v")
    other = groups.selectExpr("lang", "source AS b", "n AS b_n")
    none = f"{share('0', 'a_n', 'v')} AS a_none", f"{share('0', 'b_n', 'v')} AS b_none"
    # Both ways, as each source lists all others: the result has a row for each such pair.
    pairs = one.join(other, "lang").where("a <> b").selectExpr("*", *none)

    alone = (
        terms.select("lang", F.explode("counts").alias("x"))
        .groupBy("lang", F.col("x.source").alias("a"), F.col("x.count").alias("a_count"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    a, b = share("a_count", "a_n", "v"), share("b_count", "b_n", "v")
    absent = apart("a_none", "b_none")
    from_one = alone.join(pairs, ["lang", "a"]).selectExpr(
        "lang", "a", "b", f"times * ({apart(a, 'b_none')} - {absent}) AS value"
    )
    shared = (
        terms.select("lang", F.posexplode("counts").alias("at", "x"), "counts")
        .select("lang", "x", F.explode(F.expr("slice(counts, at + 2, size(counts))")).alias("y"))
        .selectExpr(
            "lang", "x.source AS a", "y.source AS b", "x.count AS a_count", "y.count AS b_count"
        )
        .groupBy("lang", "a", "b", "a_count", "b_count")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    from_both = shared.join(pairs, ["lang", "a", "b"]).selectExpr(
        "lang",
        "a",
        "b",
        f"times * ({apart(a, b)} - {apart(a, 'b_none')} - {apart('a_none', b)} + {absent}) AS value",
    )
    turned = "lang", "b AS a", "a AS b", "value"
    sums = (
        pairs.selectExpr("lang", "a", "b", f"CASE WHEN v > 0 THEN v * {absent} ELSE 0 END AS value")
        .unionByName(from_one)
        .unionByName(from_one.selectExpr(*turned))
        .unionByName(from_both)
        .unionByName(from_both.selectExpr(*turned))
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    return _ranked(sums.selectExpr("lang", "a AS source", "'pair' AS part", "b AS item", "value"))


def term_values(terms: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    cells = terms.select("lang", "term", "total", F.inline("counts"))
    p, q = share("count", "n", "v"), share("total", "lang_n", "v")
    values = (
        cells.join(groups, _GROUP)
        .selectExpr(*_GROUP, "term", f"{p} AS p", f"{q} AS q")
        .where("p > q")
        .selectExpr(*_GROUP, "'term' AS part", "term AS item", f"{apart('p', 'q')} AS value")
    )
    return _ranked(values).where(F.col("rank") <= top)


def _ranked(values: DataFrame) -> DataFrame:
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(order))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Dense: every group with every kept term of its language.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.total
    FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)),
shares AS (SELECT *, 1 + (1000000000 * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g) AS p,
    1 + (1000000000 * (total + 2)) // (sum(total) OVER g + 2 * count(*) OVER g) AS q
    FROM dense WINDOW g AS (PARTITION BY lang, source)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
    FROM shares WHERE n > 0 AND p > q),
found AS (FROM pairs UNION ALL FROM terms),
ranked AS (SELECT lang, source, part, item, coalesce(value, 0)::BIGINT AS value, row_number() OVER (
    PARTITION BY lang, source, part ORDER BY coalesce(value, 0) DESC, item)::INTEGER AS rank FROM found)
FROM ranked WHERE part = 'pair' OR rank <= 10
"""

"""Quality rules: base counts, then the divergence of a document from its language.

Only DataFrame functions. Each language has two references, counted over all its documents
of enough words: shares of character classes, and of its most common words (all others
together are one more bin). A document is compared with them by the Jensen-Shannon
distance, 0 (alike) to 1 (nothing in common), and fails where one distance is above its
limit. Short texts say little, so either test asks for a least length; below it nothing is
judged by that test.

Everything about a document is counted inside its row: documents are not shuffled, only
word counts of languages are, merged before. The references are one row a language; they
are broadcast up to BROADCAST_LANGS of them and joined by shuffle beyond.

A null text has no words and fails the base rules, as every text under 20 words. A null
lang is a language of its own. Null and repeated ids are judged like any other row.
A language without a document of enough words has no reference: its documents pass both
tests. Words common to the same degree go by their bytes. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorgrade.llm.store import stored

BROADCAST_LANGS = 20_000
"""References are some 2 KB a language: so many are 40 MB."""
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]+"
_LOWER = "[a-z]+"
#: Classes of characters in words; lower-case ASCII letters and control characters are the rest.
_CLASSES = {
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "mark": "[!-/:-@\\[-`{-~]+",
    "beyond_ascii": "[^\\x00-\\x7F]+",
}


@dataclass(frozen=True)
class Rules:
    """Base limits, then those of the method: bins, least lengths, greatest distances."""

    least_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    common_words: int = 24
    histogram_words: int = 50
    histogram_chars: int = 200
    char_distance: float = 0.30
    word_distance: float = 0.45


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs of anything but blanks, in order; none for null."""
    even = F.coalesce(text, F.lit(""))
    for blank in _BLANKS[1:]:
        even = F.replace(even, F.lit(blank), F.lit(" "))
    # One plain character needs no pattern matching.
    return F.array_remove(F.split(even, " "), "")


def repeated_words(found: Column, size: int) -> Column:
    """How many words lie in a run of `size` words that the list holds twice or more.

    Runs are told apart by 64-bit hashes, made from those of shorter runs. Most texts repeat
    none, which a set of the hashes shows; for the others hashes are sorted with their places.
    """

    def among(hashes: Column) -> Column:
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, _covered(hashes, size)).otherwise(F.lit(0).cast("long"))

    def runs_of(length: int) -> Callable[[Column], Column]:
        def longer(hashes: Column) -> Column:
            if length >= size:
                return among(hashes)
            step = min(length, size - length)  # the two runs may share words
            rest = F.size(hashes) - step
            pairs = F.slice(hashes, 1, rest), F.slice(hashes, step + 1, rest)
            return _let(F.zip_with(*pairs, lambda a, b: F.xxhash64(a, b)), runs_of(length + step))

        return longer

    counted = _let(F.transform(found, lambda word: F.xxhash64(word)), runs_of(1))
    return F.when(F.size(found) > size, counted).otherwise(F.lit(0).cast("long"))


def _covered(hashes: Column, size: int) -> Column:
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(run: Column) -> Column:
        def alike(x: Column, other: Column) -> Column:
            return F.coalesce(F.get(run, other)["h"] == x["h"], F.lit(False))

        again = F.filter(run, lambda x, at: alike(x, at - 1) | alike(x, at + 1))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def total(at: Column) -> Column:
        steps = F.zip_with(
            F.slice(at, 1, F.size(at) - 1),
            F.slice(at, 2, F.size(at) - 1),
            lambda a, b: F.least(b - a, F.lit(size)),
        )
        return F.aggregate(steps, F.lit(size).cast("long"), lambda s, x: s + x)

    return _let(placed, lambda run: _let(places(run), total))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(_BLANKS))) > 0)
    return F.coalesce(
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)
    ).cast("long")


def _count(text: Column, pattern: str) -> Column:
    """Characters that lie in matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def char_counts(joined: Column) -> Column:
    """A struct of symbols and classes: counts in words joined into one text.

    Most of it is lower case; patterns only see what is left without that.
    """

    def counted(left: Column) -> Column:
        known = F.array(*[_count(left, pattern) for pattern in _CLASSES.values()])
        whole = F.length(joined).cast("long")
        return F.struct(
            _count(left, _SYMBOLS).alias("symbols"),
            _let(known, lambda c: F.concat(c, F.array(whole - _total(c)))).alias("classes"),
        )

    return _let(F.regexp_replace(joined, _LOWER, ""), counted)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def word_counts(found: Column, common: Column) -> Column:
    """How often each common word stands in the list, then how many other words do."""
    each = F.transform(
        common, lambda word: (F.size(found) - F.size(F.array_remove(found, word))).cast("long")
    )
    return _let(each, lambda c: F.concat(c, F.array(F.size(found) - _total(c))))


def js_distance(ones: Column, others: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two lists of counts, neither all 0."""

    def part(p: Column, q: Column) -> Column:
        both = (p + q) / 2
        own = F.when(p > 0, p * F.log2(p / both)).otherwise(F.lit(0.0))
        return own + F.when(q > 0, q * F.log2(q / both)).otherwise(F.lit(0.0))

    def shares(counts: Column) -> Column:
        return _let(_total(counts), lambda n: F.transform(counts, lambda x: x / n))

    parts = F.zip_with(shares(ones), shares(others), part)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def references(documents: DataFrame, rules: Rules) -> DataFrame:
    """lang, classes, common, word_bins: one row per language with documents of enough words."""
    counted = stored(
        documents.select(F.coalesce("lang", F.lit("")).alias("lang"), words(F.col("text")).alias("found"))
        .where(F.size("found") >= rules.histogram_words)
        .select("lang", F.explode("found").alias("word"))
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n")),
        "words",
    )
    size = len(_CLASSES) + 1
    # From distinct words with their numbers: far less than all texts.
    classes = (
        counted.select("lang", "n", char_counts(F.col("word"))["classes"].alias("c"))
        .groupBy("lang")
        .agg(*[F.sum(F.get("c", F.lit(k)) * F.col("n")).alias(f"c{k}") for k in range(size)])
        .select("lang", F.array(*[f"c{k}" for k in range(size)]).alias("classes"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = (
        counted.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= rules.common_words)
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    )
    bins = F.transform("top", lambda x: x["n"])
    return (
        counted.groupBy("lang")
        .agg(F.sum("n").alias("n"))
        .join(common, "lang")
        .join(classes, "lang")
        .select(
            "lang",
            "classes",
            F.transform("top", lambda x: x["word"]).alias("common"),
            F.concat(bins, F.array(F.col("n") - _total(bins))).alias("word_bins"),
        )
    )


def judge(documents: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document."""
    rules = rules or Rules()
    known = stored(references(documents, rules), "references")
    few = known.count() <= BROADCAST_LANGS
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text")
    ).join(F.broadcast(known) if few else known, "lang", "left")
    whole = F.col("text")

    def facts(found: Column) -> Column:
        return _let(F.array_join(found, ""), lambda joined: of_words(found, joined))

    def of_words(found: Column, joined: Column) -> Column:
        return _let(char_counts(joined), lambda counts: measures(found, joined, counts))

    def measures(found: Column, joined: Column, counts: Column) -> Column:
        n, chars = F.size(found).cast("long"), F.length(joined).cast("long")
        far_chars = js_distance(counts["classes"], F.col("classes")) > rules.char_distance
        far_words = js_distance(word_counts(found, F.col("common")), F.col("word_bins"))
        return F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            counts["symbols"].alias("n_symbols"),
            repeated_words(found, rules.window).alias("n_repeat_words"),
            (F.col("classes").isNotNull() & (chars >= rules.histogram_chars) & far_chars).alias("odd_chars"),
            (
                F.col("common").isNotNull()
                & (n >= rules.histogram_words)
                & (far_words > rules.word_distance)
            ).alias("odd_words"),
        )

    base_failed = (F.col("f.n_words") < rules.least_words) | (
        100 * F.col("f.n_repeat_words") > rules.repeat_percent * F.col("f.n_words")
    )
    return rows.select(
        "doc_id",
        _let(words(whole), facts).alias("f"),
        repeated_lines(whole).alias("n_dup_lines"),
    ).select(
        "doc_id",
        "f.n_words",
        "f.word_chars",
        "f.n_symbols",
        "n_dup_lines",
        "f.n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~F.col("f.odd_chars") & ~F.col("f.odd_words")).alias("kept"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))


#: The same from words as rows; the limits are those of Rules.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text
    FROM documents),
w AS (SELECT r, lang, unnest(words) AS word, generate_subscripts(words, 1) AS spot FROM
    (SELECT r, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)),
runs AS (SELECT *, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
    lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o] AS run,
    lead(word, 7) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY r ORDER BY spot)),
marked AS (SELECT *, (whole AND count(*) FILTER (WHERE whole) OVER (PARTITION BY r, run) > 1)::INT AS again
    FROM runs),
inside AS (SELECT r, word, max(again) OVER (PARTITION BY r ORDER BY spot ROWS 7 PRECEDING) AS repeated
    FROM marked),
per_doc AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars,
    sum(repeated)::BIGINT AS n_repeat_words FROM inside GROUP BY r),
lines AS (SELECT r, len(x) - len(list_distinct(x)) AS n_dup_lines FROM (SELECT r,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS x FROM d)),
base AS (SELECT r, doc_id, lang, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d JOIN lines USING (r) LEFT JOIN per_doc USING (r)),
shown AS (SELECT w.r, w.lang, word FROM w JOIN per_doc USING (r) WHERE n_words >= 50),
classes AS (SELECT r, lang, [len(regexp_extract_all(t, '[A-Z]')), len(regexp_extract_all(t, '[0-9]')),
    len(regexp_extract_all(t, '[!-/:-@\[-`{-~]')), len(regexp_extract_all(t, '[^\x00-\x7F]')),
    len(regexp_extract_all(t, '[\x00-\x7F]')) - len(regexp_extract_all(t, '[!-@A-Z\[-`{-~]'))] AS c
    FROM (SELECT r, lang, string_agg(word, '') AS t FROM w GROUP BY ALL)),
class_refs AS (SELECT lang, [sum(c[1]), sum(c[2]), sum(c[3]), sum(c[4]), sum(c[5])] AS c
    FROM classes WHERE r IN (SELECT r FROM shown) GROUP BY lang),
counted AS (SELECT lang, word, count(*) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place FROM shown GROUP BY lang, word),
bins AS (SELECT lang, if(place <= 24, place, 25) AS bin, sum(n) AS n FROM counted GROUP BY ALL),
ref_totals AS (SELECT lang, sum(n) AS total FROM bins GROUP BY lang),
own AS (SELECT s.r, s.lang, coalesce(place, 25) AS bin, count(*) AS n FROM shown s
    LEFT JOIN (FROM counted WHERE place <= 24) c USING (lang, word) GROUP BY ALL),
words_far AS (SELECT p.r, sqrt(greatest(0, sum(
        if(coalesce(o.n, 0) > 0, o.n / p.n_words * log2(2 * (o.n / p.n_words) / (o.n / p.n_words + b.n / total)), 0)
        + b.n / total * log2(2 * (b.n / total) / (coalesce(o.n, 0) / p.n_words + b.n / total))) / 2)) AS far
    FROM (SELECT DISTINCT r, lang FROM shown) s JOIN per_doc p USING (r) JOIN bins b USING (lang)
    JOIN ref_totals USING (lang) LEFT JOIN own o ON o.r = s.r AND o.bin = b.bin GROUP BY p.r),
spread AS (SELECT r, unnest(c.c) AS n, unnest(f.c) AS ref, list_sum(c.c) AS own_total, list_sum(f.c) AS ref_total
    FROM classes c JOIN class_refs f USING (lang)),
chars_far AS (SELECT r, sqrt(greatest(0, sum(
        if(n > 0, n / own_total * log2(2 * (n / own_total) / (n / own_total + ref / ref_total)), 0)
        + if(ref > 0, ref / ref_total * log2(2 * (ref / ref_total) / (n / own_total + ref / ref_total)), 0)) / 2)) AS far
    FROM spread GROUP BY r),
judged AS (SELECT b.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    coalesce(word_chars >= 200 AND c.far > 0.30, false) OR coalesce(n_words >= 50 AND x.far > 0.45, false) AS odd
    FROM base b LEFT JOIN chars_far c USING (r) LEFT JOIN words_far x USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT odd AS kept FROM judged
"""

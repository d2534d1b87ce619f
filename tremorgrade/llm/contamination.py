"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words are runs of digits, letters a-z (after lower-casing) or anything beyond ASCII.
A mask keeps some positions of a stretch of nine words and ignores the others, so two
stretches that differ in ignored words only have the same hash. The masks are chosen
so that any thirteen words with two substituted still agree under some mask (a test
tries all of them). A hit is checked on the words around it: it counts if a stretch of
thirteen words over it (or the whole benchmark item, if shorter) agrees in at least
eight of ten places.

Items of under thirteen words are sought by their own length: every stretch of each
length that occurs is hashed under masks of that length. Its positions fall into more
groups than substitutions are allowed, and each mask leaves out as many groups, so
whichever words are substituted, some mask leaves them all out (a test tries all).

The benchmark is broadcast only if its words, counted first, are few; else both sides
are shuffled by hash, each row with the words around it. Null and empty texts have no
words and meet nothing; repeated items and documents are judged each by itself.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorgrade.llm.row_keys import keyed, put_back, set_aside
from tremorgrade.llm.store import stored

#: Positions that each mask keeps, of a stretch of SPAN words.
MASKS = ((0, 1, 2, 3, 5, 8), (0, 3, 4, 6, 7, 8))
SPAN = 9
WINDOW = 13
LEAST_SHARE = 0.8
BROADCAST_WORDS = 200_000
"""Benchmarks of so many words at most are broadcast: some 100 MB in memory."""

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_REACH = WINDOW - SPAN
_NEAR = SPAN + 2 * _REACH
_CHUNK = 1024


def _words(text: Column) -> Column:
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN)
    return F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(texts: DataFrame, key: str) -> DataFrame:
    """(key, size, at, near, seed): every stretch under every mask, with the words around it.

    ``near`` is the widest stretch that could hold a hit, null beyond the text's ends. A
    text shorter than SPAN is one stretch. Texts are taken in chunks of words, so that what
    is held for a long one at a time is bounded.
    """
    nothing = F.lit(None).cast("bigint")
    padded = F.concat(
        F.array_repeat(nothing, _REACH), F.col("words"), F.array_repeat(nothing, SPAN + _REACH)
    )
    last = F.greatest(F.size("words") - SPAN, F.lit(0))
    chunks = F.transform(
        F.sequence(F.lit(0), F.col("last"), F.lit(_CHUNK)),
        lambda c: F.struct(
            c.alias("base"), F.slice(F.col("padded"), c + 1, _CHUNK + _NEAR - 1).alias("words")
        ),
    )
    places = F.transform(
        F.sequence(F.lit(0), F.least(F.col("last") - F.col("chunk.base"), F.lit(_CHUNK - 1))),
        lambda i: F.struct(
            (F.col("chunk.base") + i).alias("at"),
            F.slice(F.col("chunk.words"), i + 1, _NEAR).alias("near"),
        ),
    )
    hashes = [
        F.xxhash64(F.lit(number), *[F.get("place.near", F.lit(_REACH + k)) for k in mask])
        for number, mask in enumerate(MASKS)
    ]
    return (
        texts.select(F.col(key), _words(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .select(key, F.size("words").alias("size"), last.alias("last"), padded.alias("padded"))
        .select(key, "size", "last", F.explode(chunks).alias("chunk"))
        .select(key, "size", F.explode(places).alias("place"))
        .select(key, "size", "place.at", "place.near", F.explode(F.array(*hashes)).alias("seed"))
    )


def allowed(length: int) -> int:
    """How many words of an item of this length may be substituted."""
    return max(k for k in range(length) if (length - k) / length >= LEAST_SHARE)


def short_masks(length: int) -> list[tuple[int, ...]]:
    """Positions kept, such that any allowed substitutions miss all of them under some mask."""
    left_out = allowed(length)
    groups = 2 * left_out + 1
    return [
        tuple(k for k in range(length) if k % groups not in gone)
        for gone in combinations(range(groups), left_out)
    ]


def _short_seeds(texts: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """(key, size, at, near, length, seed): every stretch of these lengths under every mask of its
    length. ``near`` is as long as the longest, null beyond the text's ends, where ``at`` may lie
    by as many words as may be substituted. In chunks, as above."""
    nothing = F.lit(None).cast("bigint")
    longest, edge = max(lengths), max(allowed(n) for n in lengths)
    padded = F.concat(F.array_repeat(nothing, edge), F.col("words"), F.array_repeat(nothing, longest))
    last = F.size("words") + edge - 1
    chunks = F.transform(
        F.sequence(F.lit(0), F.col("last"), F.lit(_CHUNK)),
        lambda c: F.struct(
            c.alias("base"), F.slice(F.col("padded"), c + 1, _CHUNK + longest - 1).alias("words")
        ),
    )
    places = F.transform(
        F.sequence(F.lit(0), F.least(F.col("last") - F.col("chunk.base"), F.lit(_CHUNK - 1))),
        lambda i: F.struct(
            (F.col("chunk.base") + i - edge).alias("at"),
            F.slice(F.col("chunk.words"), i + 1, longest).alias("near"),
        ),
    )
    hashes = [
        F.struct(
            F.lit(n).alias("length"),
            F.xxhash64(F.lit(n), F.lit(number), *[F.get("place.near", F.lit(k)) for k in mask]).alias("seed"),
        )
        for n in lengths
        for number, mask in enumerate(short_masks(n))
    ]
    return (
        texts.select(F.col(key), _words(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .select(key, F.size("words").alias("size"), last.alias("last"), padded.alias("padded"))
        .select(key, "size", "last", F.explode(chunks).alias("chunk"))
        .select(key, "size", F.explode(places).alias("place"))
        .select(key, "size", "place.at", "place.near", F.explode(F.array(*hashes)).alias("hash"))
        .select(key, "size", "at", "near", "hash.length", "hash.seed")
    )


def _short_hits(documents: DataFrame, benchmark: DataFrame, lengths: list[int], few: bool) -> DataFrame:
    """(doc_id, item_id, at, matched, share) of the items of these lengths."""
    items = (
        _short_seeds(benchmark, "item_id", lengths)
        .where("at = 0 AND length = size")
        .select("item_id", "seed", "length", F.col("near").alias("item_near"))
    )
    seeds = _short_seeds(documents, "doc_id", lengths).drop("size")
    hits = seeds.join(F.broadcast(items) if few else items, ["seed", "length"])
    equal = F.zip_with("near", "item_near", lambda a, b: F.when(a == b, 1).otherwise(0))
    matched = F.aggregate(equal, F.lit(0), lambda n, x: n + x)  # beyond its end the item has nulls
    return (
        hits.select("doc_id", "item_id", F.greatest("at", F.lit(0)).alias("at"), "length", matched.alias("matched"))
        .withColumn("share", F.col("matched") / F.col("length"))
        .select("doc_id", "item_id", "at", "matched", "share")
    )


def find_overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, matched, share, n_hits) for each pair that overlaps: the first
    place in the document, the best stretch's number of equal words and their share, and at how
    many places one stands. Rows without doc_id or item_id are not looked at. Empty tables give
    no rows. Other columns are not read."""
    benchmark, documents = benchmark.where("item_id IS NOT NULL"), documents.where("doc_id IS NOT NULL")
    sizes = benchmark.select(F.size(_words(F.col("text"))).alias("n"))
    n_words = sizes.agg(F.sum("n")).first()[0] or 0
    lengths = sorted(r.n for r in sizes.where(f"n > 0 AND n < {WINDOW}").distinct().collect())
    few = n_words <= BROADCAST_WORDS
    items = _seeds(benchmark, "item_id").where(f"size >= {WINDOW}").select(
        "item_id", "seed", F.col("near").alias("item_near")
    )
    seeds = _seeds(documents, "doc_id").drop("size")
    hits = seeds.join(F.broadcast(items) if few else items, "seed")
    equal = F.zip_with(
        "near", "item_near", lambda a, b: F.when(a == b, 1).otherwise(0)
    )
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(_REACH)),
        lambda s: F.aggregate(F.slice(F.col("equal"), s + 1, WINDOW), F.lit(0), lambda n, x: n + x),
    )
    found = (
        hits.select("doc_id", "item_id", "at", equal.alias("equal"))
        .select("doc_id", "item_id", "at", F.array_max(sums).alias("matched"))
        .select("doc_id", "item_id", "at", "matched", (F.col("matched") / WINDOW).alias("share"))
    )
    if lengths:
        found = found.union(_short_hits(documents, benchmark, lengths, few))
    return (
        found.where(F.col("share") >= LEAST_SHARE)
        .groupBy("doc_id", "item_id")
        .agg(
            F.min("at").cast("long").alias("first_word"),
            F.max("matched").cast("long").alias("matched"),
            F.max("share").alias("share"),
            F.countDistinct("at").alias("n_hits"),
        )
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no part of a benchmark item, all columns, whatever their names.

    Rows that share a doc_id, and rows without one, are judged by their own texts. A null
    text holds nothing; items without id or text are not looked for. An item of a few words
    counts wherever it stands, so one of a single word takes every document with that word.
    """
    whole = set_aside(documents)
    rows = keyed(whole)
    if rows is None:
        rows = whole.withColumn("row", F.col("doc_id"))
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("row", F.coalesce("row", own))
    found = find_overlaps(rows.select(F.col("row").alias("doc_id"), "text"), benchmark)
    leaks = stored(found.select(F.col("doc_id").alias("row")).distinct(), "leaks")
    return put_back(rows.join(leaks, "row", "left_anti"), documents)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"),
    )

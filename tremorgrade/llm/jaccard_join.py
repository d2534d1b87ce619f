"""N-gram Jaccard join: light sets by fixed-size subsets, heavy sets by inverted lists.

A document's set holds its distinct five-word shingles; two link at a Jaccard
similarity of 0.8 or more. Then they share t = ceil(0.8 / 1.8 * (m + n)) shingles at
least.

Light sets (up to a boundary size) are joined on their subsets: two that share c
shingles both have that subset, so all subsets of every size that could be shared are
enumerated as hashes and sets meet where one is equal. Its size proves the link; and
if two link through a subset, both link to the smallest set that has it, so one hub a
subset is enough.

Heavy sets scan inverted lists. In a common order of all shingles, frequent ones last,
two linked sets share one among the first n - t + 1 of each. The frequency comes from a
count sketch of fixed size over all documents. First each member of a list is compared
with the list's hub; sets so linked are one component. Then only members of different
components are compared, if place in the order, sizes and a 512-bit parity signature
leave a link possible. These tests drop no link. Survivors are compared exactly, whole
text against whole text.

In lists a set goes by its own hash, so rows that copy a set need no join to be seen as
one; where two sets had one hash, both would be compared.

The boundary is where enumerating and scanning together cost least, by the counts of
sizes. Equal sets are one set with many documents throughout.

Null or empty texts have an empty set, linked with nothing; fewer than five words are
one shingle. Rows that repeat a doc_id give a row each: inside they go by a key of id and
text, so different texts under one id stay apart. Rows without doc_id are counted
but not joined: their component is null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorgrade.llm.batches import Words, pieces, words
from tremorgrade.llm.components import components
from tremorgrade.llm.packed import packed, unpacked
from tremorgrade.llm.row_keys import keyed, put_back, set_aside
from tremorgrade.llm.store import stored

SHINGLE = 5
_SKETCH_BITS = 22
_CHUNK = 1 << 14
_SIGNATURE = 512
_SMALL = 40
_SCAN_COST = 8.0
"""What a place in an inverted list costs, in subsets: it is moved twice and verified."""


def _least(n: int) -> int:
    """Shingles a set of n shares with any set it links to, at least: ceil(0.8 n)."""
    return -(-4 * n // 5)


def prefix_size(n: int) -> int:
    return n - _least(n) + 1


def subset_count(n: int, largest: int) -> int:
    return sum(comb(n, c) for c in range(_least(n), min(n, largest) + 1))


def boundary(sizes: dict[int, int]) -> int:
    """The largest size of a light set, from how many sets there are of each size up to _SMALL."""

    def cost(x: int) -> float:
        light = sum(k * subset_count(n, x) for n, k in sizes.items() if _least(n) <= x)
        return light + _SCAN_COST * sum(k * prefix_size(n) for n, k in sizes.items() if n > x)

    return min(range(0, _least(_SMALL) + 1), key=cost)


def _sets(found: Words) -> Iterator[np.ndarray]:
    hashes, bounds = found.shingles(SHINGLE)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(hashes[a:b])


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def _identity(shingles: np.ndarray, factor: int = 0xBF58476D1CE4E5B9) -> int:
    return int(_mixed(shingles, factor).sum().view(np.int64))


def _signature(shingles: np.ndarray) -> np.ndarray:
    places = (shingles % np.uint64(_SIGNATURE)).astype(np.int64)
    odd = (np.bincount(places, minlength=_SIGNATURE) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


_PROFILE = (
    "doc_id long, n long, h1 long, h2 long, signature array<long>, small array<long>, "
    "chunk int, counts binary"
)


def _profiles(documents: DataFrame) -> DataFrame:
    """A row for each document (size, set hash, signature, the shingles if few), and at the end
    of each partition its counts for the sketch, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _SKETCH_BITS, np.int32)
        longs = pa.list_(pa.int64())
        for batch in pieces(batches, "text"):
            sets = list(_sets(words(batch["text"])))
            if sets:
                every = np.concatenate(sets) >> np.uint64(64 - _SKETCH_BITS)
                np.add.at(counts, every.astype(np.int64), np.int32(1))
            n = pa.array([len(s) for s in sets], pa.int64())
            h1 = pa.array([_identity(s) for s in sets], pa.int64())
            h2 = pa.array([_identity(s, 0x94D049BB133111EB) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    n,
                    h1,
                    h2,
                    pa.array([_signature(s) for s in sets], longs),
                    pa.array([s.view(np.int64) if len(s) <= _SMALL else None for s in sets], longs),
                    pa.nulls(len(sets), pa.int32()),
                    pa.nulls(len(sets), pa.binary()),
                ],
                names=["doc_id", "n", "h1", "h2", "signature", "small", "chunk", "counts"],
            )
        chunks = [
            {"chunk": i, "counts": zlib.compress(part.tobytes(), 1)}
            for i, part in enumerate(counts.reshape(-1, _CHUNK))
            if part.any()
        ]
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]
            + [("signature", longs), ("small", longs), ("chunk", pa.int32()), ("counts", pa.binary())]
        )
        yield pa.RecordBatch.from_pylist(chunks, schema)

    return documents.select("doc_id", "text").mapInArrow(run, _PROFILE)


def _levels(profiles: DataFrame, total: int) -> np.ndarray:
    """How frequent the shingles of each sketch cell are: 0 for usual cells, then by half
    powers of two. Four million bytes, whatever the input."""
    mean = total / (1 << _SKETCH_BITS)
    usual = int(mean + 3 * mean**0.5 + 8)  # what shingles that occur once fill a cell with

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = sums.setdefault(chunk, np.zeros(_CHUNK, np.int64))
                held += np.frombuffer(zlib.decompress(counts), np.int32)
        rows = []
        for chunk, held in sums.items():
            level = np.ceil(2 * np.log2(np.maximum(held, usual) / usual)).astype(np.uint8)
            rows.append({"chunk": chunk, "level": zlib.compress(level.tobytes(), 1)})
        schema = pa.schema([("chunk", pa.int32()), ("level", pa.binary())])
        yield pa.RecordBatch.from_pylist(rows, schema)

    found = (
        profiles.where("chunk IS NOT NULL")
        .select("chunk", "counts")
        .repartition("chunk")
        .mapInArrow(run, "chunk int, level binary")
        .collect()
    )
    levels = np.zeros(1 << _SKETCH_BITS, np.uint8)
    for chunk, level in found:
        levels[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(zlib.decompress(level), np.uint8)
    return levels


def _postings(documents: DataFrame, levels: np.ndarray, light: int) -> DataFrame:
    """(shingle, doc_id, node, place) of the first shingles of every heavy set; node is the set's
    hash, place has the place in the order in its upper half and the set's size in the lower."""
    shared = documents.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = shared.value
        for batch in pieces(batches, "text"):
            shingles, ids, nodes, places = [], [], [], []
            for doc_id, own in zip(batch["doc_id"].to_pylist(), _sets(words(batch["text"])), strict=True):
                n = len(own)
                size = prefix_size(n) if n > light else 0
                if size:
                    level = level_of[(own >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)]
                    ids.append(np.full(size, doc_id, np.int64))
                    nodes.append(np.full(size, _identity(own), np.int64))
                    shingles.append(own[np.argsort(level, kind="stable")[:size]])
                    places.append((np.arange(size) << 32) | n)
            if shingles:
                columns = [np.concatenate(c) for c in (shingles, ids, nodes, places)]
                columns[0] = columns[0].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["shingle", "doc_id", "node", "place"]
                )

    rows = documents.select("doc_id", "text").where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "shingle long, doc_id long, node long, place long")


def _light_links(sets: DataFrame, light: int) -> DataFrame:
    """(a, b) of linked sets of which one at least is light."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rep, small in zip(batch["rep"].to_pylist(), batch["small"].to_pylist(), strict=True):
                n = len(small)
                values = _mixed(np.array(small, np.int64).view(np.uint64), 0xD6E8FEB86659FD93).tolist()
                whole = sum(values)
                for left_out in range(max(0, n - light), n - _least(n) + 1):
                    for gone in combinations(values, left_out):
                        key = (whole - sum(gone) + (n - left_out) * 0x9E3779B97F4A7C15) % (1 << 64)
                        rows.append((key - (1 << 63), rep, n, n - left_out))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["subset", "rep", "n", "c"]
            )

    small = sets.where(f"n > 0 AND ceil(0.8 * n) <= {light}").select("rep", "small")
    subsets = small.mapInArrow(run, "subset long, rep long, n long, c long")
    hubs = subsets.groupBy("subset", "c").agg(F.min(F.struct("n", "rep")).alias("hub"))
    hubs = hubs.select("subset", "c", F.col("hub.n").alias("hub_n"), F.col("hub.rep").alias("hub"))
    return (
        subsets.join(hubs, ["subset", "c"])
        .where("rep <> hub AND 9 * c >= 4 * (n + hub_n)")
        .select(F.col("rep").alias("a"), F.col("hub").alias("b"))
        .distinct()
    )


def _may_link(n: str, m: str) -> Column:
    """Sizes and signatures leave a similarity of 0.8 possible: of two sets that link, at most
    a ninth of all their shingles are in one alone."""
    apart = F.aggregate(
        F.zip_with("signature", "other_signature", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, x: total + x,
    )
    sizes = (F.col(n) * 5 >= F.col(m) * 4) & (F.col(m) * 5 >= F.col(n) * 4)
    return sizes & (apart * 9 <= F.col(n) + F.col(m))


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): first documents of the pairs (node, other) of sets that may link, by what is known
    of each set."""
    left = sets.select("node", F.col("rep").alias("a"), "n", "signature")
    right = sets.select(
        F.col("node").alias("other"),
        F.col("rep").alias("b"),
        F.col("n").alias("m"),
        F.col("signature").alias("other_signature"),
    )
    return pairs.join(left, "node").join(right, "other").where(_may_link("n", "m")).select("a", "b")


def _verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The (a, b) whose sets, made again from their whole texts, link."""
    pairs = stored(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    found = stored(packed(documents).join(needed, "doc_id"), "texts")
    # Only equal rows share an id here; the texts of those alone move to be merged.
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeats = found.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = found.join(again, "doc_id", "left_anti").union(repeats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_size(batch):
                sides = [
                    list(_sets(words(pa.array(unpacked(part[c]), pa.binary()).cast(pa.string()))))
                    for c in ("packed", "other")
                ]
                linked = [
                    100 * (both := len(np.intersect1d(x, y, assume_unique=True)))
                    >= 80 * (len(x) + len(y) - both)
                    for x, y in zip(*sides, strict=True)
                ]
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return (
        pairs.join(texts.select(F.col("doc_id").alias("a"), "packed"), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("other")), "b")
        .select("a", "b", "packed", "other")
        .mapInArrow(run, "a long, b long")
    )


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices with some two megabytes of packed texts."""
    sizes = pc.add(pc.binary_length(batch["packed"]), pc.binary_length(batch["other"]))
    block = np.cumsum(sizes.to_numpy(zero_copy_only=False)) // (2 << 20)
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def jaccard_join(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    rows = keyed(documents.select("doc_id", "text"))
    if rows is None:
        return _joined(documents)
    found = _by_row(rows)
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def _by_row(rows: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, component) of keyed rows; component is the key of one of them."""
    found = _joined(rows.select(F.col("row").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("component"))
    ids = rows.select("row", "doc_id").where("row IS NOT NULL").distinct()
    return stored(found.join(ids, "row", "left"), "rows")


def _joined(documents: DataFrame) -> DataFrame:
    """The same where only equal rows share a doc_id."""
    profiles = stored(_profiles(documents), "profiles")
    every = profiles.where("chunk IS NULL")
    classes = (
        every.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    )
    member = stored(
        every.where("doc_id IS NOT NULL")
        .join(classes, ["n", "h1", "h2"], "left")
        .select("doc_id", "n", "rep", F.col("h1").alias("node"), "signature", "small"),
        "members",
    )
    sets = member.where("doc_id = rep").dropDuplicates(["rep"])
    total = every.agg(F.sum("n")).first()[0] or 0
    sizes = sets.where(F.col("n") <= _SMALL).groupBy("n").count().collect()
    light = boundary(dict((n, k) for n, k in sizes))

    postings = _postings(documents, _levels(profiles, total), light)
    hubs = (
        postings.groupBy("shingle")
        .agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"))
        .where("hub < last")
        .select("shingle", "hub")
    )
    lists = stored(postings.drop("doc_id").join(hubs, "shingle"), "lists")
    hub_node = member.select(F.col("doc_id").alias("hub"), F.col("node").alias("other")).distinct()
    to_hub = lists.select("node", "hub").distinct().join(hub_node, "hub").where("node <> other")
    to_hub = stored(to_hub, "to_hub")
    first = stored(_verified(_possible(to_hub, sets).distinct(), documents).union(_light_links(sets, light)), "linked")

    # A list is done if all its members are in the component of its hub.
    known = components(first).withColumnRenamed("node", "rep")
    component_of = stored(
        sets.join(known, "rep", "left").select("node", F.coalesce("component", "rep").alias("p")), "known"
    )
    apart = (
        to_hub.join(component_of, "node")
        .join(component_of.select(F.col("node").alias("other"), F.col("p").alias("q")), "other")
        .where("p <> q")
        .select("node", "hub")
        .distinct()
    )
    undone = lists.join(apart, ["node", "hub"], "left_semi").select("shingle").distinct()
    # Stored between, so that copies are merged by all three columns and none is a hot key.
    undone = stored(lists.join(undone, "shingle").select("shingle", "node", "place"), "undone")
    n, at = F.col("place").bitwiseAND(0xFFFFFFFF), F.shiftright("place", 32)
    undone = undone.distinct().join(component_of, "node")
    undone = stored(undone.select("shingle", "node", "p", n.alias("n"), (n - at).alias("rest")), "open")
    close = """x.shingle = y.shingle AND x.p <> y.p AND x.node < y.node
        AND x.n * 5 >= y.n * 4 AND y.n * 5 >= x.n * 4
        AND least(x.rest, y.rest) >= (4 * (x.n + y.n) + 8) DIV 9"""
    across = undone.alias("x").join(undone.alias("y"), F.expr(close))
    across = across.selectExpr("x.node AS node", "y.node AS other").distinct()
    second = _verified(_possible(across, sets), documents)
    whole = components(first.union(second))
    rep_of = member.select("doc_id", "rep").distinct()
    return (
        profiles.where("chunk IS NULL")
        .select("doc_id", "n")
        .join(rep_of, "doc_id", "left")
        .join(whole.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    )


def keep_first(documents: DataFrame) -> DataFrame:
    """One row of each component, one of the least id; all without shingles, and all without
    doc_id. Other columns pass, whatever their names. An empty table stays empty."""
    return put_back(_first_rows(set_aside(documents)), documents)


def _first_rows(documents: DataFrame) -> DataFrame:
    rows = keyed(documents)
    if rows is None:
        gone = _joined(documents).where("doc_id <> component_id").select("doc_id").distinct()
        return documents.join(stored(gone, "copies"), "doc_id", "left_anti").select(documents.columns)
    found = _by_row(rows)
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    gone = found.join(first, "component").where("n_shingles > 0 AND row <> first.row").select("row").distinct()
    kept = rows.join(stored(gone, "copies"), "row", "left_anti")
    # Of equal rows one is left, unless they have no words.
    equal = kept.where("repeated").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    others = kept.where("NOT repeated").union(
        kept.where("repeated").where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    )
    one = equal.groupBy("row").agg(F.min(F.struct(*documents.columns)).alias("one")).select("one.*")
    return others.select(documents.columns).union(one.select(documents.columns))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

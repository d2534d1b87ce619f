"""Connected components by alternating stars; no node's links are ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrade.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of (a, b); links to itself
    and null ends are ignored. Every round is written, so no plan grows."""
    edges = stored(_oriented(links.select("a", "b")), "links")
    seen = _digest(edges)
    while seen[0]:
        edges = stored(_small_star(_large_star(edges)), "links")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    # Now every edge leads from a node to the least node of its component.
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _oriented(links: DataFrame) -> DataFrame:
    return (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link all larger neighbours of a node to the least of its neighbours and itself."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _oriented(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.union(least))


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))), F.lit(0))
    ).first()
    return row[0], row[1]

"""Keys of rows, for tables where several rows may have one doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrade.llm.store import stored

BROADCAST_IDS = 2_000_000
"""So many repeated ids at most are broadcast: some 50 MB in memory."""


def set_aside(documents: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one struct ``others``, so that no name of theirs
    meets a working name."""
    others = [F.col(_quoted(c)) for c in documents.columns if c not in ("doc_id", "text")]
    return documents.select("doc_id", "text", F.struct(*(others or [F.lit(True).alias("none")])).alias("others"))


def put_back(rows: DataFrame, documents: DataFrame, **made: str) -> DataFrame:
    """Rows that were set aside, with the columns of ``documents`` in their order; a column of
    ``made`` comes from the column of ``rows`` it names."""
    return rows.select(
        *[
            F.col(c if c in ("doc_id", "text") else made[c]).alias(c)
            if c in ("doc_id", "text") or c in made
            else F.col("others").getField(c).alias(c)
            for c in documents.columns
        ]
    )


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def keyed(documents: DataFrame) -> DataFrame | None:
    """The rows with ``row`` and ``repeated``; None if no doc_id is repeated.

    ``row`` is the doc_id where one row has it, else a hash of id and text, so only equal
    rows share it. Rows without doc_id have none.
    """
    ids = documents.select("doc_id").where("doc_id IS NOT NULL")
    again = stored(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    n = again.count()
    if not n:
        return None
    again = again.withColumn("repeated", F.lit(True))
    rows = documents.join(F.broadcast(again) if n <= BROADCAST_IDS else again, "doc_id", "left")
    by_text = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    return rows.withColumn("repeated", F.coalesce("repeated", F.lit(False))).withColumn(
        "row", F.when(F.col("repeated"), by_text).otherwise(F.col("doc_id"))
    )

"""Load cleaned rows into the answer key kept in a folder, with the quarantine next to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrade.schema import ANSWER_KEY_SCHEMA
from tremorgrade.sinks.folders import Staging
from tremorgrade.sources.cleaning import Ingested, Stored

KEY, QUARANTINE, REPEATED, REPORT = "answer_key", "quarantine", "repeated_ids", "import_report"


@dataclass(frozen=True)
class Loaded:
    """What a load did: rows read, parsed, loaded, rejected, and ids that stood on several rows."""

    rows_read: int
    parsed: int
    loaded: int
    rejected: int
    repeated: int


def merge_key(at_hand: DataFrame | None, new: DataFrame) -> DataFrame:
    """The key with ``new`` rows loaded: one row per id, a new row in place of an old one.

    Of several new rows with one id the one sent last stays, then the one whose columns are
    greater in their order; so with old rows. One aggregate does both, merged before its
    shuffle: however many rows share an id, one per task is sent.
    """
    names = ANSWER_KEY_SCHEMA.names
    order = ["send_time", *[n for n in names if n not in ("id", "send_time")]]
    rows = new.select("*", F.lit(True).alias("_new"))
    if at_hand is not None:
        rows = at_hand.select("*", F.lit(False).alias("_new")).unionByName(rows)
    last = F.max(F.struct("_new", *order)).alias("_last")
    return rows.groupBy("id").agg(last).select("id", *[F.col(f"_last.{n}") for n in names[1:]])


def repeated_ids(new: DataFrame) -> DataFrame:
    """id and rows of every id that stands on several new rows."""
    return new.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def load_key(ingested: Ingested, path: str, append: bool = False) -> Loaded:
    """Merge the loaded rows into ``path/answer_key`` and write the quarantine next to it.

    Rows are read and checked once. ``append`` numbers them on from the greatest id at
    hand, as a table that numbers its rows itself would; otherwise an id at hand is
    replaced. Quarantine, repeated ids and report are those of this load. All tables
    change places together at the end.
    """
    stored = ingested if isinstance(ingested, Stored) else ingested.stored()
    new = stored.loaded
    spark = new.sparkSession
    staging = Staging(spark, path)
    at_hand = spark.read.parquet(f"{path}/{KEY}") if staging.has(KEY) else None
    if append and at_hand is not None:
        last = at_hand.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = new.withColumn("id", F.col("id") + F.lit(last))
    staging.write(KEY, merge_key(at_hand, new))
    staging.write(QUARANTINE, stored.rejected)
    staging.write(REPEATED, repeated_ids(new))
    staging.write(REPORT, stored.report())
    repeated = spark.read.parquet(f"{staging.folder}/{REPEATED}").count()
    staging.swap()
    return Loaded(*stored.counts, repeated)

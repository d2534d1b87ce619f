"""What is known about an answer key before its plan is built.

One small aggregate over the key (three columns, one result row) decides which
plans are safe: how many waves there are bounds every key-sized frame, and the
first and last instant bound the alarms that can match at all.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sizing:
    """Limits that choose between the broadcast plan and the shuffled one.

    ``broadcast_waves``: waves up to which key-sized frames are broadcast. Per
    wave these are at most two cells (24 bytes), three wanted instants (40
    bytes) and one row of matched values (about 300 bytes), so the default
    stays under about 350 MB, hash tables included. Beyond it Spark splits what a hot key
    makes too large, by the sizes it measures.
    """

    broadcast_waves: int = 500_000


@dataclass(frozen=True)
class KeyProfile:
    """``cell_sizes``: a bit for each size the windows need (see ``match``), if known yet."""

    waves: int
    first: datetime | None
    last: datetime | None
    sizing: Sizing
    cell_sizes: int | None = None

    @property
    def small(self) -> bool:
        return self.waves <= self.sizing.broadcast_waves


def profile_key(key: DataFrame, sizing: Sizing = Sizing()) -> KeyProfile:
    """Count the waves and bound their time range. Runs one aggregate job."""
    row = key.agg(
        F.count(F.lit(1)).alias("waves"),
        F.min("send_time").alias("first"),
        F.greatest(F.max("send_time"), F.max("end_time")).alias("last"),
    ).first()
    return KeyProfile(row.waves, row.first, row.last, sizing)


def attach(rows: DataFrame, lookup: DataFrame, on: list[str], profile: KeyProfile) -> DataFrame:
    """Left join ``lookup``, unique on ``on``, to ``rows``.

    Beyond the broadcast size both sides are shuffled. If ``lookup`` is a stored table, both
    come straight from their shuffle, so Spark measures the partitions and splits those that
    a key shared by many rows makes too large.
    """
    return rows.join(F.broadcast(lookup) if profile.small else lookup, on, "left")

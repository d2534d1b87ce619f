"""Turn the timetable into evaluation windows.

A wave's window runs from its send time to the next wave's send time; the last
one is closed by its own end time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorgrade.functions import micros
from tremorgrade.operators.sizing import KeyProfile, attach
from tremorgrade.session import computed_once


def add_windows(key: DataFrame, profile: KeyProfile) -> DataFrame:
    """Add ``next_send_time``; waves sent at one instant follow each other by id.

    Waves that also share the greatest id of their instant end alike, at the next
    one. A lead over the whole timetable would sort every row in one task, so it is taken
    inside buckets of time whose heads carry it across.
    """
    return _inside_days(key) if profile.small else _over_instants(key, profile)


def _inside_days(key: DataFrame) -> DataFrame:
    """Waves sorted inside their days: one shuffle of the key, no join but to the days' heads.

    A day may hold any share of the waves, so this is for keys whose size is checked.
    """
    dated = key.withColumn("_day", F.to_date("send_time"))
    days = _next_heads(dated.groupBy("_day").agg(F.min("send_time").alias("_head")))
    # At most a row per wave, and far fewer: the calendar days with a wave.
    return _in_days(dated.join(F.broadcast(days.select("_day", "_next_head")), "_day", "left"), key.columns)


def _in_days(by_day: DataFrame, columns: list[str]) -> DataFrame:
    """Ends of waves that know their ``_day`` and the ``_next_head``."""
    # One partitioning for all three, and one sort. Only the first wave of an instant has a
    # mark, so the next mark is a later instant.
    in_day = "OVER (PARTITION BY _day ORDER BY send_time, id)"
    of_instant = "OVER (PARTITION BY _day ORDER BY send_time RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    marked = by_day.select(
        "*",
        F.expr(f"CASE WHEN NOT lag(send_time) {in_day} <=> send_time THEN send_time END AS _mark"),
        F.expr(f"max(id) {of_instant} AS _last_id"),
    )
    following = marked.withColumn("_in_day", F.expr(f"lead(_mark) IGNORE NULLS {in_day}"))
    return _ended(following, columns, F.coalesce("_in_day", "_next_head"))


def extend_windows(windows: DataFrame, new: DataFrame) -> DataFrame:
    """The windows of a key to which waves were appended, from its windows of before.

    A wave ends at a later wave of its day or at the head of the next day. So only days with
    a new wave and the last day before each are computed again; all others pass as they are,
    unsorted and unshuffled. Meant for a few new waves; ``add_windows`` does whole keys.
    """
    columns = new.columns
    old = windows.select(*[F.col(f"`{c}`") for c in columns], F.lit(False).alias("_new"))
    key = old.unionByName(new.withColumn("_new", F.lit(True))).withColumn("_day", F.to_date("send_time"))
    days = key.where("_day IS NOT NULL").groupBy("_day").agg(
        F.min("send_time").alias("_head"), F.max("_new").alias("_new")
    )
    # One row per calendar day, here and where it is broadcast.
    order = Window.orderBy("_day")
    next_new = F.coalesce(F.lead("_new").over(order), F.lit(False))
    days = F.broadcast(
        days.select("_day", F.lead("_head").over(order).alias("_next_head"), (F.col("_new") | next_new).alias("_changed"))
    )
    changed = key.drop("_new").join(days, "_day", "left").where("coalesce(_changed, true)")
    names = [F.col(f"`{c}`") for c in columns]
    same = windows.withColumn("_day", F.to_date("send_time")).join(days, "_day").where("NOT _changed")
    return _in_days(changed, columns).unionByName(same.select(*names, "next_send_time"))


def _over_instants(key: DataFrame, profile: KeyProfile) -> DataFrame:
    # Stored, so that both sides of the join come straight from a shuffle and Spark can
    # split an instant that many waves share.
    following = computed_once(following_instants(key))
    return _ended(attach(key, following, ["send_time"], profile), key.columns, F.col("_following"))


def following_instants(key: DataFrame) -> DataFrame:
    """Every instant with its greatest id and the instant after it.

    Leads over distinct instants, inside seconds, then days: however the waves are spread,
    a second holds at most a million instants and a day at most 86,400 seconds.
    """
    instants = (
        key.where("send_time IS NOT NULL")
        .groupBy("send_time")
        .agg(F.max("id").alias("_last_id"))
        .withColumn("_second", F.expr(f"{micros('send_time')} DIV 1000000"))
    )
    seconds = instants.groupBy("_second").agg(F.min("send_time").alias("_head"))
    seconds = seconds.withColumn("_day", F.to_date("_head"))
    days = _next_heads(seconds.groupBy("_day").agg(F.min("_head").alias("_head")))

    in_day = Window.partitionBy("_day").orderBy("_head")
    seconds = (
        seconds.withColumn("_in_day", F.lead("_head").over(in_day))
        .join(days.select("_day", "_next_head"), "_day")
        .select("_second", F.coalesce("_in_day", "_next_head").alias("_next_second"))
    )
    in_second = Window.partitionBy("_second").orderBy("send_time")
    return (
        instants.withColumn("_in_second", F.lead("send_time").over(in_second))
        .join(seconds, "_second")
        .select("send_time", "_last_id", F.coalesce("_in_second", "_next_second").alias("_following"))
    )


def _ended(rows: DataFrame, columns: list[str], following) -> DataFrame:
    """All but the last of the waves sent at one instant end where they start."""
    ends = F.when(F.col("id") < F.col("_last_id"), F.col("send_time"))
    return rows.select(
        *[F.col(f"`{name}`") for name in columns],
        F.coalesce(ends, following, F.col("end_time")).alias("next_send_time"),
    )


def _next_heads(days: DataFrame) -> DataFrame:
    """Add the next day's head. One row per calendar day: thousands, not data."""
    return days.where("_head IS NOT NULL").withColumn(
        "_next_head", F.lead("_head").over(Window.orderBy("_head"))
    )

"""First reports per event id, and their cut by a time range."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrade.functions import seconds_between
from tremorgrade.operators.grade import S_LEVELS
from tremorgrade.schema import P_ALARM_ID, S_ALARM_ID
from tremorgrade.sources.alarms import DAY, not_before, until


def p_by_id(p_alarms: DataFrame) -> DataFrame:
    """The first P alarm of each event; alarms without an event id are one group.

    A minimum is merged before the shuffle, so an event with a third of all
    alarms costs the reducers one row per map task.
    """
    first = F.expr(f"min({_nulls_last(P_ALARM_ID)}) AS _first")
    return p_alarms.groupBy("earth_id").agg(first).selectExpr("earth_id", *_times("_first", ""))


def s_by_id(s_alarms: DataFrame) -> DataFrame:
    """The first S alarm of each event, and the first over each level, in one pass.

    Alarms without an event id belong together but describe no event: their one
    row is all null.
    """
    first = f"min({_nulls_last(S_ALARM_ID)}) FILTER (WHERE earth_id IS NOT NULL"
    return (
        s_alarms.groupBy("earth_id")
        .agg(
            F.expr(f"{first}) AS _first"),
            *[F.expr(f"{first} AND x_acc_value >= {S_LEVELS[n]}) AS _{n}") for n in S_LEVELS],
        )
        .selectExpr(
            "earth_id",
            *_times("_first", ""),
            *[column for n in S_LEVELS for column in _times(f"_{n}", f"{n}_")],
        )
    )


def p_by_id_in_range(p_alarms: DataFrame, start, end) -> DataFrame:
    """``p_by_id`` whose first alarm lies in the closed range.

    Alarms after the range cannot change that: an event whose first alarm they
    would be is out anyway. So that bound is applied to the scan as well.
    """
    return in_range(p_by_id(until(p_alarms, _bound(end))), start, end)


def s_first_in_range(s_alarms: DataFrame, start, end) -> DataFrame:
    """Only the first alarm of any level of each event, where it lies in the closed range.

    As for P, alarms after the range cannot change which events these are, so their
    bound reaches the scan; the levels of ``s_by_id_in_range`` may come later and need them.
    """
    rows = until(s_alarms, _bound(end)).where("earth_id IS NOT NULL")
    first = F.expr(f"min({_nulls_last(S_ALARM_ID)}) AS _first")
    return in_range(rows.groupBy("earth_id").agg(first).selectExpr("earth_id", *_times("_first", "")), start, end)


def s_by_id_in_range(s_alarms: DataFrame, start, end) -> DataFrame:
    """``s_by_id`` whose first alarm of any level lies in the closed range.

    Of a log kept by day, days after the range tell nothing about which events these are,
    and days before it nothing about their alarms: either end is read once without the other.
    """
    if DAY not in s_alarms.columns:
        return in_range(s_by_id(s_alarms), start, end)
    events = s_first_in_range(s_alarms, start, end).select("earth_id")
    return s_by_id(not_before(s_alarms, _bound(start)).join(events, "earth_id", "left_semi"))


def in_range(reports: DataFrame, start, end) -> DataFrame:
    return reports.where(f"jk_time BETWEEN {_bound(start)} AND {_bound(end)}")


def _nulls_last(alarm_id: str) -> str:
    """Orders alarms by time, unknown times last, then by id."""
    return f"struct(jk_time IS NULL AS _unknown, jk_time, {alarm_id}, rcv_jktime)"


def _times(first: str, prefix: str) -> list[str]:
    sent, received = f"{first}.jk_time", f"{first}.rcv_jktime"
    return [
        f"{sent} AS {prefix}jk_time",
        f"{received} AS {prefix}rcv_jktime",
        f"{seconds_between(received, sent)} AS {prefix}send_time",
    ]


def _bound(at: str | datetime) -> str:
    """A range end, taken to the millisecond."""
    if isinstance(at, str):
        at = datetime.fromisoformat(at)
    return f"TIMESTAMP_NTZ '{at.isoformat(sep=' ', timespec='milliseconds')}'"

"""Alarm logs as DataFrames; columns beyond the known ones are allowed.

A log kept by day has a column ``jk_day``, the day of ``jk_time``, and a folder for each of
its values. Wherever a log is cut by time the cut is put on both, so only the folders of
these days are read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "jk_day"


def alarms_from_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def alarms_from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def check_layout(alarms: DataFrame, schema: T.StructType) -> None:
    """Refuse a log that lacks a column of the known layout or has it in another type."""
    found = {f.name: f.dataType for f in alarms.schema}
    wrong = [f.name for f in schema if f.name in found and found[f.name] != f.dataType]
    lacking = [f.name for f in schema if f.name not in found]
    if wrong or lacking:
        raise ValueError(f"not an alarm log: lacking {lacking or 'nothing'}, of another type {wrong or 'nothing'}")


def write_by_day(alarms: DataFrame, path: str, alarm_id: str) -> None:
    """Append a log to one kept by day.

    Rows are dealt by ranges of day, time and alarm id, so a day with a third of all alarms,
    or an instant, becomes several files of about the size of others. Alarms without a time
    have a folder of their own.
    """
    dated = alarms.withColumn(DAY, F.to_date("jk_time"))
    dated.repartitionByRange(DAY, "jk_time", alarm_id).write.mode("append").partitionBy(DAY).parquet(path)


def between(alarms: DataFrame, first: str, last: str) -> DataFrame:
    """Alarms from one instant to another, both as SQL text."""
    cut = alarms.where(f"jk_time BETWEEN {first} AND {last}")
    if DAY in alarms.columns:
        cut = cut.where(f"{DAY} BETWEEN to_date({first}) AND to_date({last})")
    return cut


def until(alarms: DataFrame, last: str) -> DataFrame:
    """Alarms up to an instant, given as SQL text."""
    cut = alarms.where(f"jk_time <= {last}")
    return cut.where(f"{DAY} <= to_date({last})") if DAY in alarms.columns else cut


def not_before(alarms: DataFrame, first: str) -> DataFrame:
    """Alarms from an instant on, given as SQL text, and those without a time."""
    cut = alarms.where(f"jk_time >= {first} OR jk_time IS NULL")
    if DAY in alarms.columns:
        cut = cut.where(f"{DAY} >= to_date({first}) OR {DAY} IS NULL")
    return cut


def jdbc_options(
    url: str, table: str, first: datetime, last: datetime, partitions: int
) -> dict[str, str]:
    """Options that read a database table in parallel slices of time.

    Rows outside the two instants or without a time go to the outer slices.
    """
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": "jk_time",
        "lowerBound": first.isoformat(sep=" "),
        "upperBound": last.isoformat(sep=" "),
        "numPartitions": str(partitions),
        "preferTimestampNTZ": "true",
    }


def alarms_from_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Read with ``jdbc_options`` plus user, password and driver."""
    return spark.read.format("jdbc").options(**options).load()

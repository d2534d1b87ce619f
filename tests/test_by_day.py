"""Logs kept by day: which folders are read, and that tables are the same."""

import re

import pytest
from conftest import P_ALARMS, S_ALARMS, WAVES, at, make_key, make_p, make_s
from pyspark.sql import functions as F

from tremorgrade import Evaluation
from tremorgrade.operators import by_id
from tremorgrade.schema import P_ALARM_ID, P_ALARM_SCHEMA, S_ALARM_ID
from tremorgrade.sources import alarms


def plan(frame):
    return frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def moved(rows, schema, days):
    """The log again on other days, under other ids."""
    alarm_id = schema.names[0]
    return rows.crossJoin(rows.sparkSession.range(days)).select(
        F.concat_ws("-", alarm_id, "id").alias(alarm_id),
        *[
            F.expr(f"timestampadd(DAY, CAST(id AS INT), {c})").alias(c) if c in ("jk_time", "rcv_jktime")
            else F.concat_ws("-", "earth_id", "id").alias(c) if c == "earth_id" else F.col(c)
            for c in schema.names[1:]
        ],
    )


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("days")
    p = moved(make_p(spark, P_ALARMS), make_p(spark, []).schema, 5)
    s = moved(make_s(spark, S_ALARMS), make_s(spark, []).schema, 5)
    alarms.write_by_day(p, f"{root}/p", P_ALARM_ID)
    alarms.write_by_day(s, f"{root}/s", S_ALARM_ID)
    return p, s, spark.read.parquet(f"{root}/p"), spark.read.parquet(f"{root}/s")


def partition_filters(text):
    return [f for f in re.findall(r"PartitionFilters: \[([^\]]*)\]", text) if "jk_day" in f]


def test_all_rows_are_kept(logs):
    p, s, p_days, s_days = logs
    assert sorted(map(repr, p_days.select(p.columns).collect())) == sorted(map(repr, p.collect()))
    assert s_days.count() == s.count()
    assert p_days.where("jk_day IS NULL").count() == p.where("jk_time IS NULL").count() > 0


@pytest.mark.parametrize("table", ["p_compare", "s_compare", "details", "p_by_id", "s_by_id"])
def test_tables_are_the_same(spark, logs, table):
    p, s, p_days, s_days = logs
    key = make_key(spark, WAVES)
    found = [getattr(Evaluation(key, *pair), table)() for pair in ((p, s), (p_days, s_days))]
    assert sorted(map(repr, found[0].collect())) == sorted(map(repr, found[1].collect()))


def test_the_key_s_range_prunes_days(spark, logs):
    *_, p_days, s_days = logs
    run = Evaluation(make_key(spark, WAVES), p_days, s_days)
    for table in (run.p_matched(), run.s_matched()):
        filters = partition_filters(plan(table))
        assert len(filters) == 2 and all(">= 2024-01-01" in f and "<= 2024-01-01" in f for f in filters)


@pytest.mark.parametrize("hours", [(0, 24), (24, 48), (30, 100), (200, 300)])
def test_cut_by_time(spark, logs, hours):
    p, s, p_days, s_days = logs
    start, end = (at("00:00:00") + (at("01:00:00") - at("00:00:00")) * h for h in hours)
    for cut, whole, days in (
        (by_id.p_by_id_in_range, p, p_days),
        (by_id.s_by_id_in_range, s, s_days),
        (by_id.s_first_in_range, s, s_days),
    ):
        found = cut(days, start, end)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, cut(whole, start, end).collect()))
        assert partition_filters(plan(found))


def test_a_hot_day_becomes_several_files(spark, tmp_path):
    rows = spark.range(40_000).selectExpr(
        "CAST(id AS STRING) AS alarm", "CASE WHEN id % 3 > 0 THEN TIMESTAMP_NTZ '2024-01-01 10:00:00'"
        " ELSE TIMESTAMP_NTZ '2024-01-02 10:00:00' END AS jk_time",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        alarms.write_by_day(rows, str(tmp_path / "log"), "alarm")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "log" / "jk_day=2024-01-01").glob("*.parquet"))) > 1
    alarms.write_by_day(rows.limit(10), str(tmp_path / "log"), "alarm")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 40_010


def test_layout_is_checked(spark):
    alarms.check_layout(make_p(spark, P_ALARMS), P_ALARM_SCHEMA)
    with pytest.raises(ValueError, match="lacking \\['jk_time'\\]"):
        alarms.check_layout(make_p(spark, []).drop("jk_time"), P_ALARM_SCHEMA)
    with pytest.raises(ValueError, match="another type \\['epi_dist'\\]"):
        alarms.check_layout(make_p(spark, []).withColumn("epi_dist", F.lit("x")), P_ALARM_SCHEMA)

"""The plans that must hold at scale: what is read, moved and joined how."""

import os
import re

import pytest

from conftest import at
from tremorgrade import Evaluation, Sizing
from tremorgrade.operators import by_id
from tremorgrade.operators.match import First, _earliest, match_windows
from tremorgrade.operators.windows import add_windows, following_instants
from tremorgrade.schema import P_ALARM_ID
from tremorgrade.sources import event_tables

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """The alarm logs as files of their own, so that scans show what they read."""
    root = tmp_path_factory.mktemp("logs")
    for name in ("p_alarms", "s_alarms"):
        getattr(event_tables, name)(spark, SF).write.parquet(f"{root}/{name}")
    return spark.read.parquet(f"{root}/p_alarms"), spark.read.parquet(f"{root}/s_alarms")


def plan(frame):
    return frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def evaluation(spark, logs, **sizing):
    return Evaluation(event_tables.answer_key(spark, SF), *logs, Sizing(**sizing))


def log_scans(text):
    return [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "jk_time" in s]


TABLES = ["p_matched", "p_compare", "s_matched", "s_compare", "details", "scorecard"]


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize("waves", [500_000, 0])
def test_no_pairwise_joins(spark, logs, table, waves):
    text = plan(getattr(evaluation(spark, logs, broadcast_waves=waves), table)())
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "BatchEvalPython" not in text and "ArrowEval" not in text


@pytest.mark.parametrize("table", TABLES)
def test_the_log_is_not_moved_when_windows_are_few(spark, logs, table):
    text = plan(getattr(evaluation(spark, logs), table)())
    # Whatever is shuffled from the log has been merged per window before.
    assert "SortMergeJoin" not in text
    assert len(re.findall(r"partial_min", text)) >= 2


def test_nothing_is_broadcast_by_force_when_windows_are_many(spark, logs):
    run = evaluation(spark, logs, broadcast_waves=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(run.details())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in text


def test_hot_instants_are_merged_and_what_stays_hot_is_split(spark, tmp_path):
    """A third of all alarms share one instant, which many waves want."""
    key = event_tables.answer_key(spark, SF).where("send_time IS NOT NULL")
    hot = key.selectExpr("min(send_time) AS t").first().t
    rows = event_tables.p_alarms(spark, SF).where("jk_time IS NOT NULL").crossJoin(spark.range(400).withColumnRenamed("id", "n"))
    rows.selectExpr(
        f"concat({P_ALARM_ID}, '-', n) AS {P_ALARM_ID}",
        f"CASE WHEN n % 3 = 0 THEN TIMESTAMP_NTZ '{hot}' ELSE timestampadd(MILLISECOND, CAST(n AS INT), jk_time) END AS jk_time",
        f"* EXCEPT (n, jk_time, {P_ALARM_ID})",
    ).repartition(8, P_ALARM_ID).write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "16",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        many = Evaluation(key, p, event_tables.s_alarms(spark, SF), Sizing(broadcast_waves=0))
        profile = many.profile
        firsts = [First("first", ("sta_code",))]
        first_pass = _earliest(many.windows, p, firsts, profile, None)
        text = plan(first_pass)
        # Read from the scan upwards: merged per instant, shuffled, merged again, then probed.
        assert re.search(r"HashAggregate\(keys=\[jk_time[^\n]*\n[^\n]*Exchange hashpartitioning\(jk_time", text)
        second = match_windows(many.windows, p, P_ALARM_ID, firsts, profile)
        found = sorted(map(str, second.collect()))
        assert "SortMergeJoin(skew=true)" in plan(second)
        few = Evaluation(key, p, event_tables.s_alarms(spark, SF))
        expected = match_windows(few.windows, p, P_ALARM_ID, firsts, few.profile)
        assert found == sorted(map(str, expected.collect()))
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_first_pass_reads_two_columns_and_second_pass_the_rest(spark, logs):
    text = plan(evaluation(spark, logs).s_matched())
    scans = log_scans(text)
    assert any(set(re.findall(r"(\w+):", s)) == {"jk_time", "x_acc_value"} for s in scans)
    assert not any("earth_id" in s for s in scans)


def test_time_range_of_the_key_reaches_the_scan(spark, logs):
    text = plan(evaluation(spark, logs).p_matched())
    pushed = [p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", text) if "jk_time" in p]
    assert pushed
    assert all("GreaterThanOrEqual(jk_time" in p and "LessThanOrEqual(jk_time" in p for p in pushed)


def test_s_match_of_the_full_report_does_not_repeat_the_p_match(spark, logs):
    text = plan(evaluation(spark, logs).details())
    p_scans = [s for s in log_scans(text) if "x_acc_value" not in s and "earthquake_level" in s]
    assert len(p_scans) == 1


def test_range_end_reaches_the_scan_of_the_p_log(spark, logs):
    p, _ = logs
    text = plan(by_id.p_by_id_in_range(p, at("00:00:00"), at("12:00:00")))
    assert "LessThanOrEqual(jk_time" in text
    schema = log_scans(text)[0]
    assert set(re.findall(r"(\w+):", schema)) == {"earth_id", "jk_time", "rcv_jktime", P_ALARM_ID}


def test_range_end_reaches_the_scan_of_the_s_log(spark, logs):
    _, s = logs
    text = plan(by_id.s_first_in_range(s, at("00:00:00"), at("12:00:00")))
    assert "LessThanOrEqual(jk_time" in text and "x_acc_value" not in log_scans(text)[0]


def test_by_id_merges_before_it_shuffles(spark, logs):
    _, s = logs
    text = plan(by_id.s_by_id(s))
    assert text.count("Exchange") == 1 and "partial_min" in text


def test_windows_of_a_small_key_take_one_shuffle_of_it(spark, logs):
    run = evaluation(spark, logs)
    text = plan(add_windows(run.key, run._bounds))
    assert text.count("Exchange hashpartitioning(_day") == 2  # the key, and the days' heads
    assert "SortMergeJoin" not in text


def test_only_day_heads_come_together_in_one_partition(spark, logs):
    run = evaluation(spark, logs)
    for frame in (add_windows(run.key, run._bounds), following_instants(run.key)):
        text = plan(frame)
        assert "Exchange SinglePartition" in text
        for single in re.split(r"Exchange SinglePartition", text)[1:]:
            below = single.split("Exchange")[0]
            assert "min(" in below

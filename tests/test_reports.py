import os

import pytest
from conftest import P_ALARMS, S_ALARMS, WAVES, at, make_key, make_p, make_s
from tremorgrade import Evaluation
from tremorgrade.labels import DETAIL_COLUMNS_ZH, details_zh, in_chinese
from tremorgrade.plans.details import DETAIL_COLUMNS
from tremorgrade.plans.kpi import KPIS, TIMED_KPIS, Kpi, Share
from tremorgrade.sinks import writers
from tremorgrade.sinks.folders import Staging
from tremorgrade.sources import alarms


def evaluation(spark, p=P_ALARMS, s=S_ALARMS):
    return Evaluation(make_key(spark, WAVES), make_p(spark, p), make_s(spark, s))


def test_details(spark):
    rows = evaluation(spark).details()
    assert rows.columns == ["id", *DETAIL_COLUMNS] and len(DETAIL_COLUMNS) == 40
    found = {r.id: r for r in rows.collect()}
    assert len(found) == 3
    assert found[1].p_warning_miss is None and found[1].s_warning_miss is None
    assert found[3].p_warning_miss == "1"
    assert str(found[1].azi_angle_diff) == "340.000"


def test_details_mark_a_p_alarm_after_the_s_alarm(spark):
    late = [{"station_p_wave_alarm_id": "l", "jk_time": at("10:00:30"), "rcv_jktime": at("10:00:31")}]
    run = evaluation(spark, p=late)
    assert {r.id: r.p_warning_miss for r in run.details().collect()} == {1: "xs_hp", 2: "1", 3: "1"}
    assert run.kpi("kpi_s_before_p").first().s_before_p_count == 1


def test_details_in_chinese(spark):
    assert list(DETAIL_COLUMNS_ZH) == DETAIL_COLUMNS
    assert details_zh(evaluation(spark).details()).columns == ["id", *DETAIL_COLUMNS_ZH.values()]


def test_write_scorecard(spark, tmp_path):
    names = writers.write_scorecard(evaluation(spark), str(tmp_path))
    assert names == [*(k.name for k in KPIS), "scorecard"]
    assert spark.read.parquet(f"{tmp_path}/kpi_p_send").first().pass_rate == "33.33%"
    card = spark.read.parquet(f"{tmp_path}/scorecard")
    assert {r.kpi for r in card.collect()} == {k.name for k in KPIS}


def test_a_failing_kpi_holds_no_other_up_and_is_named(spark, tmp_path, monkeypatch):
    real = Staging.write

    def fails_once(self, name, rows, fmt="parquet"):
        if name == "kpi_p_judge":
            raise RuntimeError("disk full")
        real(self, name, rows, fmt)

    monkeypatch.setattr(Staging, "write", fails_once)
    with pytest.raises(writers.NotAllWritten, match="kpi_p_judge") as error:
        writers.write_scorecard(evaluation(spark), str(tmp_path))
    assert list(error.value.failed) == ["kpi_p_judge"] and len(error.value.written) == len(KPIS)
    assert sorted(os.listdir(tmp_path)) == sorted(error.value.written)


RANGE = at("10:00:00"), at("11:00:00")


def test_all_tables_read_stored_frames(spark, tmp_path):
    """Three scans a log for all 29 tables: two of the match, one by event id."""
    for name, rows in (("p", make_p(spark, P_ALARMS)), ("s", make_s(spark, S_ALARMS))):
        rows.write.parquet(f"{tmp_path}/log-{name}")
    logs = [spark.read.parquet(f"{tmp_path}/log-{name}") for name in "ps"]
    run = Evaluation(make_key(spark, WAVES), *logs)
    stored = run.stored()
    tables = stored.tables(*RANGE)
    assert len(tables) == 29 and "scorecard" in tables
    for name, rows in tables.items():
        assert not any("/log-" in file for file in rows.inputFiles()), name
    shared = [run.graded, run.p_by_id(), run.s_by_id()]
    plans = "".join(rows._jdf.queryExecution().executedPlan().toString() for rows in shared)
    assert plans.count("/log-p") == 3 and plans.count("/log-s") == 3
    for name, rows in run.tables(*RANGE).items():
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, tables[name].collect())), name


def test_save_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE graded LOCATION '{tmp_path}/db'")
    try:
        run = evaluation(spark)
        names = writers.save_tables(run, "graded", *RANGE, labels=in_chinese)
        assert len(names) == 29
        assert spark.table("graded.kpi_p_send").first()["合格率"] == "33.33%"
        assert spark.table("graded.p_by_id_in_range").count() == 2
        writers.save_tables(run, "graded")
        assert spark.table("graded.kpi_p_send").first().pass_rate == "33.33%"
    finally:
        spark.sql("DROP DATABASE graded CASCADE")


def test_sinks_under_the_labels_of_their_readers(spark, tmp_path):
    run = evaluation(spark)
    writers.write_tables(run, f"{tmp_path}/all", start=RANGE[0], end=RANGE[1], labels=in_chinese)
    names = {t: set(spark.read.parquet(f"{tmp_path}/all/{t}").columns) for t in ("details", "tkpi_s80_send", "p_compare")}
    assert set(DETAIL_COLUMNS_ZH.values()) < names["details"]
    assert {"项目", "是否达标"} < names["tkpi_s80_send"] and "magnitude_diff" in names["p_compare"]
    writers.write_scorecard(run, f"{tmp_path}/card", "csv", labels=in_chinese)
    card = spark.read.option("header", True).csv(f"{tmp_path}/card/kpi_s_peak")
    assert card.first()["项目"] == "阈值报警最大偏差≤5%"
    writers.write_details(run, f"{tmp_path}/details", "csv", labels=in_chinese)
    details = spark.read.option("header", True).csv(f"{tmp_path}/details")
    assert details.columns == list(DETAIL_COLUMNS_ZH.values())
    assert details.first()["波形发送时间"] == "2024-01-01 10:00:00"


def test_write_details_as_text(spark, tmp_path):
    writers.write_details(evaluation(spark), str(tmp_path / "d"), "csv")
    rows = spark.read.option("header", True).csv(str(tmp_path / "d")).collect()
    # The alarm came at 10:00:06.100; text goes to the second.
    assert [r.p_first_rcv_jktime for r in rows] == ["2024-01-01 10:00:06", "2024-01-01 10:02:00", None]
    assert rows[0].asDict().keys() == set(DETAIL_COLUMNS)


def test_write_tables(spark, tmp_path):
    run = evaluation(spark)
    names = writers.write_tables(run, str(tmp_path))
    assert len(names) == 7 + len(KPIS)
    for name, table in (("p_compare", run.p_compare()), ("s_matched", run.s_matched())):
        assert spark.read.parquet(f"{tmp_path}/{name}").collect() == table.orderBy("id").collect()
    # Writing again replaces.
    writers.write_tables(run, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/details").count() == 3


def test_write_timed(spark, tmp_path):
    names = writers.write_timed(evaluation(spark), at("10:00:00"), at("11:00:00"), str(tmp_path))
    assert names[-4:] == [k.name for k in TIMED_KPIS]
    assert spark.read.parquet(f"{tmp_path}/p_by_id_in_range").count() == 2


def test_windows_are_computed_once_into_the_shared_folder(spark):
    run = evaluation(spark)
    assert run.windows is run.windows
    assert spark.conf.get("spark.checkpoint.dir") in run.windows.inputFiles()[0]
    assert run.windows.schema["azimuth"].metadata["comment"] == "azimuth"


def test_nothing_runs_before_a_table_needs_it(spark):
    run = evaluation(spark)
    run.p_by_id()
    assert "profile" not in run.__dict__ and "windows" not in run.__dict__


def test_alarm_sources(spark, tmp_path):
    path = str(tmp_path / "p")
    make_p(spark, P_ALARMS).selectExpr("*", "1 AS surplus").write.parquet(path)
    log = alarms.alarms_from_parquet(spark, path)
    log.createOrReplaceTempView("p_log")
    run = Evaluation(make_key(spark, WAVES), alarms.alarms_from_table(spark, "p_log"), make_s(spark, []))
    assert run.kpi("kpi_p_send").first().pass_count == 1
    options = alarms.jdbc_options("jdbc:x", "t", at("10:00:00"), at("11:00:00"), 8)
    assert options["partitionColumn"] == "jk_time" and options["upperBound"] == "2024-01-01 11:00:00"


def test_kpis_are_data(spark):
    own = Kpi("own", "p", "own", shares=(Share("magnitude_diff <= 0.2", 10, "≥10%"),))
    from tremorgrade.plans.kpi import run_kpi

    assert run_kpi(evaluation(spark).graded_p, own).first().pass_count == 1

from conftest import P_ALARMS, S_ALARMS, at, make_p, make_s
from tremorgrade.operators import by_id


def test_first_p_per_event(spark):
    extra = [
        {"station_p_wave_alarm_id": "z", "jk_time": at("11:00:00"), "rcv_jktime": at("11:00:01")},
        {"station_p_wave_alarm_id": "y", "jk_time": None, "rcv_jktime": at("09:00:00"), "earth_id": "E2"},
    ]
    rows = {r.earth_id: r for r in by_id.p_by_id(make_p(spark, P_ALARMS + extra)).collect()}
    assert set(rows) == {"E1", "E2", "E3", None}
    assert rows["E1"].rcv_jktime == at("10:00:06.100") and str(rows["E1"].send_time) == "0.100"
    assert rows["E2"].jk_time == at("10:02:00")  # an unknown time comes last
    assert rows["E3"].jk_time is None and rows["E3"].rcv_jktime == at("10:04:10")
    assert str(rows[None].send_time) == "1.000"


def test_first_s_per_event_and_level(spark):
    extra = [
        {"station_s_wave_alarm_id": "n", "jk_time": at("09:00:00"), "rcv_jktime": at("09:00:01"),
         "x_acc_value": 500.0},
        {"station_s_wave_alarm_id": "u", "jk_time": None, "rcv_jktime": at("09:00:01"),
         "x_acc_value": 100.0, "earth_id": "E9"},
    ]
    rows = {r.earth_id: r for r in by_id.s_by_id(make_s(spark, S_ALARMS + extra)).collect()}
    assert set(rows) == {"E1", "E9", None}
    assert (rows["E1"].jk_time, rows["E1"].gal80_jk_time, rows["E1"].gal120_jk_time) == (
        at("10:00:08"), at("10:00:09"), at("10:00:10"),
    )
    assert str(rows["E1"].gal120_send_time) == "0.050"
    assert all(v is None for v in rows[None])  # alarms of no event describe none
    assert rows["E9"].gal80_rcv_jktime == at("09:00:01") and rows["E9"].gal120_rcv_jktime is None


def test_range_is_closed_and_tests_the_first_alarm_only(spark):
    p, s = make_p(spark, P_ALARMS), make_s(spark, S_ALARMS)

    def ids(rows):
        return sorted(r.earth_id for r in rows.collect())

    assert ids(by_id.p_by_id_in_range(p, at("10:00:06"), at("10:02:00"))) == ["E1", "E2"]
    assert ids(by_id.p_by_id_in_range(p, at("10:00:06.001"), at("10:02:00"))) == ["E2"]
    (row,) = by_id.s_by_id_in_range(s, at("10:00:08"), at("10:00:08")).collect()
    assert row.gal120_jk_time == at("10:00:10")  # outside the range, kept
    # An event that began before the range is out though later alarms are in.
    assert ids(by_id.s_by_id_in_range(s, at("10:00:09"), at("10:00:11"))) == []


def test_pushed_range_end_changes_nothing(spark):
    p = make_p(spark, P_ALARMS)
    for end in ("10:00:05", "10:00:06", "10:01:59", "10:02:00"):
        cut = by_id.in_range(by_id.p_by_id(p), at("00:00:00"), at(end))
        assert sorted(by_id.p_by_id_in_range(p, at("00:00:00"), at(end)).collect()) == sorted(cut.collect())


def test_range_ends_are_cut_to_milliseconds(spark):
    p = make_p(spark, [{"station_p_wave_alarm_id": "a", "earth_id": "E", "jk_time": at("10:00:00.000500")}])
    assert by_id.p_by_id_in_range(p, at("09:00:00"), at("10:00:00.000900")).count() == 0


def test_pushed_range_end_keeps_the_first_s_alarms(spark):
    extra = [
        {"station_s_wave_alarm_id": "q", "jk_time": None, "rcv_jktime": at("09:00:01"), "earth_id": "E9"},
        {"station_s_wave_alarm_id": "r", "jk_time": at("10:00:09"), "rcv_jktime": at("10:00:10"), "earth_id": None},
        {"station_s_wave_alarm_id": "v", "jk_time": at("10:00:09"), "rcv_jktime": at("10:00:10"), "earth_id": "E8"},
    ]
    s = make_s(spark, S_ALARMS + extra)
    columns = ["earth_id", "jk_time", "rcv_jktime", "send_time"]
    for start, end in (("00:00:00", "10:00:08"), ("10:00:08", "10:00:09"), ("10:00:09", "23:00:00")):
        whole = by_id.s_by_id_in_range(s, at(start), at(end)).select(columns)
        assert sorted(by_id.s_first_in_range(s, at(start), at(end)).collect()) == sorted(whole.collect())

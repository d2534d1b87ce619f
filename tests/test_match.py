"""Windows and matches against plain nested loops, under both plans."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import P_ALARMS, S_ALARMS, WAVES, at, make_key, make_p, make_s
from tremorgrade import Evaluation, Sizing
from tremorgrade.operators.sizing import profile_key
from tremorgrade.operators.windows import add_windows, extend_windows
from tremorgrade.schema import ANSWER_KEY_SCHEMA

PLANS = {"broadcast": Sizing(), "shuffled": Sizing(broadcast_waves=0)}


@pytest.fixture(params=PLANS)
def sizing(request):
    return PLANS[request.param]


def hand_made(spark, sizing=Sizing()):
    return Evaluation(
        make_key(spark, WAVES), make_p(spark, P_ALARMS), make_s(spark, S_ALARMS), sizing
    )


def by_wave(rows):
    return {row.id: row for row in rows.collect()}


def test_hand_made_windows(spark, sizing):
    windows = by_wave(hand_made(spark, sizing).windows)
    assert [windows[i].next_send_time for i in (1, 2, 3)] == [
        at("10:02:00"), at("10:04:00"), at("10:05:00"),
    ]


def test_hand_made_p_matches(spark, sizing):
    matched = by_wave(hand_made(spark, sizing).p_matched())
    # b ties with a and loses by id; c lies on the end of window 1 and opens window 2.
    assert [matched[i].sta_code for i in (1, 2, 3)] == ["S1", "S3", None]
    assert [matched[i].first_jk_time for i in (1, 2, 3)] == [at("10:00:06"), at("10:02:00"), None]


def test_hand_made_p_measures(spark, sizing):
    compared = by_wave(hand_made(spark, sizing).p_compare())
    first = compared[1]
    assert str(first.p_send_time) == "0.100"
    assert str(first.p_wave_judge_time) == "1.100"
    assert str(first.p_wave_judge_time_sta) == "1.000"
    assert str(first.magnitude_diff) == "0.50"
    assert str(first.azi_angle_diff) == "340.000"  # no wrap at 360
    assert str(first.epi_dist_diff) == "2.001"  # from the value rounded to 52.001
    assert float(first.epicenter_deviation_km) == pytest.approx(96.297, abs=1e-3)
    assert first.p_warning_miss is None
    assert str(compared[2].p_wave_judge_time_sta) == "-5.000"
    assert compared[3].p_warning_miss == "1"
    assert compared[3].p_send_time is None


def test_hand_made_s_matches(spark, sizing):
    matched = by_wave(hand_made(spark, sizing).s_matched())
    assert list(matched) == [1]  # 39.999 and unknown peaks are out
    row = matched[1]
    assert (row.first_jk_time, row.gal80_jk_time, row.gal120_jk_time) == (
        at("10:00:08"), at("10:00:09"), at("10:00:10"),
    )
    assert row.gal120_rcv_jktime == at("10:00:10.050")
    assert str(row.wave_peak) == "120.000"


def test_hand_made_s_measures(spark, sizing):
    row = by_wave(hand_made(spark, sizing).s_compare())[1]
    assert str(row.peak_deviation) == "20.000"
    assert str(row.peak_deviation_percent) == "20.00"
    assert str(row.s_send_time) == "0.100"
    assert str(row.gal120_send_time) == "0.050"
    assert str(row.gal120_judge_time_station) == "0.400"  # against the third report
    assert str(row.swave_judge_time) == "0.100"


def test_weak_wave_sharing_a_window_has_no_s_alarm(spark, sizing):
    t = at("10:00:00")
    waves = [
        {"id": 1, "send_time": t, "actual_peak": 100.0},
        {"id": 2, "send_time": t, "actual_peak": 10.0},
        {"id": 3, "send_time": t, "actual_peak": 100.0},
    ]
    alarm = [{"station_s_wave_alarm_id": "x", "jk_time": t, "rcv_jktime": t, "x_acc_value": 90.0}]
    run = Evaluation(make_key(spark, waves), make_p(spark, []), make_s(spark, alarm), sizing)
    rows = by_wave(run.details())
    assert [rows[i].wave_peak is not None for i in (1, 2, 3)] == [True, False, True]
    assert rows[2].s_warning_miss is None


def test_no_alarms_and_no_waves(spark, sizing):
    run = Evaluation(make_key(spark, WAVES), make_p(spark, []), make_s(spark, []), sizing)
    assert [r.p_warning_miss for r in run.p_compare().collect()] == ["1"] * 3
    assert run.details().count() == 3
    empty = Evaluation(make_key(spark, []), make_p(spark, P_ALARMS), make_s(spark, S_ALARMS), sizing)
    assert empty.p_matched().count() == 0
    assert empty.s_compare().count() == 0


def test_last_window_that_ends_before_it_starts_matches_nothing(spark, sizing):
    waves = [{"id": 1, "send_time": at("10:00:00"), "end_time": at("09:00:00")}]
    alarms = [{"station_p_wave_alarm_id": "a", "jk_time": at(c)} for c in ("09:30:00", "10:00:00")]
    run = Evaluation(make_key(spark, waves), make_p(spark, alarms), make_s(spark, []), sizing)
    assert run.p_matched().first().first_jk_time is None


def test_value_that_is_not_a_number_counts_as_above_every_level(spark, sizing):
    alarm = [{"station_s_wave_alarm_id": "n", "jk_time": at("10:00:01"),
              "rcv_jktime": at("10:00:01"), "x_acc_value": float("nan")}]
    run = Evaluation(make_key(spark, WAVES), make_p(spark, []), make_s(spark, alarm), sizing)
    row = run.s_matched().first()
    assert row.gal120_jk_time == at("10:00:01")
    assert row.wave_peak is None  # no decimal holds it


def random_case(seed):
    """Waves with ties, crowded spells, year-long gaps and times before 1970."""
    rng = random.Random(seed)
    clock = datetime(1969, 12, 31, 23, 59, 50)
    steps = [timedelta(0), timedelta(microseconds=1), timedelta(milliseconds=7), timedelta(seconds=1),
             timedelta(seconds=17), timedelta(minutes=1), timedelta(hours=5), timedelta(days=400)]
    waves = []
    for number in rng.sample(range(1000), 60):
        waves.append({"id": number, "send_time": clock, "actual_peak": rng.choice([10.0, 40.0, 100.0, None])})
        clock += rng.choice(steps)
    instants = [w["send_time"] for w in waves]

    def alarms(prefix, extra):
        rows = []
        for i in range(200):
            near = rng.choice(instants) + rng.choice([-1, 0, 0, 1]) * rng.choice(steps)
            # A third of the log falls on one instant.
            sent = instants[7] if i % 3 == 0 else rng.choice([near, near, near, None])
            received = sent and sent + timedelta(milliseconds=rng.randrange(300))
            rows.append({f"station_{prefix}_wave_alarm_id": f"{rng.randrange(10**6)}-{i}",
                         "jk_time": sent, "rcv_jktime": received, "sta_code": f"S{i}", **extra(rng)})
        return rows

    p = alarms("p", lambda r: {"earthquake_level": r.uniform(3, 8)})
    s = alarms("s", lambda r: {"x_acc_value": r.choice([10.0, 79.999, 80.0, 119.5, 120.0, 300.0, None])})
    rng.shuffle(waves)
    return waves, p, s


def looped_windows(waves):
    order = sorted(waves, key=lambda w: (w["send_time"], w["id"]))
    ends = [w["send_time"] for w in order[1:]] + [order[-1]["send_time"] + timedelta(seconds=60)]
    return {w["id"]: (w["send_time"], end) for w, end in zip(order, ends)}


def looped_first(window, alarms, alarm_id, level=None):
    inside = [
        a for a in alarms
        if a["jk_time"] is not None and window[0] <= a["jk_time"] <= window[1]
        and (level is None or (a["x_acc_value"] is not None and a["x_acc_value"] >= level))
    ]
    return min(inside, key=lambda a: (a["jk_time"], a[alarm_id]), default=None)


@pytest.mark.parametrize("seed", range(4))
def test_random_cases_equal_nested_loops(spark, sizing, seed):
    waves, p, s = random_case(seed)
    windows = looped_windows(waves)
    run = Evaluation(
        make_key(spark, waves),
        make_p(spark, p).repartition(1 + seed),
        make_s(spark, s).repartition(3),
        sizing,
    )
    found = {r.id: (r.send_time, r.next_send_time) for r in run.windows.collect()}
    assert found == windows

    p_rows = run.p_matched().collect()
    assert sorted(r.id for r in p_rows) == sorted(windows)
    for row in p_rows:
        want = looped_first(windows[row.id], p, "station_p_wave_alarm_id")
        got = (row.first_jk_time, row.first_rcv_jktime, row.sta_code)
        assert got == ((want["jk_time"], want["rcv_jktime"], want["sta_code"]) if want else (None,) * 3)

    s_rows = run.s_matched().collect()
    assert sorted(r.id for r in s_rows) == sorted(w["id"] for w in waves if (w["actual_peak"] or 0) >= 40)
    for row in s_rows:
        window = windows[row.id]
        for name, level in (("first", None), ("gal80", 80), ("gal120", 120)):
            want = looped_first(window, s, "station_s_wave_alarm_id", level)
            got = (row[f"{name}_jk_time"], row[f"{name}_rcv_jktime"])
            assert got == ((want["jk_time"], want["rcv_jktime"]) if want else (None, None))
        inside = [a["x_acc_value"] for a in s if a["jk_time"] and a["x_acc_value"] is not None
                  and window[0] <= a["jk_time"] <= window[1]]
        assert (row.wave_peak is None) == (not inside)
        if inside:
            assert float(row.wave_peak) == max(inside)


def test_repeated_ids_and_odd_names_give_the_same_windows_under_both_plans(spark, sizing):
    rows = [(5, "10:00:00"), (5, "10:00:00"), (6, "10:05:00"), (4, "10:00:00")]
    key = make_key(spark, [{"id": i, "send_time": at(t)} for i, t in rows])
    key = key.withColumn("note (km)", key.id)
    none = make_p(spark, []), make_s(spark, [])
    found = Evaluation(key, *none, sizing).windows
    ends = sorted((r.id, r.next_send_time) for r in found.select("id", "next_send_time").collect())
    assert ends == [(4, at("10:00:00")), (5, at("10:05:00")), (5, at("10:05:00")), (6, at("10:06:00"))]


def test_far_alarm_is_averaged(spark, sizing):
    key = make_key(spark, [{"id": 1, "send_time": at("10:00:00")}])
    p = make_p(spark, [{"station_p_wave_alarm_id": "a", "jk_time": at("10:00:01"), "rcv_jktime": datetime(9999, 12, 31)}])
    row = Evaluation(key, p, make_s(spark, []), sizing).kpi("kpi_p_send").first()
    assert any("2516" in str(v) for v in row.asDict().values())


def test_extended_windows_equal_the_whole_computation(spark):
    """Waves appended at any time: only their days and the ones before are computed again."""
    draw = random.Random(12)
    for _ in range(6):
        waves = [
            {"id": i, "send_time": None if draw.random() < 0.05 else at("00:00:00") + timedelta(
                days=draw.choice([0, 0, 1, 4, 5, 9]), seconds=draw.randint(0, 5))}
            for i in range(1, 41)
        ]
        ends = [{**w, "end_time": (w["send_time"] or at("00:00:00")) + timedelta(minutes=1)} for w in waves]
        key = _frame_of(spark, ends)
        split = draw.randint(0, 40)
        old, new = key.where(f"id <= {split}"), key.where(f"id > {split}")
        before = add_windows(old, profile_key(old))
        extended = extend_windows(before, new)
        whole = add_windows(key, profile_key(key))
        assert extended.columns == whole.columns
        assert sorted(map(repr, extended.collect())) == sorted(map(repr, whole.collect()))


def _frame_of(spark, rows):
    defaults = {
        "test_id": 1, "waveform_id": "W", "station_name": "ST", "station_manager": "M",
        "start_time": at("00:00:00"), "duration": 60.0, "earthquake_type": "quake",
    }
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in ANSWER_KEY_SCHEMA])
    return spark.createDataFrame([tuple({**defaults, **r}.get(n) for n in schema.names) for r in rows], schema)


def test_days_without_new_waves_are_not_computed_again(spark):
    key = make_key(spark, [
        {"id": i, "send_time": at("10:00:00") + timedelta(days=i)} for i in range(1, 10)
    ])
    old, new = key.where("id <= 8"), key.where("id = 9")
    before = add_windows(old, profile_key(old)).withColumn(
        "next_send_time", F.expr("CASE WHEN id < 8 THEN TIMESTAMP_NTZ '1999-01-01' ELSE next_send_time END"))
    found = {r.id: r.next_send_time.year for r in extend_windows(before, new).collect()}
    assert found == {**{i: 1999 for i in range(1, 8)}, 8: 2024, 9: 2024}

"""Waves with the alarms matched to them and the measures taken per wave.

A graded frame has one row per wave: the answer key, the matched alarm columns
and the measures. Every per-wave table is a projection of it, so no table is
joined back to another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrade.functions import haversine_km, rounded, seconds_between
from tremorgrade.operators.match import WINDOW, First, match_windows
from tremorgrade.operators.sizing import KeyProfile, attach
from tremorgrade.schema import P_ALARM_ID, S_ALARM_ID
from tremorgrade.session import computed_once

# A wave counts for S alarms from this true peak (gal) on, and
# these are the alarm levels (gal).
S_PEAK_FLOOR = 40
S_LEVELS = {"gal80": 80, "gal120": 120}

_ELIGIBLE = f"actual_peak >= {S_PEAK_FLOOR}"

_P_VALUES = ("source_longitude", "source_latitude", "epi_dist", "azi_angle", "earthquake_level")

P_MATCHED = [
    "id", *WINDOW, "p_first_jk_time", "p_first_rcv_jktime", "p_sta_code", "p_device_code", *_P_VALUES,
]
P_COMPARED = [
    "id", "send_time", "next_send_time", "p_warning_miss", "magnitude_diff",
    "epicenter_deviation_km", "p_wave_judge_time", "p_wave_judge_time_sta", "epi_dist_diff",
    "azi_angle_diff", "p_send_time",
]
S_MATCHED = [
    "id", *WINDOW, "s_first_jk_time", "s_first_rcv_jktime", "gal80_jk_time", "gal80_rcv_jktime",
    "gal120_jk_time", "gal120_rcv_jktime", "s_sta_code", "s_device_code", "wave_peak",
]
S_COMPARED = [
    "id", "send_time", "next_send_time", "s_warning_miss", "swave_judge_time",
    "swave_judge_time_station", "gal80_judge_time", "gal80_judge_time_station",
    "gal120_judge_time", "gal120_judge_time_station", "peak_deviation",
    "peak_deviation_percent", "s_send_time", "gal80_send_time", "gal120_send_time",
]


def s_eligible(windows: DataFrame) -> DataFrame:
    """Waves strong enough to be graded for S alarms; unknown peaks are out."""
    return windows.where(_ELIGIBLE)


def grade_p(windows: DataFrame, p_alarms: DataFrame, profile: KeyProfile) -> DataFrame:
    """Add the first P alarm of each wave's window and the eight P measures."""
    firsts = [First("first", ("rcv_jktime", "sta_code", "device_code", *_P_VALUES))]
    matched = match_windows(windows, p_alarms, P_ALARM_ID, firsts, profile)
    picked = matched.selectExpr(
        *WINDOW,
        "first.jk_time AS p_first_jk_time",
        "first.rcv_jktime AS p_first_rcv_jktime",
        "first.sta_code AS p_sta_code",
        "first.device_code AS p_device_code",
        *_named({name: rounded(f"first.{name}", 3) for name in _P_VALUES}),
    )
    return attach(windows, _lookup(picked, profile), WINDOW, profile).selectExpr("*", *_p_measures())


def grade_s(
    windows: DataFrame,
    s_alarms: DataFrame,
    profile: KeyProfile,
    onto: DataFrame | None = None,
) -> DataFrame:
    """Add the first, first-over-level and peak S alarm and the twelve S measures.

    Waves below the peak floor keep null S columns; ``s_eligible`` marks the rest.
    ``onto`` is the frame to extend, if not ``windows`` itself: matching from the
    windows alone keeps a P match already in the frame out of the S match.
    """
    waves = windows if onto is None else onto
    firsts = [
        First("first", ("rcv_jktime", "sta_code", "device_code")),
        *[First(name, ("rcv_jktime",), level) for name, level in S_LEVELS.items()],
    ]
    matched = match_windows(
        s_eligible(windows), s_alarms, S_ALARM_ID, firsts, profile, value="x_acc_value"
    )
    alarm = {
        "s_first_jk_time": "first.jk_time",
        "s_first_rcv_jktime": "first.rcv_jktime",
        "gal80_jk_time": "gal80.jk_time",
        "gal80_rcv_jktime": "gal80.rcv_jktime",
        "gal120_jk_time": "gal120.jk_time",
        "gal120_rcv_jktime": "gal120.rcv_jktime",
        "s_sta_code": "first.sta_code",
        "s_device_code": "first.device_code",
        "wave_peak": rounded("peak", 3),
    }
    picked = matched.selectExpr(*WINDOW, *_named(alarm))
    # A weak wave may share its window with a strong one: it still has no S alarm.
    own = {name: f"CASE WHEN s_eligible THEN {name} END" for name in alarm}
    return (
        attach(waves, _lookup(picked, profile), WINDOW, profile)
        .withColumn("s_eligible", F.expr(f"coalesce({_ELIGIBLE}, false)"))
        .selectExpr(*waves.columns, "s_eligible", *_named(own))
        .selectExpr("*", *_s_measures())
    )


def _lookup(picked: DataFrame, profile: KeyProfile) -> DataFrame:
    """Matched values as ``attach`` wants them: stored, unless they are broadcast."""
    return picked if profile.small else computed_once(picked)


def _p_measures() -> list[str]:
    measures = {
        "p_warning_miss": _miss_flag("p_first_jk_time"),
        "magnitude_diff": rounded(_distance("earthquake_level", "actual_magnitude"), 2),
        "epicenter_deviation_km": rounded(
            haversine_km(
                "CAST(source_latitude AS DOUBLE)", "CAST(source_longitude AS DOUBLE)",
                "actual_latitude", "actual_longitude",
            ),
            3,
        ),
        "p_wave_judge_time": seconds_between("p_first_rcv_jktime", "p_wave_time"),
        "p_wave_judge_time_sta": seconds_between("p_first_jk_time", "p_wave_time"),
        "epi_dist_diff": rounded(_distance("epi_dist", "actual_distance"), 3),
        "azi_angle_diff": rounded(_distance("azi_angle", "azimuth"), 3),
        "p_send_time": seconds_between("p_first_rcv_jktime", "p_first_jk_time"),
    }
    return _named(measures)


def _s_measures() -> list[str]:
    deviation = _distance("wave_peak", "actual_peak")
    share = f"try_cast({deviation} / nullif(actual_peak, 0) AS DECIMAL(30,12))"
    measures = {"s_warning_miss": f"CASE WHEN s_eligible THEN {_miss_flag('s_first_jk_time')} END"}
    # Judge time: from the true onset to the alarm, at the centre and the station.
    for name, alarm, truth in (
        ("swave", "s_first", "s_wave_first_time"),
        ("gal80", "gal80", "s_wave_second_time"),
        ("gal120", "gal120", "s_wave_third_time"),
    ):
        measures[f"{name}_judge_time"] = seconds_between(f"{alarm}_rcv_jktime", truth)
        measures[f"{name}_judge_time_station"] = seconds_between(f"{alarm}_jk_time", truth)
    measures["peak_deviation"] = rounded(deviation, 3)
    measures["peak_deviation_percent"] = f"round({share} * 100, 2)"
    measures["s_send_time"] = seconds_between("s_first_rcv_jktime", "s_first_jk_time")
    for name in S_LEVELS:
        measures[f"{name}_send_time"] = seconds_between(f"{name}_rcv_jktime", f"{name}_jk_time")
    return _named(measures)


def _named(expressions: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in expressions.items()]


def _miss_flag(alarm_time: str) -> str:
    return f"CASE WHEN {alarm_time} IS NULL THEN '1' END"


def _distance(reported: str, true: str) -> str:
    """Difference of a reported (already rounded) and a true value, as a double."""
    return f"abs(CAST({reported} AS DOUBLE) - {true})"


def p_matched(graded: DataFrame) -> DataFrame:
    return _plain_names(graded.select(P_MATCHED), "p_")


def p_compare(graded: DataFrame) -> DataFrame:
    return graded.select(P_COMPARED)


def s_matched(graded: DataFrame) -> DataFrame:
    return _plain_names(graded.where("s_eligible").select(S_MATCHED), "s_")


def s_compare(graded: DataFrame) -> DataFrame:
    return graded.where("s_eligible").select(S_COMPARED)


def _plain_names(matched: DataFrame, prefix: str) -> DataFrame:
    names = ["first_jk_time", "first_rcv_jktime", "sta_code", "device_code"]
    return matched.withColumnsRenamed({prefix + n: n for n in names})

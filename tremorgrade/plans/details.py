"""The wide report: one row per wave, truth next to alarms and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The report's columns in order.
DETAIL_COLUMNS = [
    "test_id", "waveform_id", "send_time", "end_time", "station_name", "earthquake_type",
    "s_warning_miss", "p_warning_miss",
    "actual_magnitude", "earthquake_level", "magnitude_diff",
    "actual_longitude", "actual_latitude", "source_longitude", "source_latitude",
    "epicenter_deviation_km",
    "p_wave_judge_time", "p_wave_judge_time_sta", "p_wave_time", "p_first_rcv_jktime",
    "actual_peak", "wave_peak", "peak_deviation", "peak_deviation_percent",
    "swave_judge_time", "swave_judge_time_station",
    "actual_distance", "epi_dist", "epi_dist_diff",
    "azimuth", "azi_angle", "azi_angle_diff",
    "gal80_judge_time", "gal80_judge_time_station",
    "gal120_judge_time", "gal120_judge_time_station",
    "p_send_time", "s_send_time", "gal80_send_time", "gal120_send_time",
]

# Fixed value: marks a P alarm that came after the S alarm.
S_BEFORE_P = "xs_hp"


def details(graded: DataFrame) -> DataFrame:
    """Report on a frame graded for P and S. Sorting is left to the sink."""
    flag = (
        f"CASE WHEN p_first_jk_time > s_first_jk_time THEN '{S_BEFORE_P}'"
        " ELSE p_warning_miss END AS p_warning_miss"
    )
    return graded.selectExpr("id", *[flag if c == "p_warning_miss" else c for c in DETAIL_COLUMNS])

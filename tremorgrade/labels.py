"""Report labels. Tables use English names inside; these turn them into the
Chinese ones the graded system's operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tremorgrade.plans.kpi import KPIS, TIMED_KPIS

_ITEMS = {kpi.name: kpi.item for kpi in (*KPIS, *TIMED_KPIS)}

# Verdicts.
VERDICTS_ZH = {"yes": "是", "no": "否"}

# KPI items.
ITEMS_ZH = {
    "P alarm transmission time ≤0.1s": "P波预警传输时间统计≤0.1s",
    "P alarm epicentre deviation": "P波预警震中位置偏差",
    "P alarm judge time at the station ≤3s": "台站首报P波预警判别时间≤3秒",
    "P alarm magnitude deviation ≤1": "P波预警震级偏差≤1",
    "P alarms missed": "P波预警漏报",
    "S alarm before P alarm": "先报警后预警",
    "S alarm transmission time ≤0.1s (40gal)": "阈值报警传输时延≤0.1s(40gal)",
    "S alarm transmission time ≤0.1s (80gal)": "阈值报警传输时延≤0.1s(80gal)",
    "S alarm transmission time ≤0.1s (120gal)": "阈值报警传输时延≤0.1s(120gal)",
    "S alarms missed": "S波预警漏报",
    "S alarm peak deviation ≤5%": "阈值报警最大偏差≤5%",
    "S alarm judge time ≤0.5s (40gal)": "阈值报警判别时延≤0.5s(40gal)",
    "S alarm judge time ≤0.5s (80gal)": "阈值报警判别时延≤0.5s(80gal)",
    "S alarm judge time ≤0.5s (120gal)": "阈值报警判别时延≤0.5s(120gal)",
}

# KPI columns.
KPI_COLUMNS_ZH = {
    "item": "项目",
    "total": "总数",
    "pass_count": "合格数",
    "pass_rate": "合格率",
    "standard": "标准",
    "verdict": "是否达标",
    "max_value": "最大值",
    "min_value": "最小值",
    "avg_value": "平均值",
    "within_60km_count": "偏差≤60km组数",
    "within_60km_rate": "偏差≤60km占比",
    "within_60km_standard": "偏差≤60km占比标准",
    "within_60km_verdict": "是否达标(60km)",
    "within_100km_count": "偏差≤100km组数",
    "within_100km_rate": "偏差≤100km占比",
    "within_100km_standard": "偏差≤100km占比标准",
    "within_100km_verdict": "是否达标(100km)",
    "max_within_300km": "最大值不超过300km",
    "miss_count": "漏报数",
    "miss_rate": "漏报率",
    "s_before_p_count": "先报警后预警数量",
    "max_deviation": "最大偏差",
}

# Two tables name their extremes differently.
KPI_COLUMN_EXCEPTIONS_ZH = {
    "P波预警震中位置偏差": {"max_value": "偏差最大值"},
    "P波预警震级偏差≤1": {"avg_value": "偏差平均值"},
}

# Columns of the detail report, in order.
DETAIL_COLUMNS_ZH = {
    "test_id": "实验编号",
    "waveform_id": "波形编号",
    "send_time": "波形发送时间",
    "end_time": "波形结束时间",
    "station_name": "台站编码",
    "earthquake_type": "波形类型",
    "s_warning_miss": "漏报S波",
    "p_warning_miss": "漏报P波",
    "actual_magnitude": "实际震级",
    "earthquake_level": "首报震级",
    "magnitude_diff": "震级偏差",
    "actual_longitude": "实际经度",
    "actual_latitude": "实际纬度",
    "source_longitude": "首报经度",
    "source_latitude": "首报纬度",
    "epicenter_deviation_km": "震中偏差(km)",
    "p_wave_judge_time": "P波预警判别时间(s)",
    "p_wave_judge_time_sta": "P波判别预警时间-台站(s)",
    "p_wave_time": "实际P波初至时间",
    "p_first_rcv_jktime": "P波报警时间",
    "actual_peak": "实际峰值(gal)",
    "wave_peak": "首报峰值(gal)",
    "peak_deviation": "峰值偏差(gal)",
    "peak_deviation_percent": "峰值偏差百分比",
    "swave_judge_time": "阈值报警判别时间(s)",
    "swave_judge_time_station": "阈值判别时间-台站(s)",
    "actual_distance": "实际震中距(km)",
    "epi_dist": "首报震中距(km)",
    "epi_dist_diff": "震中距偏差(km)",
    "azimuth": "实际方位角",
    "azi_angle": "首报方位角",
    "azi_angle_diff": "方位角偏差",
    "gal80_judge_time": "80gal阈值报警判别时间(s)",
    "gal80_judge_time_station": "80gal阈值报警判别时间-台站(s)",
    "gal120_judge_time": "120gal阈值报警判别时间(s)",
    "gal120_judge_time_station": "120gal阈值报警判别时间-台站(s)",
    "p_send_time": "P波预警首报传输时间(s)",
    "s_send_time": "阈值报警首报传输时间(s)",
    "gal80_send_time": "80gal阈值报警传输时间(s)",
    "gal120_send_time": "120gal阈值报警传输时间(s)",
}


def in_chinese(name: str, rows: DataFrame) -> DataFrame:
    """The table of this name as its readers know it; tables that are no report stay."""
    if name == "details":
        return details_zh(rows)
    if name in _ITEMS:
        return kpi_zh(rows, _ITEMS[name])
    return rows


def details_zh(details: DataFrame) -> DataFrame:
    """The detail report under its Chinese column names."""
    return details.withColumnsRenamed(DETAIL_COLUMNS_ZH)


def kpi_zh(row: DataFrame, item: str) -> DataFrame:
    """One KPI table in Chinese: column names, item text and verdicts.

    ``item`` is the English item text of that KPI.
    """
    item_zh = ITEMS_ZH[item]
    names = KPI_COLUMNS_ZH | KPI_COLUMN_EXCEPTIONS_ZH.get(item_zh, {})
    verdict = " ".join(f"WHEN '{en}' THEN '{zh}'" for en, zh in VERDICTS_ZH.items())
    columns = []
    for name in row.columns:
        value = name
        if name == "item":
            value = f"'{item_zh}'"
        elif name.endswith("verdict") or name == "max_within_300km":
            value = f"CASE {name} {verdict} ELSE {name} END"
        columns.append(f"{value} AS `{names[name]}`")
    return row.selectExpr(*columns)

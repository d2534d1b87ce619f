import pytest

from conftest import P_ALARMS, S_ALARMS, WAVES, at, make_key, make_p, make_s
from tremorgrade import Evaluation, timed_kpi
from tremorgrade.labels import ITEMS_ZH, kpi_zh
from tremorgrade.plans.kpi import KPIS, TIMED_KPIS, run_kpi

BY_NAME = {k.name: k for k in (*KPIS, *TIMED_KPIS)}


@pytest.fixture(scope="module")
def run(spark):
    return Evaluation(make_key(spark, WAVES), make_p(spark, P_ALARMS), make_s(spark, S_ALARMS))


def texts(frame):
    (row,) = frame.collect()
    return {k: v if v is None else str(v) for k, v in row.asDict().items() if k != "item"}


EXPECTED = {
    "kpi_p_send": {"total": "3", "pass_count": "1", "pass_rate": "33.33%", "standard": "≥95%",
                   "verdict": "no", "max_value": "0.200", "min_value": "0.100", "avg_value": "0.150"},
    "kpi_p_judge": {"total": "3", "pass_count": "2", "pass_rate": "66.67%", "standard": "≥90%",
                    "verdict": "no", "avg_value": "-2.000"},
    "kpi_p_magnitude": {"total": "3", "pass_count": "2", "pass_rate": "66.67%", "standard": "≥95%",
                        "verdict": "yes", "avg_value": "0.250"},
    "kpi_p_miss": {"total": "3", "miss_count": "1", "miss_rate": "33.33%", "standard": "≤5%", "verdict": "no"},
    "kpi_p_epicenter": {
        "total": "3", "within_60km_count": "0", "within_60km_rate": "0.00%", "within_60km_standard": "≥60%",
        "within_60km_verdict": "no", "within_100km_count": "1", "within_100km_rate": "33.33%",
        "within_100km_standard": "≥80%", "within_100km_verdict": "no", "max_value": "96.297",
        "max_within_300km": "yes"},
    "kpi_s_before_p": {"s_before_p_count": "0"},
    "kpi_s40_send": {"total": "1", "pass_count": "0", "pass_rate": "0.00%", "standard": "95%",
                     "verdict": "no", "avg_value": "0.100", "max_value": "0.100", "min_value": "0.100"},
    # The 80 gal delay of exactly 0.1 s passes but is not in the rate.
    "kpi_s80_send": {"total": "1", "pass_count": "1", "pass_rate": "0.00%", "standard": "95%",
                     "verdict": "yes", "avg_value": "0.100", "max_value": "0.100", "min_value": "0.100"},
    "kpi_s120_send": {"total": "1", "pass_count": "1", "pass_rate": "100.00%", "standard": "95%",
                      "verdict": "yes", "avg_value": "0.050", "max_value": "0.050", "min_value": "0.050"},
    "kpi_s_miss": {"total": "1", "miss_count": "0", "miss_rate": "0.00%", "standard": "≤0%", "verdict": "yes"},
    "kpi_s_peak": {"total": "1", "pass_count": "0", "pass_rate": "0.00%", "standard": "≥95%",
                   "verdict": "no", "max_deviation": "20.00%"},
    "kpi_s40_judge": {"total": "1", "pass_count": "1", "pass_rate": "100.00%", "standard": "≥70%",
                      "verdict": "yes", "avg_value": "0.000", "max_value": "0.000", "min_value": "0.000"},
    "kpi_s80_judge": {"total": "1", "pass_count": "1", "pass_rate": "100.00%", "standard": "≥70%",
                      "verdict": "yes", "avg_value": "0.000", "max_value": "0.000", "min_value": "0.000"},
    "kpi_s120_judge": {"total": "1", "pass_count": "1", "pass_rate": "100.00%", "standard": "≥70%",
                       "verdict": "yes", "avg_value": "0.400", "max_value": "0.400", "min_value": "0.400"},
}


@pytest.mark.parametrize("name", [k.name for k in KPIS])
def test_hand_made_kpi(run, name):
    assert texts(run.kpi(name)) == EXPECTED[name]


def test_scorecard_holds_every_field_of_every_kpi(run):
    long = {}
    for row in run.scorecard().collect():
        if row.field != "item":
            long.setdefault(row.kpi, {})[row.field] = row.value
    assert long == EXPECTED


def test_kpis_without_waves(spark):
    run = Evaluation(make_key(spark, []), make_p(spark, []), make_s(spark, []))
    for kpi in KPIS:
        row = texts(run.kpi(kpi.name))
        if kpi.name == "kpi_s_before_p":
            assert row == {"s_before_p_count": "0"}
            continue
        assert row["total"] == "0"
        for name, value in row.items():
            if name.endswith("rate"):
                assert value == "NAN%"
            elif name.endswith(("verdict", "value", "deviation")):
                assert value is None
        if kpi.name == "kpi_p_epicenter":
            assert row["within_60km_count"] is None and row["within_100km_count"] is None
            assert row["max_within_300km"] == "no"
        elif "pass_count" in row:
            assert row["pass_count"] == "0"


@pytest.mark.parametrize("name", [k.name for k in TIMED_KPIS])
def test_timed_kpis_over_an_empty_range(spark, name):
    row = texts(timed_kpi(name, make_p(spark, P_ALARMS), make_s(spark, S_ALARMS),
                          "2020-01-01 00:00:00", "2020-01-02 00:00:00"))
    assert (row["total"], row["pass_rate"], row["verdict"]) == ("0", "NaN%", "NULL")


def test_timed_kpi(spark):
    row = texts(timed_kpi("tkpi_p_send", make_p(spark, P_ALARMS), make_s(spark, S_ALARMS),
                          at("10:00:06"), at("10:02:00")))
    assert row == {"total": "2", "pass_count": "1", "pass_rate": "50.00%", "standard": "≥95%",
                   "verdict": "no", "max_value": "0.200", "min_value": "0.100", "avg_value": "0.150"}


@pytest.mark.parametrize(
    ("passed", "total", "verdict"), [(95, 100, "yes"), (94, 100, "no"), (949_999, 1_000_000, "no")]
)
def test_ratio_verdict_is_not_taken_from_the_rounded_rate(spark, passed, total, verdict):
    frame = spark.range(total).selectExpr(
        f"CAST(CASE WHEN id < {passed} THEN 0.1 ELSE 0.2 END AS DECIMAL(18,3)) AS p_send_time"
    )
    assert texts(run_kpi(frame, BY_NAME["kpi_p_send"]))["verdict"] == verdict


def test_magnitude_verdict_is_taken_from_the_rounded_rate(spark):
    # 49.995 percent shows as 50.00 and passes.
    frame = spark.range(20_000).selectExpr(
        "CAST(CASE WHEN id < 9999 THEN 1 ELSE 2 END AS DECIMAL(22,2)) AS magnitude_diff"
    )
    row = texts(run_kpi(frame, BY_NAME["kpi_p_magnitude"]))
    assert (row["pass_rate"], row["verdict"]) == ("50.00%", "yes")


def test_chinese_labels(run):
    assert {k.item for k in (*KPIS, *TIMED_KPIS)} == set(ITEMS_ZH)
    for kpi in KPIS:
        row = kpi_zh(run.kpi(kpi.name), kpi.item).first()
        assert row["项目"] == ITEMS_ZH[kpi.item]
    row = kpi_zh(run.kpi("kpi_p_epicenter"), BY_NAME["kpi_p_epicenter"].item).first()
    assert row["是否达标(60km)"] == "否" and row["最大值不超过300km"] == "是" and "偏差最大值" in row

from datetime import datetime
from decimal import Decimal

import pytest

from tremorgrade.functions import haversine_km, hundredths, micros, percent_text, rounded, seconds_between


def value(spark, sql):
    return spark.sql(f"SELECT {sql} AS x").first().x


@pytest.mark.parametrize(
    ("sql", "places", "expected"),
    [
        ("2.675D - 1.0D", 2, "1.68"),
        ("-0.0005D", 3, "-0.001"),
        ("0.0005D", 3, "0.001"),
        ("39.9994999D", 3, "39.999"),
        ("1e20D", 3, None),
        ("CAST('NaN' AS DOUBLE)", 3, None),
        ("CAST(NULL AS DOUBLE)", 3, None),
    ],
)
def test_rounded(spark, sql, places, expected):
    assert value(spark, rounded(sql, places)) == (Decimal(expected) if expected else None)


def test_seconds_between_is_exact_and_signed(spark):
    late, early = "TIMESTAMP_NTZ '2024-01-01 00:00:01.100500'", "TIMESTAMP_NTZ '2024-01-01 00:00:01'"
    assert value(spark, seconds_between(late, early)) == Decimal("0.101")
    assert value(spark, seconds_between(early, late)) == Decimal("-0.101")
    assert value(spark, seconds_between("CAST(NULL AS TIMESTAMP_NTZ)", early)) is None


def test_haversine_known_distances(spark):
    assert value(spark, haversine_km("0D", "0D", "0D", "90D")) == pytest.approx(10007.543, abs=1e-3)
    assert value(spark, haversine_km("10D", "20D", "10D", "20D")) == 0
    assert value(spark, haversine_km("10D", "20D", "CAST(NULL AS DOUBLE)", "20D")) is None
    # Opposite points: noise must not push the arc sine out of range.
    assert value(spark, haversine_km("45D", "10D", "-45D", "-170D")) == pytest.approx(20015.087, abs=1e-2)


@pytest.mark.parametrize(
    ("part", "whole", "text"),
    [(2, 3, "66.67%"), (1, 1, "100.00%"), (0, 7, "0.00%"), (1, 8, "12.50%"), (1, 20000, "0.01%"),
     (1, 20001, "0.00%"), (0, 0, None), (99_999_999_999, 100_000_000_000, "100.00%")],
)
def test_percent_text(spark, part, whole, text):
    assert value(spark, percent_text(hundredths(f"{part}L", f"{whole}L"))) == text


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Shanghai"])
@pytest.mark.parametrize("text", ["2024-03-10 02:30:00.000001", "1969-12-31 23:59:59.5", "1899-01-01 00:00:00"])
def test_micros_does_not_depend_on_the_session_zone(spark, zone, text):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = value(spark, micros(f"TIMESTAMP_NTZ '{text}'"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    delta = datetime.fromisoformat(text) - datetime(1970, 1, 1)
    assert found == (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds

import os
import sys
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tremorgrade.schema import ANSWER_KEY_SCHEMA, P_ALARM_SCHEMA, S_ALARM_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.debug.maxToStringFields", "1000")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tremorgrade-test-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True, scope="module")
def no_cached_tables(spark):
    yield
    spark.catalog.clearCache()


def at(clock: str) -> datetime | None:
    """A time on 2024-01-01, e.g. ``10:00:06.100``."""
    return datetime.fromisoformat(f"2024-01-01 {clock}") if clock else None


def _frame(spark, schema, rows):
    return spark.createDataFrame([tuple(row.get(n) for n in schema.names) for row in rows], schema)


def make_key(spark, rows):
    defaults = {
        "test_id": 1, "waveform_id": "W", "station_name": "ST", "station_manager": "M",
        "duration": 60.0, "earthquake_type": "quake",
    }
    full = [
        {
            **defaults,
            "start_time": row["send_time"],
            "end_time": row["send_time"] + timedelta(seconds=60),
            **row,
        }
        for row in rows
    ]
    return _frame(spark, ANSWER_KEY_SCHEMA, full)


def make_p(spark, rows):
    return _frame(spark, P_ALARM_SCHEMA, rows)


def make_s(spark, rows):
    return _frame(spark, S_ALARM_SCHEMA, rows)


# Hand-made rows: a strong wave, a weak one and an interference wave.
WAVES = [
    {"id": 1, "send_time": at("10:00:00"), "end_time": at("10:01:00"), "actual_peak": 100.0,
     "actual_magnitude": 5.0, "p_wave_time": at("10:00:05"), "s_wave_first_time": at("10:00:08"),
     "s_wave_second_time": at("10:00:09"), "s_wave_third_time": at("10:00:09.600"),
     "actual_latitude": 30.0, "actual_longitude": 100.0, "azimuth": 350.0, "actual_distance": 50.0},
    {"id": 2, "send_time": at("10:02:00"), "end_time": at("10:03:00"), "actual_peak": 39.999,
     "actual_magnitude": 4.0, "p_wave_time": at("10:02:05")},
    {"id": 3, "send_time": at("10:04:00"), "end_time": at("10:05:00"),
     "earthquake_type": "interference"},
]

P_ALARMS = [
    {"station_p_wave_alarm_id": "a", "jk_time": at("10:00:06"), "rcv_jktime": at("10:00:06.100"),
     "earthquake_level": 5.5, "sta_code": "S1", "source_latitude": 30.0, "source_longitude": 101.0,
     "azi_angle": 10.0, "epi_dist": 52.0005, "earth_id": "E1"},
    {"station_p_wave_alarm_id": "b", "jk_time": at("10:00:06"), "rcv_jktime": at("10:00:06.050"),
     "earthquake_level": 9.9, "sta_code": "S2", "earth_id": "E1"},
    {"station_p_wave_alarm_id": "c", "jk_time": at("10:02:00"), "rcv_jktime": at("10:02:00.200"),
     "earthquake_level": 4.0, "sta_code": "S3", "earth_id": "E2"},
    {"station_p_wave_alarm_id": "d", "jk_time": None, "rcv_jktime": at("10:04:10"),
     "earthquake_level": 4.0, "earth_id": "E3"},
]

S_ALARMS = [
    {"station_s_wave_alarm_id": "e", "jk_time": at("10:00:08"), "rcv_jktime": at("10:00:08.100"),
     "x_acc_value": 79.999, "earth_id": "E1"},
    {"station_s_wave_alarm_id": "f", "jk_time": at("10:00:09"), "rcv_jktime": at("10:00:09.100"),
     "x_acc_value": 80.0, "earth_id": "E1"},
    {"station_s_wave_alarm_id": "g", "jk_time": at("10:00:10"), "rcv_jktime": at("10:00:10.050"),
     "x_acc_value": 120.0, "earth_id": "E1"},
]

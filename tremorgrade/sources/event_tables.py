"""Read the shared sample tables as an answer key and two alarm logs.

Events play the parts: errors are the waves sent, clicks and views the P alarms,
purchases and signups the S alarms. Times are cut to the minute, which makes
ties, shared window ends and empty windows, or taken as they are, which makes
windows of any length. Cleaning and the row expressions play no part: they take
every event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorgrade.schema import ANSWER_KEY_FIELDS, ANSWER_KEY_SCHEMA, P_ALARM_ID, S_ALARM_ID
from tremorgrade.session import spread
from tremorgrade.sources import cleaning

INTERFERENCE = "interference"
P_KINDS = "event_type IN ('click', 'view')"
EVERY_KIND = "true"


def _steps(start: int, count: str, step: str) -> str:
    return f"{start}.0D + CAST({count} AS DOUBLE) * {step}D"


def _later(unit: str, count: str) -> str:
    return f"timestampadd({unit}, CAST({count} AS INT), t)"


_KEY = {
    "id": "event_id",
    "test_id": "CAST(event_id DIV 100 AS INT)",
    "waveform_id": "concat('W', event_id)",
    "station_name": "concat('ST', user_id)",
    "station_manager": "concat('M', user_id)",
    "start_time": "t",
    "send_time": "t",
    "duration": "60.0D",
    "end_time": _later("SECOND", "60"),
    "earthquake_type": f"CASE WHEN event_id % 10 = 0 THEN '{INTERFERENCE}' ELSE 'quake' END",
}

_TRUTH = {
    "distance_class": "concat('C', event_id % 3)",
    "actual_depth": "CAST(event_id % 40 AS DOUBLE)",
    "actual_magnitude": _steps(3, "event_id % 50", "0.1"),
    "actual_distance": "CAST(event_id % 300 AS DOUBLE)",
    "actual_latitude": _steps(20, "event_id % 1000", "0.01"),
    "actual_longitude": _steps(100, "event_id % 700", "0.01"),
    "actual_peak": "value",
    "p_wave_index": "CAST(event_id % 5 * 100 AS INT)",
    "p_wave_time": _later("SECOND", "event_id % 5"),
    "s_wave_first_index": "CAST((event_id % 5 + 2) * 100 AS INT)",
    "s_wave_first_time": _later("SECOND", "event_id % 5 + 2"),
    "s_wave_first_peak": "40.0D",
    "s_wave_second_index": "CAST((event_id % 5 + 4) * 100 AS INT)",
    "s_wave_second_time": _later("SECOND", "event_id % 5 + 4"),
    "s_wave_second_peak": "80.0D",
    "s_wave_third_index": "CAST((event_id % 5 + 6) * 100 AS INT)",
    "s_wave_third_time": _later("SECOND", "event_id % 5 + 6"),
    "s_wave_third_peak": "120.0D",
    "azimuth": "CAST(event_id % 360 AS DOUBLE)",
}

_ALARM = {
    "jk_time": "CASE WHEN event_id % 97 <> 0 THEN t END",
    "rcv_jktime": _later("MILLISECOND", "event_id % 200"),
    "earth_id": "CASE WHEN event_id % 53 <> 0 THEN concat('E', event_id DIV 20) END",
    "sta_code": "concat('ST', user_id)",
    "device_code": "concat('D', user_id)",
}

_P_ALARM = {
    P_ALARM_ID: "CAST(event_id AS STRING)",
    **_ALARM,
    "source_longitude": _steps(100, "event_id % 691", "0.0101"),
    "source_latitude": _steps(20, "event_id % 997", "0.0101"),
    "epi_dist": "CAST(event_id % 310 AS DOUBLE)",
    "azi_angle": "CAST(event_id % 350 AS DOUBLE)",
    "earthquake_level": _steps(3, "event_id % 45", "0.11"),
}

_S_ALARM = {S_ALARM_ID: "CAST(event_id AS STRING)", **_ALARM, "x_acc_value": "value"}


# The answer key as a file would hold it, with damage spread by event number:
# blanks, bad and too large numbers, over-long text, times in every form.
_CLOCK = "substring(CAST(t AS STRING), 12, 8)"
_DAY = "substring(CAST(t AS STRING), 1, 10)"
_SECONDS = {
    "p_wave_time": "event_id % 5",
    "s_wave_first_time": "event_id % 5 + 2",
    "s_wave_second_time": "event_id % 5 + 4",
    "s_wave_third_time": "event_id % 5 + 6",
    "end_time": "60",
}

_TEXT_KEY = {
    "test_id": """CASE WHEN event_id % 23 = 0 THEN '   ' WHEN event_id % 29 = 0 THEN '1.0'
        WHEN event_id % 31 = 0 THEN '99999999999' WHEN event_id % 3 = 0
        THEN concat(' ', event_id DIV 100, ' ') ELSE CAST(event_id DIV 100 AS STRING) END""",
    "waveform_id": """CASE WHEN event_id % 19 = 0 THEN repeat('W', 25)
        ELSE concat('W', event_id) END""",
    "station_name": "CASE WHEN event_id % 41 = 0 THEN '' ELSE concat('ST', user_id) END",
    "station_manager": "concat('M', user_id)",
    "start_time": "CAST(t AS STRING)",
    "send_time": f"""CASE event_id % 11
        WHEN 0 THEN concat(CAST(t AS STRING), '.12')
        WHEN 1 THEN concat(year(t), '/', month(t), '/', day(t), ' ', {_CLOCK})
        WHEN 2 THEN concat(replace({_DAY}, '-', ''), ' ', {_CLOCK})
        WHEN 3 THEN concat(replace({_DAY}, '-', '/'), ' ', {_CLOCK})
        WHEN 4 THEN concat(CAST(t AS STRING), '.1234567')
        WHEN 5 THEN concat('  ', CAST(t AS STRING), ' ')
        ELSE CAST(t AS STRING) END""",
    "duration": """CASE WHEN event_id % 43 = 0 THEN 'abc' WHEN event_id % 47 = 0 THEN '6e1'
        ELSE '60.0' END""",
    "earthquake_type": f"""CASE WHEN event_id % 10 = 0 THEN '{cleaning.INTERFERENCE}'
        ELSE 'quake' END""",
    "distance_class": "concat('C', event_id % 3)",
    "actual_depth": "CASE WHEN event_id % 7 = 0 THEN ' ' ELSE CAST(event_id % 40 AS STRING) END",
    "actual_magnitude": "CAST(CAST(3 + (event_id % 50) * 0.1BD AS DECIMAL(6,1)) AS STRING)",
    "actual_distance": "CAST(event_id % 300 AS STRING)",
    "actual_latitude": "CAST(CAST(20 + (event_id % 1000) * 0.01BD AS DECIMAL(8,2)) AS STRING)",
    "actual_longitude": "CAST(CAST(100 + (event_id % 700) * 0.01BD AS DECIMAL(8,2)) AS STRING)",
    "actual_peak": "CAST(CAST(value AS DECIMAL(10,2)) AS STRING)",
    "p_wave_index": "CASE WHEN event_id % 59 = 0 THEN 'x' ELSE CAST(event_id % 5 AS STRING) END",
    "s_wave_first_index": "CAST(event_id % 5 + 2 AS STRING)",
    "s_wave_first_peak": "'40'",
    "s_wave_second_index": "CAST(event_id % 5 + 4 AS STRING)",
    "s_wave_second_peak": "'80.'",
    "s_wave_third_index": "CAST(event_id % 5 + 6 AS STRING)",
    "s_wave_third_peak": "'.12e3'",
    "azimuth": "CASE WHEN event_id % 13 = 0 THEN '' ELSE CAST(event_id % 360 AS STRING) END",
    **{
        name: f"CASE WHEN event_id % 17 = 0 THEN 'None' ELSE CAST({_later('SECOND', n)} AS STRING) END"
        for name, n in _SECONDS.items()
    },
}


_EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def events(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    """The events with ``t``, their time, cut to the minute unless it is to be ``exact``."""
    time = F.expr("ts" if exact else "CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ)")
    rows = spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")
    return rows.withColumn("t", time)


def answer_key(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    truth = {name: f"CASE WHEN event_id % 10 <> 0 THEN {sql} END" for name, sql in _TRUTH.items()}
    columns = {**_KEY, **truth}
    rows = events(spark, sf_dir, exact).where("event_type = 'error'")
    return rows.selectExpr(*[f"{columns[name]} AS {name}" for name in ANSWER_KEY_SCHEMA.names])


def p_alarms(
    spark: SparkSession, sf_dir: str, kinds: str = P_KINDS, exact: bool = False
) -> DataFrame:
    rows = events(spark, sf_dir, exact).where(kinds)
    return rows.selectExpr(*[f"{sql} AS {name}" for name, sql in _P_ALARM.items()])


def s_alarms(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    rows = events(spark, sf_dir, exact).where("event_type IN ('purchase', 'signup')")
    return rows.selectExpr(*[f"{sql} AS {name}" for name, sql in _S_ALARM.items()])


def text_key(spark: SparkSession, sf_dir: str, as_scanned: bool = False) -> DataFrame:
    """The damaged answer key, a row for every event: its number and the 28 columns as text.

    A scan of few partitions is dealt out first, unless rows are wanted ``as_scanned``.
    """
    rows = events(spark, sf_dir)
    return (rows if as_scanned else spread(rows, "event_id")).selectExpr(
        "event_id AS id", *[f"{_TEXT_KEY[f.name]} AS {f.name}" for f in ANSWER_KEY_FIELDS]
    )

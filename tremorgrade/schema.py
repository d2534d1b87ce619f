"""Input schemas. Timestamps carry no zone; comments travel as field metadata."""

from __future__ import annotations

from pyspark.sql import types as T

_TS = T.TimestampNTZType()
_DOUBLE = T.DoubleType()
_INT = T.IntegerType()
_TEXT = T.StringType()


def _field(name, kind, nullable=True, comment=None):
    return T.StructField(name, kind, nullable, {"comment": comment} if comment else None)


# The positional columns of the answer-key file, in file order.
ANSWER_KEY_FIELDS = (
    _field("test_id", _INT, False, "test number"),
    _field("waveform_id", _TEXT, False, "wave number"),
    _field("station_name", _TEXT, False, "station name"),
    _field("station_manager", _TEXT, False, "station manager"),
    _field("start_time", _TS, False, "start time"),
    _field("send_time", _TS, False, "send time"),
    _field("duration", _DOUBLE, False, "duration (s)"),
    _field("end_time", _TS, False, "end time"),
    _field("earthquake_type", _TEXT, False, "wave type"),
    _field("distance_class", _TEXT, True, "multi-station distance class"),
    _field("actual_depth", _DOUBLE, True, "true focal depth"),
    _field("actual_magnitude", _DOUBLE, True, "true magnitude"),
    _field("actual_distance", _DOUBLE, True, "true epicentral distance (km)"),
    _field("actual_latitude", _DOUBLE, True, "true source latitude"),
    _field("actual_longitude", _DOUBLE, True, "true source longitude"),
    _field("actual_peak", _DOUBLE, True, "true peak (gal)"),
    _field("p_wave_index", _INT, True, "P onset position"),
    _field("p_wave_time", _TS, True, "P onset time"),
    _field("s_wave_first_index", _INT, True, "S first report position"),
    _field("s_wave_first_time", _TS, True, "S first report time"),
    _field("s_wave_first_peak", _DOUBLE, True, "S first report peak"),
    _field("s_wave_second_index", _INT, True, "S second report position"),
    _field("s_wave_second_time", _TS, True, "S second report time"),
    _field("s_wave_second_peak", _DOUBLE, True, "S second report peak"),
    _field("s_wave_third_index", _INT, True, "S third report position"),
    _field("s_wave_third_time", _TS, True, "S third report time"),
    _field("s_wave_third_peak", _DOUBLE, True, "S third report peak"),
    _field("azimuth", _DOUBLE, True, "azimuth"),
)

ANSWER_KEY_SCHEMA = T.StructType([_field("id", T.LongType(), False, "row number"), *ANSWER_KEY_FIELDS])

# The file as read: every column text, nothing rejected yet.
ANSWER_KEY_TEXT_SCHEMA = T.StructType([_field(f.name, _TEXT) for f in ANSWER_KEY_FIELDS])

# Longest text each column may hold.
TEXT_LIMITS = {
    "waveform_id": 20,
    "station_name": 50,
    "station_manager": 50,
    "earthquake_type": 20,
    "distance_class": 20,
}

# The truth about a wave; an interference wave has none.
TRUTH_COLUMNS = tuple(f.name for f in ANSWER_KEY_FIELDS[9:])

P_ALARM_ID = "station_p_wave_alarm_id"
S_ALARM_ID = "station_s_wave_alarm_id"

P_ALARM_SCHEMA = T.StructType(
    [
        _field(P_ALARM_ID, _TEXT, False),
        _field("earth_time", _TS),
        _field("p_arrive_time", _TS),
        _field("jk_time", _TS, True, "sent by the station"),
        _field("rcv_jktime", _TS, True, "received by the centre"),
        _field("earth_id", _TEXT),
        _field("receive_time", _TS),
        _field("sta_code", _TEXT),
        _field("device_code", _TEXT),
        _field("source_longitude", _DOUBLE),
        _field("source_latitude", _DOUBLE),
        _field("source_deep", _DOUBLE),
        _field("alarm_time", _TS),
        _field("s_time", _TS),
        _field("x_acc_value", _DOUBLE),
        _field("y_acc_value", _DOUBLE),
        _field("z_acc_value", _DOUBLE),
        _field("epi_dist", _DOUBLE),
        _field("alarm_level", T.ShortType()),
        _field("azi_angle", _DOUBLE),
        _field("earthquake_level", _DOUBLE),
        _field("report_num", _INT),
    ]
)

S_ALARM_SCHEMA = T.StructType(
    [
        _field(S_ALARM_ID, _TEXT, False),
        _field("alarm_level", T.ShortType()),
        _field("earth_id", _TEXT),
        _field("sta_code", _TEXT),
        _field("device_code", _TEXT),
        _field("alarm_time", _TS),
        _field("receive_time", _TS),
        _field("jk_time", _TS, True, "sent by the station"),
        _field("rcv_jktime", _TS, True, "received by the centre"),
        _field("x_acc_value", _DOUBLE),
        _field("y_acc_value", _DOUBLE),
        _field("z_acc_value", _DOUBLE),
        _field("earthquake_level", _DOUBLE),
        _field("source_longitude", _DOUBLE),
        _field("source_latitude", _DOUBLE),
        _field("source_deep", _DOUBLE),
        _field("report_num", _INT),
    ]
)

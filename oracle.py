"""The registered queries once more, as plain SQL for an independent engine.

Written from the definitions, not from the Spark code: windows by a global lead,
matches by ranking all alarms of a window, means from whole milliseconds.
"""

from __future__ import annotations

from tremorgrade.labels import DETAIL_COLUMNS_ZH

RANGE = ("2024-01-08 06:00:00.000", "2024-01-21 18:00:00.000")

# --- inputs ---------------------------------------------------------------

_QUAKE = "event_id % 10 <> 0"


def _steps(start, count, step):
    return f"CAST({start} AS DOUBLE) + CAST({count} AS DOUBLE) * CAST({step} AS DOUBLE)"


def _truth(**columns):
    return ",\n  ".join(f"CASE WHEN {_QUAKE} THEN {sql} END AS {name}" for name, sql in columns.items())


_KEY = f"""ev AS (SELECT *, date_trunc('minute', ts) AS t FROM events),
key AS (SELECT event_id AS id, CAST(event_id // 100 AS INTEGER) AS test_id,
  'W' || event_id AS waveform_id, 'ST' || user_id AS station_name, 'M' || user_id AS station_manager,
  t AS start_time, t AS send_time, CAST(60 AS DOUBLE) AS duration, t + to_seconds(60) AS end_time,
  CASE WHEN event_id % 10 = 0 THEN 'interference' ELSE 'quake' END AS earthquake_type,
  {_truth(
      distance_class="'C' || (event_id % 3)",
      actual_depth="CAST(event_id % 40 AS DOUBLE)",
      actual_magnitude=_steps(3, "event_id % 50", 0.1),
      actual_distance="CAST(event_id % 300 AS DOUBLE)",
      actual_latitude=_steps(20, "event_id % 1000", 0.01),
      actual_longitude=_steps(100, "event_id % 700", 0.01),
      actual_peak="value",
      p_wave_index="CAST(event_id % 5 * 100 AS INTEGER)",
      p_wave_time="t + to_seconds(event_id % 5)",
      s_wave_first_index="CAST((event_id % 5 + 2) * 100 AS INTEGER)",
      s_wave_first_time="t + to_seconds(event_id % 5 + 2)",
      s_wave_first_peak="CAST(40 AS DOUBLE)",
      s_wave_second_index="CAST((event_id % 5 + 4) * 100 AS INTEGER)",
      s_wave_second_time="t + to_seconds(event_id % 5 + 4)",
      s_wave_second_peak="CAST(80 AS DOUBLE)",
      s_wave_third_index="CAST((event_id % 5 + 6) * 100 AS INTEGER)",
      s_wave_third_time="t + to_seconds(event_id % 5 + 6)",
      s_wave_third_peak="CAST(120 AS DOUBLE)",
      azimuth="CAST(event_id % 360 AS DOUBLE)",
  )}
  FROM ev WHERE event_type = 'error'),
win AS (SELECT *, coalesce(lead(send_time) OVER (ORDER BY send_time, id), end_time) AS next_send_time
  FROM key)"""

_ALARM = """CAST(event_id AS VARCHAR) AS alarm_id,
  CASE WHEN event_id % 97 <> 0 THEN t END AS jk_time,
  t + to_milliseconds(event_id % 200) AS rcv_jktime,
  CASE WHEN event_id % 53 <> 0 THEN 'E' || (event_id // 20) END AS earth_id,
  'ST' || user_id AS sta_code, 'D' || user_id AS device_code"""

_EVERY_P = f"""SELECT {_ALARM},
  {_steps(100, "event_id % 691", 0.0101)} AS source_longitude,
  {_steps(20, "event_id % 997", 0.0101)} AS source_latitude,
  CAST(event_id % 310 AS DOUBLE) AS epi_dist, CAST(event_id % 350 AS DOUBLE) AS azi_angle,
  {_steps(3, "event_id % 45", 0.11)} AS earthquake_level
  FROM ev"""

_ALARMS = f"""pa AS ({_EVERY_P} WHERE event_type IN ('click', 'view')),
sa AS (SELECT {_ALARM}, value AS x_acc_value
  FROM ev WHERE event_type IN ('purchase', 'signup'))"""

# --- per wave --------------------------------------------------------------


def _r(value, places):
    return f"CAST(round(CAST({value} AS DECIMAL(30,12)), {places}) AS DECIMAL(22,{places}))"


def _secs(later, earlier):
    whole = f"CAST(epoch_us({later}) - epoch_us({earlier}) AS DECIMAL(18,0))"
    return f"CAST(round({whole} * CAST(0.000001 AS DECIMAL(7,6)), 3) AS DECIMAL(18,3))"


def _dbl(name):
    return f"CAST({name} AS DOUBLE)"


def _first(log, condition="true"):
    return f"""SELECT * FROM (SELECT w.id AS wave, a.*,
    row_number() OVER (PARTITION BY w.id ORDER BY a.jk_time, a.alarm_id) AS rn
    FROM win w JOIN {log} a ON a.jk_time BETWEEN w.send_time AND w.next_send_time
    WHERE {condition}) WHERE rn = 1"""


def _haversine(lat1, lon1, lat2, lon2):
    square = (
        f"(power(sin(radians(({lat1} - {lat2}) / 2)), 2)"
        f" + cos(radians({lat2})) * cos(radians({lat1}))"
        f" * power(sin(radians(({lon1} - {lon2}) / 2)), 2))"
    )
    return f"2 * 6371 * asin(sqrt(CASE WHEN {square} > 1 THEN 1 ELSE {square} END))"


_P = f"""pf AS ({_first("pa")}),
pm AS (SELECT w.id, w.send_time, w.next_send_time, a.jk_time AS first_jk_time,
  a.rcv_jktime AS first_rcv_jktime, a.sta_code, a.device_code,
  {", ".join(_r("a." + c, 3) + " AS " + c for c in
             ("source_longitude", "source_latitude", "epi_dist", "azi_angle", "earthquake_level"))}
  FROM win w LEFT JOIN pf a ON a.wave = w.id),
pc AS (SELECT w.id, w.send_time, w.next_send_time,
  CASE WHEN m.first_jk_time IS NULL THEN '1' END AS p_warning_miss,
  {_r("abs(CAST(m.earthquake_level AS DOUBLE) - w.actual_magnitude)", 2)} AS magnitude_diff,
  {_r(_haversine("CAST(m.source_latitude AS DOUBLE)", "CAST(m.source_longitude AS DOUBLE)",
                 "w.actual_latitude", "w.actual_longitude"), 3)} AS epicenter_deviation_km,
  {_secs("m.first_rcv_jktime", "w.p_wave_time")} AS p_wave_judge_time,
  {_secs("m.first_jk_time", "w.p_wave_time")} AS p_wave_judge_time_sta,
  {_r("abs(CAST(m.epi_dist AS DOUBLE) - w.actual_distance)", 3)} AS epi_dist_diff,
  {_r("abs(CAST(m.azi_angle AS DOUBLE) - w.azimuth)", 3)} AS azi_angle_diff,
  {_secs("m.first_rcv_jktime", "m.first_jk_time")} AS p_send_time
  FROM win w LEFT JOIN pm m ON m.id = w.id)"""

_S = f"""sf AS ({_first("sa")}), s80 AS ({_first("sa", "a.x_acc_value >= 80")}),
s120 AS ({_first("sa", "a.x_acc_value >= 120")}),
sp AS (SELECT w.id AS wave, max(a.x_acc_value) AS peak
  FROM win w JOIN sa a ON a.jk_time BETWEEN w.send_time AND w.next_send_time GROUP BY w.id),
sm AS (SELECT w.id, w.send_time, w.next_send_time, f.jk_time AS first_jk_time,
  f.rcv_jktime AS first_rcv_jktime, e.jk_time AS gal80_jk_time, e.rcv_jktime AS gal80_rcv_jktime,
  h.jk_time AS gal120_jk_time, h.rcv_jktime AS gal120_rcv_jktime, f.sta_code, f.device_code,
  {_r("p.peak", 3)} AS wave_peak
  FROM win w LEFT JOIN sf f ON f.wave = w.id LEFT JOIN s80 e ON e.wave = w.id
  LEFT JOIN s120 h ON h.wave = w.id LEFT JOIN sp p ON p.wave = w.id WHERE w.actual_peak >= 40),
sc AS (SELECT w.id, w.send_time, w.next_send_time,
  CASE WHEN m.first_jk_time IS NULL THEN '1' END AS s_warning_miss,
  {_secs("m.first_rcv_jktime", "w.s_wave_first_time")} AS swave_judge_time,
  {_secs("m.first_jk_time", "w.s_wave_first_time")} AS swave_judge_time_station,
  {_secs("m.gal80_rcv_jktime", "w.s_wave_second_time")} AS gal80_judge_time,
  {_secs("m.gal80_jk_time", "w.s_wave_second_time")} AS gal80_judge_time_station,
  {_secs("m.gal120_rcv_jktime", "w.s_wave_third_time")} AS gal120_judge_time,
  {_secs("m.gal120_jk_time", "w.s_wave_third_time")} AS gal120_judge_time_station,
  {_r("abs(w.actual_peak - CAST(m.wave_peak AS DOUBLE))", 3)} AS peak_deviation,
  CASE WHEN w.actual_peak <> 0 THEN CAST(round(
    CAST(abs(w.actual_peak - CAST(m.wave_peak AS DOUBLE)) / w.actual_peak AS DECIMAL(30,12)) * 100, 2)
    AS DECIMAL(22,2)) END AS peak_deviation_percent,
  {_secs("m.first_rcv_jktime", "m.first_jk_time")} AS s_send_time,
  {_secs("m.gal80_rcv_jktime", "m.gal80_jk_time")} AS gal80_send_time,
  {_secs("m.gal120_rcv_jktime", "m.gal120_jk_time")} AS gal120_send_time
  FROM win w JOIN sm m ON m.id = w.id)"""

_P_DECIMALS = ["source_longitude", "source_latitude", "epi_dist", "azi_angle", "earthquake_level"]
_PC_DECIMALS = [
    "magnitude_diff", "epicenter_deviation_km", "p_wave_judge_time", "p_wave_judge_time_sta",
    "epi_dist_diff", "azi_angle_diff", "p_send_time",
]
_SC_DECIMALS = [
    "swave_judge_time", "swave_judge_time_station", "gal80_judge_time", "gal80_judge_time_station",
    "gal120_judge_time", "gal120_judge_time_station", "peak_deviation", "peak_deviation_percent",
    "s_send_time", "gal80_send_time", "gal120_send_time",
]


def _doubles(names):
    return "* REPLACE (" + ", ".join(f"{_dbl(n)} AS {n}" for n in names) + ")"


_DETAILS = f"""SELECT w.id, w.test_id, w.waveform_id, w.send_time, w.end_time, w.station_name,
  w.earthquake_type, sc.s_warning_miss,
  CASE WHEN pm.first_jk_time > sm.first_jk_time THEN 'xs_hp' ELSE pc.p_warning_miss END AS p_warning_miss,
  w.actual_magnitude, {_dbl("pm.earthquake_level")} AS earthquake_level,
  w.actual_longitude, w.actual_latitude, {_dbl("pm.source_longitude")} AS source_longitude,
  {_dbl("pm.source_latitude")} AS source_latitude, w.p_wave_time,
  pm.first_rcv_jktime AS p_first_rcv_jktime, w.actual_peak, {_dbl("sm.wave_peak")} AS wave_peak,
  w.actual_distance, {_dbl("pm.epi_dist")} AS epi_dist, w.azimuth, {_dbl("pm.azi_angle")} AS azi_angle,
  {", ".join(f"{_dbl('pc.' + n)} AS {n}" for n in _PC_DECIMALS)},
  {", ".join(f"{_dbl('sc.' + n)} AS {n}" for n in _SC_DECIMALS)}
  FROM win w LEFT JOIN pc ON pc.id = w.id LEFT JOIN sc ON sc.id = w.id
  LEFT JOIN pm ON pm.id = w.id LEFT JOIN sm ON sm.id = w.id"""

# --- by event id -----------------------------------------------------------

_BY_ID_ORDER = "ORDER BY a.jk_time NULLS LAST, a.alarm_id"


def _first_of_event(condition="true"):
    return f"""SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY earth_id {_BY_ID_ORDER}) AS rn
    FROM sa a WHERE earth_id IS NOT NULL AND {condition}) WHERE rn = 1"""


_BY_ID = f"""pid AS (SELECT earth_id, jk_time, rcv_jktime, {_secs("rcv_jktime", "jk_time")} AS send_time
  FROM (SELECT a.*, row_number() OVER (PARTITION BY earth_id {_BY_ID_ORDER}) AS rn FROM pa a)
  WHERE rn = 1),
sid AS (SELECT s.earth_id, f.jk_time, f.rcv_jktime, {_secs("f.rcv_jktime", "f.jk_time")} AS send_time,
  e.jk_time AS gal80_jk_time, e.rcv_jktime AS gal80_rcv_jktime,
  {_secs("e.rcv_jktime", "e.jk_time")} AS gal80_send_time,
  h.jk_time AS gal120_jk_time, h.rcv_jktime AS gal120_rcv_jktime,
  {_secs("h.rcv_jktime", "h.jk_time")} AS gal120_send_time
  FROM (SELECT DISTINCT earth_id FROM sa) s
  LEFT JOIN ({_first_of_event()}) f ON f.earth_id = s.earth_id
  LEFT JOIN ({_first_of_event("a.x_acc_value >= 80")}) e ON e.earth_id = s.earth_id
  LEFT JOIN ({_first_of_event("a.x_acc_value >= 120")}) h ON h.earth_id = s.earth_id),
pid_cut AS (SELECT * FROM pid WHERE jk_time BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'),
sid_cut AS (SELECT * FROM sid WHERE jk_time BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}')"""

# --- KPIs -------------------------------------------------------------------


def _mean(measure):
    total = f"CAST(sum(CAST({measure} * 1000 AS BIGINT)) AS BIGINT)"
    n = f"count({measure})"
    half_up = (
        f"CASE WHEN {total} >= 0 THEN (2 * {total} + {n}) // nullif(2 * {n}, 0)"
        f" ELSE -((-2 * {total} + {n}) // nullif(2 * {n}, 0)) END"
    )
    return f"CAST(CAST({half_up} AS DECIMAL(15,0)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(18,3))"


def _hundredths(part, whole):
    return f"((20000 * {part} + {whole}) // nullif(2 * {whole}, 0))"


def _rate(part, whole, empty):
    value = f"CAST({_hundredths(part, whole)} AS DECIMAL(15,0)) * CAST(0.01 AS DECIMAL(3,2))"
    return f"coalesce(CAST(CAST({value} AS DECIMAL(18,2)) AS VARCHAR) || '%', '{empty}')"


def _verdict(n, condition, empty="NULL"):
    return f"CASE WHEN {n} = 0 THEN {empty} WHEN {condition} THEN 'yes' ELSE 'no' END"


def _delay(source, item, measure, op, limit, percent, standard, extras, rate_op=None, nonnull=False,
           timed=False):
    """Fields of a KPI with total, passes, rate, verdict and extremes."""
    n = f"count({measure})" if nonnull else "count(*)"
    p = f"count(*) FILTER (WHERE {measure} {op} {limit})"
    rate = f"count(*) FILTER (WHERE {measure} {rate_op or op} {limit})"
    known = {"max": f"max({measure})", "min": f"min({measure})", "avg": _mean(measure)}
    return source, [
        ("item", f"'{item}'", "text"), ("total", n, "count"), ("pass_count", p, "count"),
        ("pass_rate", _rate(rate, n, "NaN%" if timed else "NAN%"), "text"),
        ("standard", f"'{standard}'", "text"),
        ("verdict", _verdict(n, f"100 * {p} >= {percent} * {n}", "'NULL'" if timed else "NULL"), "text"),
        *[(f"{e}_value", known[e], "number") for e in extras.split()],
    ]


def _misses(source, item, percent, standard):
    p = "count(*) FILTER (WHERE first_jk_time IS NULL)"
    return source, [
        ("item", f"'{item}'", "text"), ("total", "count(*)", "count"), ("miss_count", p, "count"),
        ("miss_rate", _rate(p, "count(*)", "NAN%"), "text"), ("standard", f"'{standard}'", "text"),
        ("verdict", _verdict("count(*)", f"100 * {p} <= {percent} * count(*)"), "text"),
    ]


def _within(km, percent):
    p = f"CAST(sum(CASE WHEN epicenter_deviation_km <= {km} THEN 1 ELSE 0 END) AS BIGINT)"
    return [
        (f"within_{km}km_count", p, "count"),
        (f"within_{km}km_rate", _rate(p, "count(*)", "NAN%"), "text"),
        (f"within_{km}km_standard", f"'≥{percent}%'", "text"),
        (f"within_{km}km_verdict",
         _verdict("count(*)", f"{_hundredths(p, 'count(*)')} >= {percent * 100}"), "text"),
    ]


def _magnitude():
    source, fields = _delay("pc", "P alarm magnitude deviation ≤1", "magnitude_diff", "<=", 1, 50,
                            "≥95%", "avg")
    p = "count(*) FILTER (WHERE magnitude_diff <= 1)"
    verdict = _verdict("count(*)", f"{_hundredths(p, 'count(*)')} >= 5000")
    return source, [(n, verdict if n == "verdict" else sql, kind) for n, sql, kind in fields]


def _peak():
    p = "count(*) FILTER (WHERE peak_deviation_percent <= 5)"
    n = "count(*) FILTER (WHERE actual_peak >= 40)"
    source = "(SELECT w.actual_peak, sc.peak_deviation_percent FROM win w LEFT JOIN sc ON sc.id = w.id)"
    return source, [
        ("item", "'S alarm peak deviation ≤5%'", "text"), ("total", n, "count"),
        ("pass_count", p, "count"), ("pass_rate", _rate(p, n, "NAN%"), "text"),
        ("standard", "'≥95%'", "text"), ("verdict", _verdict(n, f"100 * {p} >= 95 * {n}"), "text"),
        ("max_deviation", "CAST(max(peak_deviation_percent) AS VARCHAR) || '%'", "text"),
    ]


def _s_delay(gal, measure, **more):
    extras = "avg max min"
    return _delay("sc", f"S alarm transmission time ≤0.1s ({gal}gal)", measure, more.pop("op"), 0.1, 95,
                  "95%", extras, **more)


def _s_judge(gal, measure, nonnull):
    return _delay("sc", f"S alarm judge time ≤0.5s ({gal}gal)", measure, "<=", 0.5, 70, "≥70%",
                  "avg max min", nonnull=nonnull)


KPIS = {
    "kpi_p_send": _delay("pc", "P alarm transmission time ≤0.1s", "p_send_time", "<=", 0.1, 95, "≥95%",
                         "max min avg"),
    "kpi_p_epicenter": ("pc", [
        ("item", "'P alarm epicentre deviation'", "text"), ("total", "count(*)", "count"),
        *_within(60, 60), *_within(100, 80),
        ("max_value", "max(epicenter_deviation_km)", "number"),
        ("max_within_300km",
         "CASE WHEN max(epicenter_deviation_km) <= 300 THEN 'yes' ELSE 'no' END", "text"),
    ]),
    "kpi_p_judge": _delay("pc", "P alarm judge time at the station ≤3s", "p_wave_judge_time_sta", "<=", 3,
                          90, "≥90%", "avg"),
    "kpi_p_magnitude": _magnitude(),
    "kpi_p_miss": _misses("pm", "P alarms missed", 5, "≤5%"),
    "kpi_s40_send": _s_delay(40, "s_send_time", op="<"),
    "kpi_s80_send": _s_delay(80, "gal80_send_time", op="<=", rate_op="<", nonnull=True),
    "kpi_s120_send": _s_delay(120, "gal120_send_time", op="<=", rate_op="<", nonnull=True),
    "kpi_s_miss": _misses("sm", "S alarms missed", 0, "≤0%"),
    "kpi_s_before_p": ("pm p LEFT JOIN sm s ON s.id = p.id", [
        ("item", "'S alarm before P alarm'", "text"),
        ("s_before_p_count", "count(*) FILTER (WHERE p.first_jk_time > s.first_jk_time)", "count"),
    ]),
    "kpi_s40_judge": _s_judge(40, "swave_judge_time_station", False),
    "kpi_s80_judge": _s_judge(80, "gal80_judge_time_station", True),
    "kpi_s120_judge": _s_judge(120, "gal120_judge_time_station", True),
    "kpi_s_peak": _peak(),
}


def _timed(source, gal, measure, **more):
    return _delay(source, f"S alarm transmission time ≤0.1s ({gal}gal)", measure, more.pop("op"), 0.1, 95,
                  "95%", "avg max min", timed=True, **more)


TIMED_KPIS = {
    "tkpi_p_send": _delay("pid_cut", "P alarm transmission time ≤0.1s", "send_time", "<=", 0.1, 95, "≥95%",
                          "max min avg", timed=True),
    "tkpi_s40_send": _timed("sid_cut", 40, "send_time", op="<"),
    "tkpi_s80_send": _timed("sid_cut", 80, "gal80_send_time", op="<=", rate_op="<", nonnull=True),
    "tkpi_s120_send": _timed("sid_cut", 120, "gal120_send_time", op="<=", rate_op="<", nonnull=True),
}


def _kpi_row(source, fields):
    def final(sql, kind):
        return {"text": sql, "count": f"CAST({sql} AS BIGINT)", "number": _dbl(sql)}[kind]

    return "SELECT " + ", ".join(f"{final(sql, kind)} AS {n}" for n, sql, kind in fields) + f" FROM {source}"


def _scorecard():
    parts = []
    for name, (source, fields) in KPIS.items():
        texts = ", ".join(f"CAST({sql} AS VARCHAR) AS f{i}" for i, (_, sql, _k) in enumerate(fields, 1))
        rows = " UNION ALL ".join(
            f"SELECT '{name}' AS kpi, {i} AS field_no, '{field}' AS field, f{i} AS value FROM one"
            for i, (field, _, _k) in enumerate(fields, 1)
        )
        parts.append(f"SELECT * FROM (WITH one AS (SELECT {texts} FROM {source}) {rows})")
    return " UNION ALL ".join(parts)


# --- cleaning ---------------------------------------------------------------

_CLOCK = "substring(CAST(t AS VARCHAR), 12, 8)"
_DAY = "substring(CAST(t AS VARCHAR), 1, 10)"


def _wave_time(offset):
    return f"CASE WHEN event_id % 17 = 0 THEN 'None' ELSE CAST(t + to_seconds({offset}) AS VARCHAR) END"


_TEXT_COLUMNS = {
    "test_id": """CASE WHEN event_id % 23 = 0 THEN '   ' WHEN event_id % 29 = 0 THEN '1.0'
      WHEN event_id % 31 = 0 THEN '99999999999' WHEN event_id % 3 = 0
      THEN ' ' || (event_id // 100) || ' ' ELSE CAST(event_id // 100 AS VARCHAR) END""",
    "waveform_id": "CASE WHEN event_id % 19 = 0 THEN repeat('W', 25) ELSE 'W' || event_id END",
    "station_name": "CASE WHEN event_id % 41 = 0 THEN '' ELSE 'ST' || user_id END",
    "station_manager": "'M' || user_id",
    "start_time": "CAST(t AS VARCHAR)",
    "send_time": f"""CASE event_id % 11 WHEN 0 THEN CAST(t AS VARCHAR) || '.12'
      WHEN 1 THEN year(t) || '/' || month(t) || '/' || day(t) || ' ' || {_CLOCK}
      WHEN 2 THEN replace({_DAY}, '-', '') || ' ' || {_CLOCK}
      WHEN 3 THEN replace({_DAY}, '-', '/') || ' ' || {_CLOCK}
      WHEN 4 THEN CAST(t AS VARCHAR) || '.1234567'
      WHEN 5 THEN '  ' || CAST(t AS VARCHAR) || ' ' ELSE CAST(t AS VARCHAR) END""",
    "duration": "CASE WHEN event_id % 43 = 0 THEN 'abc' WHEN event_id % 47 = 0 THEN '6e1' ELSE '60.0' END",
    "end_time": _wave_time("60"),
    "earthquake_type": "CASE WHEN event_id % 10 = 0 THEN '干扰波' ELSE 'quake' END",
    "distance_class": "'C' || (event_id % 3)",
    "actual_depth": "CASE WHEN event_id % 7 = 0 THEN ' ' ELSE CAST(event_id % 40 AS VARCHAR) END",
    "actual_magnitude": "CAST(CAST(3 + (event_id % 50) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(6,1)) AS VARCHAR)",
    "actual_distance": "CAST(event_id % 300 AS VARCHAR)",
    "actual_latitude": "CAST(CAST(20 + (event_id % 1000) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(8,2)) AS VARCHAR)",
    "actual_longitude": "CAST(CAST(100 + (event_id % 700) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(8,2)) AS VARCHAR)",
    "actual_peak": "CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR)",
    "p_wave_index": "CASE WHEN event_id % 59 = 0 THEN 'x' ELSE CAST(event_id % 5 AS VARCHAR) END",
    "p_wave_time": _wave_time("event_id % 5"),
    "s_wave_first_index": "CAST(event_id % 5 + 2 AS VARCHAR)",
    "s_wave_first_time": _wave_time("event_id % 5 + 2"),
    "s_wave_first_peak": "'40'",
    "s_wave_second_index": "CAST(event_id % 5 + 4 AS VARCHAR)",
    "s_wave_second_time": _wave_time("event_id % 5 + 4"),
    "s_wave_second_peak": "'80.'",
    "s_wave_third_index": "CAST(event_id % 5 + 6 AS VARCHAR)",
    "s_wave_third_time": _wave_time("event_id % 5 + 6"),
    "s_wave_third_peak": "'.12e3'",
    "azimuth": "CASE WHEN event_id % 13 = 0 THEN '' ELSE CAST(event_id % 360 AS VARCHAR) END",
}
_TRUTH = list(_TEXT_COLUMNS)[9:]
_INTS = ["test_id", "p_wave_index", "s_wave_first_index", "s_wave_second_index", "s_wave_third_index"]
_TIMES = [c for c in _TEXT_COLUMNS if c.endswith("_time")]
_LIMITS = {"waveform_id": 20, "station_name": 50, "station_manager": 50, "earthquake_type": 20,
           "distance_class": 20}
_NUMBERS = [c for c in _TEXT_COLUMNS if c not in _INTS and c not in _TIMES and c not in _LIMITS]
_REQUIRED = list(_TEXT_COLUMNS)[:9]

_RAW = f"""ev AS (SELECT *, date_trunc('minute', ts) AS t FROM events),
raw AS (SELECT event_id AS id, {", ".join(f"{sql} AS {n}" for n, sql in _TEXT_COLUMNS.items())}
  FROM ev),
quiet AS (SELECT * REPLACE ({", ".join(
    f"CASE WHEN earthquake_type = '干扰波' THEN NULL ELSE {c} END AS {c}" for c in _TRUTH)}) FROM raw)"""


def _blank(source):
    return f"SELECT * REPLACE ({', '.join(f'''nullif(CASE WHEN trim({c}) = '' THEN '' ELSE {c} END, '') AS {c}''' for c in _TEXT_COLUMNS)}) FROM {source}"


def _parsed(c):
    x = f"trim({c})"
    return f"""CASE WHEN {x} IN ('null', 'None') THEN NULL
      WHEN contains({x}, '.') THEN CASE WHEN length(split_part({x}, '.', 2)) BETWEEN 1 AND 6
        THEN try_cast({x} AS TIMESTAMP) END
      WHEN length({x}) = 19 THEN try_strptime({x}, '%Y-%m-%d %H:%M:%S')
      ELSE coalesce(try_strptime({x}, '%Y-%m-%d %H:%M:%S'), try_strptime({x}, '%Y%m%d %H:%M:%S'),
        try_strptime({x}, '%Y/%m/%d %H:%M:%S')) END"""


def _int(c):
    return f"CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN try_cast(trim({c}) AS INTEGER) END"


def _num(c):
    return f"try_cast(trim({c}) AS DOUBLE)"


def _checks():
    found = []
    for c in _TEXT_COLUMNS:
        if c in _INTS:
            form = f"regexp_full_match(trim({c}), '[+-]?[0-9]+')"
            found.append(f"CASE WHEN NOT {form} THEN 'bad_value:{c}' END")
            found.append(f"CASE WHEN {form} AND try_cast(trim({c}) AS INTEGER) IS NULL THEN 'out_of_range:{c}' END")
        elif c in _NUMBERS:
            found.append(f"CASE WHEN {c} IS NOT NULL AND {_num(c)} IS NULL THEN 'bad_value:{c}' END")
        if c in _LIMITS:
            found.append(f"CASE WHEN length(rtrim({c})) > {_LIMITS[c]} THEN 'too_long:{c}' END")
        if c in _REQUIRED:
            value = _parsed(c) if c in _TIMES else c
            found.append(f"CASE WHEN ({value}) IS NULL THEN 'missing:{c}' END")
    return f"concat_ws(',', {', '.join(found)})"


_CLEAN = f"""{_RAW}, clean AS ({_blank("quiet")}),
checked AS (SELECT *, {_checks()} AS errors FROM clean)"""

_REPORT = """SELECT rows_read, parsed, loaded, rejected,
  coalesce(CAST(round(CAST(100 * loaded AS DOUBLE) / nullif(parsed, 0), 2) AS DOUBLE), 0) AS loaded_pct
  FROM (SELECT count(*) AS rows_read, count(*) FILTER (WHERE NOT contains(errors, 'bad_value:')) AS parsed,
  count(*) FILTER (WHERE errors = '') AS loaded, count(*) FILTER (WHERE errors <> '') AS rejected
  FROM checked)"""


def _typed_columns():
    return ", ".join(
        [f"{_int(c)} AS {c}" for c in _INTS] + [f"{_num(c)} AS {c}" for c in _NUMBERS]
    )


def _loaded_columns():
    def value(c):
        if c in _INTS:
            return _int(c)
        if c in _NUMBERS:
            return _num(c)
        return _parsed(c) if c in _TIMES else c

    return ", ".join(f"{value(c)} AS {c}" for c in _TEXT_COLUMNS)


# --- registry ----------------------------------------------------------------


_KPI_ZH = {
    "total": "总数", "pass_count": "合格数", "pass_rate": "合格率", "standard": "标准",
    "max_value": "最大值", "min_value": "最小值", "avg_value": "平均值",
}


def _kpi_in_chinese(row: str, item: str) -> str:
    names = ", ".join(f'{name} AS "{zh}"' for name, zh in _KPI_ZH.items())
    verdict = "CASE verdict WHEN 'yes' THEN '是' WHEN 'no' THEN '否' ELSE verdict END"
    return f"""SELECT '{item}' AS "项目", {names}, {verdict} AS "是否达标" FROM ({row})"""


def statements() -> dict[str, str]:
    keyed = f"WITH {_KEY}"
    alarms = f"WITH {_KEY}, {_ALARMS}"
    every = f"WITH {_KEY}, pa AS ({_EVERY_P})"
    p, s = f"{alarms}, {_P}", f"{alarms}, {_S}"
    both = f"{alarms}, {_P}, {_S}"
    by_id = f"{alarms}, {_BY_ID}"
    raw, clean = f"WITH {_RAW}", f"WITH {_CLEAN}"
    shifted = _haversine("l.source_latitude", "l.source_longitude", "l.lat", "l.lon")
    found = {
        "answer_key_windows": f"{keyed} SELECT id, send_time, end_time, next_send_time FROM win",
        "answer_key": f"{keyed} SELECT * FROM win",
        "seconds_between": f"{every} SELECT alarm_id, "
        f"{_dbl(_secs('rcv_jktime', 'jk_time'))} AS delay, {_dbl(_secs('jk_time', 'rcv_jktime'))} AS lead"
        " FROM pa",
        "haversine_km": f"{every} SELECT alarm_id, {_dbl(_r(shifted, 3))} AS km FROM"
        " (SELECT *, source_latitude - azi_angle * CAST(0.01 AS DOUBLE) AS lat,"
        " source_longitude + epi_dist * CAST(0.01 AS DOUBLE) AS lon FROM pa) l",
        "p_matched": f"{p} SELECT {_doubles(_P_DECIMALS)} FROM pm",
        "p_compare": f"{p} SELECT {_doubles(_PC_DECIMALS)} FROM pc",
        "s_matched": f"{s} SELECT {_doubles(['wave_peak'])} FROM sm",
        "s_compare": f"{s} SELECT {_doubles(_SC_DECIMALS)} FROM sc",
        "details": f"{both} {_DETAILS}",
        "scorecard": f"{both} {_scorecard()}",
        "p_by_id": f"{by_id} SELECT {_doubles(['send_time'])} FROM pid",
        "s_by_id": f"{by_id} SELECT {_doubles(['send_time', 'gal80_send_time', 'gal120_send_time'])} FROM sid",
        "p_by_id_in_range": f"{by_id} SELECT {_doubles(['send_time'])} FROM pid_cut",
        "s_by_id_in_range": f"{by_id} SELECT {_doubles(['send_time', 'gal80_send_time', 'gal120_send_time'])} FROM sid_cut",
        "clean_interference": f"{raw} SELECT * FROM quiet",
        "clean_blank_to_null": f"{raw} {_blank('raw')}",
        "clean_parse_time": f"{raw} SELECT id, "
        + ", ".join(f"{_parsed(c)} AS {c}" for c in _TIMES) + " FROM raw",
        "clean_typed_cast": f"{clean} SELECT id, {_typed_columns()} FROM clean",
        "clean_required": f"{clean} SELECT id, errors FROM checked",
        "ingest_quarantine": f"{clean} SELECT * FROM checked WHERE errors <> ''",
        "ingest_loaded": f"{clean} SELECT id, {_loaded_columns()} FROM checked WHERE errors = ''",
        "ingest_report": f"{clean} {_REPORT}",
        "ingest_merged": f"""{clean} SELECT * EXCLUDE (event_id, place) REPLACE (CAST(id AS BIGINT) AS id) FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id % 3 = 0, send_time DESC, test_id DESC,
    waveform_id DESC) AS place
  FROM (SELECT id // 2 AS id, id AS event_id, {_loaded_columns()} FROM checked WHERE errors = ''))
  WHERE place = 1""",
        "ingest_row_id": f"{raw} SELECT row_number() OVER (ORDER BY id) AS row_id, id AS event_id,"
        " waveform_id FROM raw",
    }
    for name, (source, fields) in KPIS.items():
        found[name] = f"{both} {_kpi_row(source, fields)}"
    for name, (source, fields) in TIMED_KPIS.items():
        found[name] = f"{by_id} {_kpi_row(source, fields)}"
    for name in ("p_matched", "s_matched", "details", "scorecard"):
        # The same on times that are not cut.
        found[f"{name}_exact"] = found[name].replace("date_trunc('minute', ts) AS t", "ts AS t")
    named = ", ".join(f'{name} AS "{zh}"' for name, zh in DETAIL_COLUMNS_ZH.items())
    found["details_zh"] = f"{both} SELECT id, {named} FROM ({_DETAILS})"
    found["kpi_p_send_zh"] = f"{both} " + _kpi_in_chinese(
        _kpi_row(*KPIS["kpi_p_send"]), "P波预警传输时间统计≤0.1s"
    )
    found["tkpi_s40_send_zh"] = f"{by_id} " + _kpi_in_chinese(
        _kpi_row(*TIMED_KPIS["tkpi_s40_send"]), "阈值报警传输时延≤0.1s(40gal)"
    )
    return found

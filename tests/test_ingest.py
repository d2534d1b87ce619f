import contextlib
import io
import re
from datetime import datetime
from decimal import Decimal

import pytest

from tremorgrade.schema import ANSWER_KEY_FIELDS, ANSWER_KEY_SCHEMA, ANSWER_KEY_TEXT_SCHEMA
from tremorgrade.sources import answer_key, cleaning
from tremorgrade.sources.answer_key import add_row_ids, read_answer_key

GOOD = {
    "test_id": "1", "waveform_id": "W1", "station_name": "ST", "station_manager": "张三",
    "start_time": "2024-01-01 10:00:00", "send_time": "2024-01-01 10:00:00", "duration": "60",
    "end_time": "2024-01-01 10:01:00", "earthquake_type": "地震波", "distance_class": "近",
    "actual_depth": "10", "actual_magnitude": "5.5", "actual_distance": "50.1",
    "actual_latitude": "30", "actual_longitude": "100", "actual_peak": "80", "p_wave_index": "1",
    "p_wave_time": "2024-01-01 10:00:05", "s_wave_first_index": "2",
    "s_wave_first_time": "2024-01-01 10:00:08.5", "s_wave_first_peak": "40",
    "s_wave_second_index": "3", "s_wave_second_time": "2024-01-01 10:00:09", "s_wave_second_peak": "80",
    "s_wave_third_index": "4", "s_wave_third_time": "2024-01-01 10:00:10", "s_wave_third_peak": "120",
    "azimuth": "12.5",
}
NAMES = ANSWER_KEY_TEXT_SCHEMA.names


def text_rows(spark, *changes):
    rows = [{**GOOD, **change} for change in changes]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], ANSWER_KEY_TEXT_SCHEMA)


def line(**change):
    return ",".join({**GOOD, **change}[n] for n in NAMES)


def write(tmp_path, lines, encoding="utf-8"):
    path = tmp_path / "key.csv"
    path.write_bytes("\n".join(lines).encode(encoding))
    return str(path)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-01-01 10:00:00", "2024-01-01 10:00:00"),
        ("2024-01-01 10:00:00.12", "2024-01-01 10:00:00.120000"),
        ("2024/1/1 10:00:00", "2024-01-01 10:00:00"),
        ("2024/01/01 10:00:00", None),  # 19 characters: dashed only
        ("2024/1/1 10:00:00.5", None),  # a dot: dashed only
        ("20240101 10:00:00", "2024-01-01 10:00:00"),
        ("2024111 10:00:00", "2024-11-01 10:00:00"),
        ("2024-1-1 1:2:3", "2024-01-01 01:02:03"),
        ("2024-01-01   10:00:00", "2024-01-01 10:00:00"),
        ("　 2024-01-01 10:00:00\t", "2024-01-01 10:00:00"),
        ("2024-01-01 10:00:00.1234567", None),
        ("2024-01-01 10:00:00.", None),
        ("2024-13-01 10:00:00", None),
        ("2024-02-30 10:00:00", None),
        ("2024-01-01 10:00:60", None),
        ("2024-01-01 24:00:00", None),
        ("2024-01-01T10:00:00", None),
        ("2024-01-01", None),
        ("", None),
        ("  ", None),
        ("null", None),
        (" None ", None),
        (None, None),
    ],
)
def test_parse_time(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "x string").selectExpr(f"{cleaning.parse_time('x')} AS t")
    assert frame.schema["t"].dataType.typeName() == "timestamp_ntz"
    assert frame.first().t == (datetime.fromisoformat(expected) if expected else None)


@pytest.mark.parametrize(
    ("change", "errors"),
    [
        ({}, []),
        ({"test_id": " 7 "}, []),
        ({"test_id": "1_000"}, []),
        ({"test_id": "1.0"}, ["bad_value:test_id"]),
        ({"test_id": "x"}, ["bad_value:test_id"]),
        ({"test_id": "99999999999"}, ["out_of_range:test_id"]),
        ({"test_id": "  "}, ["missing:test_id"]),
        ({"duration": "6e1"}, []),
        ({"duration": "60d"}, ["bad_value:duration"]),
        ({"duration": "0x1p3"}, ["bad_value:duration"]),
        ({"azimuth": "NaN"}, []),
        ({"azimuth": "-inf"}, []),
        ({"azimuth": "."}, ["bad_value:azimuth"]),
        ({"actual_peak": "null"}, ["bad_value:actual_peak"]),
        ({"p_wave_index": ""}, []),
        ({"p_wave_time": "gibberish"}, []),
        ({"send_time": "2024/01/01 10:00:00"}, ["missing:send_time"]),
        ({"end_time": "null"}, ["missing:end_time"]),
        ({"waveform_id": "W" * 20}, []),
        ({"waveform_id": "W" * 21}, ["too_long:waveform_id"]),
        ({"waveform_id": "W" * 20 + "   "}, []),
        ({"station_name": None}, ["missing:station_name"]),
        ({"distance_class": "x" * 21, "test_id": "y"}, ["bad_value:test_id", "too_long:distance_class"]),
    ],
)
def test_row_errors(spark, change, errors):
    ingested = cleaning.ingest(text_rows(spark, change))
    assert ingested.checked.first().errors == errors
    assert ingested.loaded.count() == (0 if errors else 1)


def test_typed_values(spark):
    row = cleaning.ingest(text_rows(spark, {"test_id": "1_000", "azimuth": "-inf", "waveform_id": "W" * 20 + " "}))
    row = row.loaded.first()
    assert (row.test_id, row.azimuth, row.waveform_id) == (1000, float("-inf"), "W" * 20)
    assert row.s_wave_first_time == datetime(2024, 1, 1, 10, 0, 8, 500000)
    assert row.actual_magnitude == 5.5


def test_interference_loses_its_truth_before_it_is_checked(spark):
    noise = {"earthquake_type": cleaning.INTERFERENCE, "actual_peak": "junk"}
    row = cleaning.ingest(text_rows(spark, noise)).loaded.first()
    assert all(row[f.name] is None for f in ANSWER_KEY_FIELDS[9:])
    assert row.earthquake_type == cleaning.INTERFERENCE
    # The label must match exactly, spaces included.
    near = {"earthquake_type": cleaning.INTERFERENCE + " ", "actual_peak": "80"}
    assert cleaning.ingest(text_rows(spark, near)).loaded.first().actual_peak == 80.0


def test_quarantine_and_report(spark):
    rows = text_rows(spark, {}, {"test_id": "x"}, {"station_name": " "}, {}).coalesce(1)
    ingested = cleaning.ingest(rows)
    assert [r.id for r in ingested.loaded.orderBy("id").collect()] == [1, 4]
    assert {r.id: r.errors for r in ingested.rejected.collect()} == {
        2: ["bad_value:test_id"], 3: ["missing:station_name"],
    }
    assert ingested.rejected.columns == ["id", *NAMES, "errors"]
    (report,) = ingested.report().collect()
    # Row 3 converts but is refused, so it counts as parsed.
    assert report.asDict() == {
        "rows_read": 4, "parsed": 3, "loaded": 2, "rejected": 2, "loaded_pct": Decimal("66.67"),
    }
    (empty,) = cleaning.ingest(text_rows(spark, {}).where("false")).report().collect()
    assert (empty.rows_read, empty.loaded_pct) == (0, Decimal("0.00"))


def test_loaded_schema_and_comments(spark):
    schema = cleaning.ingest(text_rows(spark, {})).loaded.schema
    assert [(f.name, f.dataType) for f in schema] == [(f.name, f.dataType) for f in ANSWER_KEY_SCHEMA]
    assert schema["azimuth"].metadata["comment"] == "azimuth"


def test_file_lines_short_long_quoted_and_blank(spark, tmp_path):
    path = write(tmp_path, [
        "any,header,at,all",
        line(station_name='"a ""b"", c"'),
        "",
        line() + ",surplus,fields",
        "2,W2,short",
    ])
    rows = read_answer_key(spark, path, encoding="UTF-8").collect()
    assert [r.waveform_id for r in rows] == ["W1", "W1", "W2"]
    assert rows[0].station_name == 'a "b", c'
    assert rows[1].azimuth == "12.5"
    assert rows[2].station_name == "short" and rows[2].azimuth is None


@pytest.mark.parametrize("encoding", ["gbk", "gb18030", "gb2312", "utf-8", "utf-8-sig"])
def test_file_in_chinese_encoding(spark, tmp_path, encoding):
    path = write(tmp_path, ["header", line(earthquake_type="干扰波")], encoding)
    assert answer_key.guess_encoding(spark, path) == ("UTF-8" if encoding.startswith("utf") else "GB18030")
    try:
        (row,) = read_answer_key(spark, path).collect()
        (named,) = read_answer_key(spark, path, encoding=encoding.replace("utf-8-sig", "UTF-8")).collect()
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    assert (row.earthquake_type, row.station_manager) == ("干扰波", "张三")
    assert row == named


def test_guess_of_other_bytes(spark, tmp_path):
    def guess(content):
        (tmp_path / "f").write_bytes(content)
        return answer_key.guess_encoding(spark, str(tmp_path / "f"))

    assert guess(b"") == guess(b"plain") == "UTF-8"
    assert guess("张".encode() * 20_000) == "UTF-8"  # the 50,000th byte is inside a character
    assert guess("张三".encode("gbk") * 20_000) == "GB18030"
    assert guess("caf\xe9 ".encode("latin-1") + b"\xff\xff") == "ISO-8859-1"
    with pytest.raises(LookupError):
        read_answer_key(spark, str(tmp_path / "f"), encoding="no-such")


def test_bytes_the_encoding_does_not_know_are_replaced(spark, tmp_path):
    path = tmp_path / "key.csv"
    path.write_bytes(("header\n" + line(station_manager="@")).encode().replace(b"@", b"\xff"))
    (row,) = read_answer_key(spark, str(path), encoding="UTF-8").collect()
    assert row.station_manager == "�"


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path, ["header", line(station_manager='"two\nlines"'), line()])
    rows = read_answer_key(spark, path, encoding="UTF-8", multi_line=True).collect()
    assert [r.station_manager for r in rows] == ["two\nlines", "张三"]


def test_row_ids_run_on_across_partitions_in_file_order(spark, tmp_path):
    count = 5000
    path = write(tmp_path, ["header", *[line(waveform_id=f"W{i}") for i in range(1, count + 1)]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        raw = read_answer_key(spark, path, encoding="UTF-8")
        assert raw.rdd.getNumPartitions() > 3
        rows = add_row_ids(raw).collect()
        assert sorted(r.id for r in rows) == list(range(1, count + 1))
        assert all(r.waveform_id == f"W{r.id}" for r in rows)
        loaded = cleaning.ingest(raw).loaded
        assert loaded.where("waveform_id = concat('W', id)").count() == count
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_typing_stays_in_compiled_code(spark):
    """No lambda, and no generated method too long for the JVM to compile (8000 bytes)."""
    rows = cleaning._cleaned_and_typed(text_rows(spark, {}).selectExpr("1L AS id", "*"), cleaning.INTERFERENCE)
    seen = io.StringIO()
    with contextlib.redirect_stdout(seen):
        rows.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", seen.getvalue())]
    assert sizes and max(sizes) < 8000
    assert "lambdafunction" not in seen.getvalue()


def test_stored_rows_are_counted_while_they_are_written(spark):
    rows = text_rows(spark, {}, {"duration": "x"}, {"station_name": " "}, {"p_wave_time": "?"})
    ingested = cleaning.ingest(rows)
    stored = ingested.stored()
    assert stored.counts == (4, 3, 2, 2)
    assert stored.report().collect() == ingested.report().collect()
    for table in ("loaded", "rejected"):
        kept, anew = getattr(stored, table), getattr(ingested, table)
        assert kept.columns == anew.columns
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, anew.collect()))
    assert not stored.checked.is_cached
    empty = cleaning.ingest(rows.where("false")).stored()
    assert empty.counts == (0, 0, 0, 0) and empty.loaded.count() == 0


def test_rows_that_are_no_scan_are_not_numbered(spark):
    with pytest.raises(ValueError, match="straight from a scan"):
        add_row_ids(text_rows(spark, {}, {}).repartition(3))


def test_scan_of_few_partitions_is_dealt_out(spark, tmp_path):
    path = write(tmp_path, ["header", *[line(waveform_id=f"W{i}") for i in range(1, 401)]])
    raw = read_answer_key(spark, path, encoding="UTF-8")
    assert raw.rdd.getNumPartitions() == 1
    loaded = cleaning.ingest(raw).loaded
    assert loaded.rdd.getNumPartitions() > 1
    assert loaded.where("waveform_id = concat('W', id)").count() == 400


def test_interference_label_may_hold_quotes(spark):
    label = "it's \\ noise"
    rows = cleaning.null_interference(text_rows(spark, {"earthquake_type": label}, {}), label).collect()
    assert [r.actual_peak for r in rows] == [None, "80"]

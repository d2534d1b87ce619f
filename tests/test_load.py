"""Loading a key into a folder: merge by id, quarantine, and the swap at the end."""

import itertools
import os
import random

import pytest

from tests.test_ingest import text_rows
from tremorgrade.sinks import load
from tremorgrade.sinks.folders import Staging
from tremorgrade.sources import cleaning


def loaded(spark, *changes):
    """Loaded rows with the ids in ``changes``."""
    ids = [c.pop("id") for c in changes]
    rows = text_rows(spark, *changes).coalesce(1)
    numbered = cleaning.ingest(rows).loaded
    of = dict(enumerate(ids, 1))
    made = [(of[r.id], *r[1:]) for r in numbered.collect()]
    return spark.createDataFrame(made, numbered.schema)


def sent(second):
    return f"2024-01-01 10:00:{second:02d}"


def test_merge_in_random_cases(spark):
    draw = random.Random(4)
    for _ in range(3):
        sides = [
            [
                {"id": draw.randint(1, 12), "send_time": sent(draw.randint(0, 3)), "waveform_id": f"W{draw.randint(0, 9)}"}
                for _ in range(draw.randint(1, 25))
            ]
            for _ in range(2)
        ]
        key = lambda r: (r["send_time"], r["waveform_id"])
        expected = {}
        for side in sides:
            side = sorted(side, key=key)
            expected |= {i: max(rows, key=key) for i, rows in itertools.groupby(
                sorted(side, key=lambda r: r["id"]), lambda r: r["id"]) for rows in [list(rows)]}
        expected = {i: r["waveform_id"] for i, r in expected.items()}
        old, new = (loaded(spark, *map(dict, side)) for side in sides)
        merged = load.merge_key(old, new)
        rows = merged.collect()
        assert {r.id: r.waveform_id for r in rows} == expected and len(rows) == len(expected)
        assert merged.columns == new.columns


def test_merge_of_empty_sides(spark):
    rows = loaded(spark, {"id": 1}, {"id": 1}, {"id": 2})
    assert load.merge_key(None, rows.where("false")).collect() == []
    assert load.merge_key(rows, rows.where("false")).count() == 2
    assert load.merge_key(rows.where("false"), rows).count() == 2


def test_rows_with_one_id_are_merged_before_the_shuffle(spark):
    rows = loaded(spark, {"id": 1}, {"id": 2})
    plan = load.merge_key(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_max" in plan and "Join" not in plan


def test_load_replaces_appends_and_quarantines(spark, tmp_path):
    path = str(tmp_path / "key")

    def ids(table):
        return sorted(r[0] for r in spark.read.parquet(f"{path}/{table}").collect())

    first = cleaning.ingest(text_rows(spark, {}, {"test_id": "x"}, {"waveform_id": "old"}).coalesce(1))
    assert load.load_key(first, path) == load.Loaded(3, 2, 2, 1, 0)
    assert (ids("answer_key"), ids("quarantine")) == ([1, 3], [2])

    again = cleaning.ingest(text_rows(spark, {}, {}, {"waveform_id": "new"}).coalesce(1))
    assert load.load_key(again, path).loaded == 3
    assert (ids("answer_key"), ids("quarantine")) == ([1, 2, 3], [])
    assert spark.read.parquet(f"{path}/answer_key").where("id = 3").first().waveform_id == "new"

    assert load.load_key(again, path, append=True).loaded == 3
    assert ids("answer_key") == [1, 2, 3, 4, 5, 6]
    assert spark.read.parquet(f"{path}/import_report").first().rows_read == 3
    assert sorted(os.listdir(path)) == ["answer_key", "import_report", "quarantine", "repeated_ids"]


def test_repeated_ids_are_named(spark, tmp_path):
    path = str(tmp_path / "key")
    rows = text_rows(spark, {}, {}, {}).selectExpr("CAST(7 AS BIGINT) AS id", "*")
    assert load.load_key(cleaning.ingest(rows), path).repeated == 1
    assert [tuple(r) for r in spark.read.parquet(f"{path}/repeated_ids").collect()] == [(7, 3)]
    assert spark.read.parquet(f"{path}/answer_key").count() == 1


def test_a_failed_load_leaves_the_key_as_it_was(spark, tmp_path):
    path = str(tmp_path / "key")
    load.load_key(cleaning.ingest(text_rows(spark, {})), path)
    staging = Staging(spark, path)
    with pytest.raises(Exception, match="boom"):
        staging.write("answer_key", spark.range(3).selectExpr("raise_error('boom') AS x"))
    assert spark.read.parquet(f"{path}/answer_key").count() == 1

"""Every registered query against its SQL twin, on the smallest supplied tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registry
import oracle
from tremorgrade import Evaluation, Sizing
from tremorgrade.plans.kpi import KPIS
from tremorgrade.sources import event_tables

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def twin():
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return engine


def test_every_query_has_a_twin():
    assert set(oracle.statements()) <= set(registry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


def same(rows, twin, name):
    cursor = twin.execute(oracle.statements()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(rows.columns) == sorted(names)
    expected = sorted(map(repr, cursor.fetchall()))
    found = sorted(repr(tuple(row)) for row in rows.select(names).collect())
    assert found == expected


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_query_equals_twin(spark, twin, name):
    same(registry.queries()[name](spark, SF), twin, name)


@pytest.mark.parametrize("name", ["answer_key", "details", "scorecard"])
def test_shuffled_plan_equals_twin(spark, twin, name):
    run = Evaluation(
        event_tables.answer_key(spark, SF),
        event_tables.p_alarms(spark, SF),
        event_tables.s_alarms(spark, SF),
        Sizing(broadcast_waves=0),
    )
    same(registry._plain(getattr(run, name)()), twin, name)


def test_entry(spark):
    assert {row.kpi for row in registry.entry(spark).collect()} == {k.name for k in KPIS}

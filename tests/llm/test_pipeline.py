"""The pipeline on the smallest supplied tables, and registered SQL."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tremorgrade.llm import contamination, jaccard_join, quality, registry, suffix_dedup  # noqa: E402


@pytest.fixture(scope="module", autouse=True)
def package_on_workers(spark):
    spark.sparkContext.environment["PYTHONPATH"] = os.path.dirname(corpus_pipeline.__file__)


def test_chat_equals_sql(spark):
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cursor = engine.execute(registry.SQL["op2_chat_format"])
    names = [c[0] for c in cursor.description]
    found = registry.QUERIES["op2_chat_format"](spark, SF).select(names).collect()
    assert sorted(map(tuple, found)) == sorted(cursor.fetchall())


def test_every_decision_takes_effect(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    good = {r.doc_id for r in quality.score(documents, quality.train(documents, labels)).collect() if r.keep}
    kept = documents.where(documents.doc_id.isin(sorted(good)))
    first = [r.doc_id for r in jaccard_join.jaccard_join(kept).collect() if r.doc_id == r.component_id]
    single = kept.where(kept.doc_id.isin(first))
    texts = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in suffix_dedup.cut_repeats(single).collect()}
    cut = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    leaked = {r.doc_id for r in contamination.find_overlaps(cut, benchmark).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == texts.keys() - leaked
    assert all(r.round_trip and r.n_chars == len(texts[i]) for i, r in got.items())
    assert 0 < len(leaked) and len(first) < len(good) < documents.count()


def test_a_task_of_the_cut_needs_one_python_worker(spark):
    """Workers an executor once started stay, so two at once in a task doubles them for good."""
    cut = corpus_pipeline.cut_repeats(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    plan = cut._jdf.queryExecution().executedPlan().toString().splitlines()
    last = plan[: next(i for i, line in enumerate(plan) if "Exchange" in line)]
    assert sum("MapInArrow" in line for line in last) == 1

"""From raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last
return the columns of documents. Between two stages the documents are written and read
again. No single SQL text expresses the classifier, so ORACLE_SQL is None and the stages
are tested.

Rows without doc_id pass the join and the cut as they are and are judged by the others; null
texts are empty. Rows that share a doc_id are told apart by their texts. An empty table gives
no rows. Further columns pass to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tremorgrade.llm import contamination, jaccard_join, quality, suffix_dedup, unigram
from tremorgrade.llm.row_keys import put_back, set_aside
from tremorgrade.llm.store import stored

ORACLE_SQL = None

_BATCH_SETTING, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Batches of 4 MB at most on their way to Python: documents are long, and a batch is held
    several times over, here and there, in every running task."""
    if int(spark.conf.get(_BATCH_SETTING).rstrip("b")) > _BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(_BATCH_BYTES))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents' labels, lets pass."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id."""
    _small_batches(spark)
    return jaccard_join.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of 200 bytes and more that repeat. A character cut in
    two goes too; n_chars is what is left."""
    _small_batches(spark)
    aside = set_aside(docs)
    return put_back(suffix_dedup.cut_texts(aside, "others"), docs, n_chars="length")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.decontaminate(docs, benchmark.select("item_id", "text"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with the proof that they decode to its text."""
    _small_batches(spark)
    file = public_tokenizers.path("piece_bpe_32k.model")
    return unigram.round_trips(docs, file, "lang", "source", "n_chars", "token_ids")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding and decoding", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage{number}")
    return docs

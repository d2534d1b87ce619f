"""Read the answer-key file as text columns and number its rows."""

from __future__ import annotations

import codecs
import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorgrade.schema import ANSWER_KEY_TEXT_SCHEMA
from tremorgrade.session import straight_from_scan

# Encodings Spark reads without further ado; others need the setting below.
_BUILT_IN = {"US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"}
_CHARSET_SETTING = "spark.sql.legacy.javaCharsets"

_INDEX_BITS = 33
_GUESSED_BYTES = 50_000

log = logging.getLogger(__name__)


def guess_encoding(spark: SparkSession, path: str) -> str:
    """The encoding that the first 50,000 bytes of every file agree with: UTF-8, else the
    Chinese one that covers GBK and GB2312, else Latin-1, which takes any byte."""
    files = spark.read.format("binaryFile").load(path)
    heads = [bytes(r[0]) for r in files.select(F.substring("content", 1, _GUESSED_BYTES)).toLocalIterator()]
    for name in ("UTF-8", "GB18030"):
        if all(_reads(head, name) for head in heads):
            return name
    return "ISO-8859-1"


def _reads(head: bytes, encoding: str) -> bool:
    """Whether the bytes are text of this encoding; the last character may be cut off."""
    try:
        codecs.getincrementaldecoder(encoding)().decode(head)
    except UnicodeDecodeError:
        return False
    return True


def read_answer_key(
    spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool = False
) -> DataFrame:
    """The 28 columns by position, all text, without the header line.

    Short lines end in nulls and surplus fields are dropped; nothing is
    rejected here. Bytes the encoding does not know become replacement marks.
    Without ``encoding`` it is guessed. ``multi_line`` allows line breaks inside quotes but
    reads each file whole. An encoding beyond Spark's own needs a setting of the session
    when the file is scanned; it is switched on and stays on.
    """
    encoding = encoding or guess_encoding(spark, path)
    if encoding.upper() not in _BUILT_IN and spark.conf.get(_CHARSET_SETTING, "false") != "true":
        codecs.lookup(encoding)
        log.info("%s switched on to read %s", _CHARSET_SETTING, encoding)
        spark.conf.set(_CHARSET_SETTING, "true")
    return (
        spark.read.schema(ANSWER_KEY_TEXT_SCHEMA)
        .option("header", True)
        .option("enforceSchema", True)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )


def add_row_ids(rows: DataFrame, name: str = "id") -> DataFrame:
    """Number the rows of a scan 1, 2, 3, ... in file order.

    Rows are counted per scan partition and numbered on from the partitions
    before; only those counts, one per partition, come together. The scan runs twice, so
    ``rows`` must come straight from it: shuffled rows are refused, and a partition that is
    not the one that was counted ends the job.
    """
    if not straight_from_scan(rows):
        raise ValueError("rows are numbered in file order, so they must come straight from a scan")
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    part = F.expr(f"shiftright(_at, {_INDEX_BITS}) AS _part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = f"(_at & {2**_INDEX_BITS - 1})"
    other = "raise_error('the scan has other partitions than when its rows were counted')"
    number = f"CASE WHEN {inside} < _rows THEN _offset + {inside} + 1 ELSE CAST({other} AS BIGINT) END"
    return (
        placed.withColumn("_part", F.expr(f"shiftright(_at, {_INDEX_BITS})"))
        # One row per partition of the scan.
        .join(F.broadcast(offsets), "_part", "left")
        .select(F.expr(number).alias(name), *[rows[c] for c in rows.columns])
    )

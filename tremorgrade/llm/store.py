"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; where none is named, as in tests, one of our own.

    That only on one machine: on a cluster each would write to its own disk and read nothing.
    """
    context = spark.sparkContext
    named = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError(f"{_SETTING} must name a folder that all machines share")
        # The setting itself cannot change in a running session.
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tremorgrade-"))
        named = context.getCheckpointDir()
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tremorgrade-{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` now and read them back: lineage is cut, and a lost executor costs nothing."""
    spark = rows.sparkSession
    path = new_path(spark, name)
    rows.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop shuffle files no plan refers to
    return spark.read.schema(rows.schema).parquet(path)

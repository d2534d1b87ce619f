"""What the library needs from the Spark session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER_SETTING = "spark.checkpoint.dir"


def computed_once(rows: DataFrame) -> DataFrame:
    """Compute ``rows`` now and read them back wherever they are used.

    They go as Parquet into the checkpoint folder the cluster names, so they
    outlive any executor, and later plans read the few columns they need instead
    of repeating the work. Clearing that folder is the cluster's business.
    """
    spark = rows.sparkSession
    path = f"{_shared_folder(spark).rstrip('/')}/tremorgrade-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def straight_from_scan(rows: DataFrame) -> bool:
    """Whether nothing is shuffled on the way to ``rows``, so partitions are those of the scan."""
    return "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out by ``key`` for costly work."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    few = straight_from_scan(rows) and rows.rdd.getNumPartitions() < cores
    return rows.repartition(cores, key) if few else rows


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; only where none is, on one machine, one of our own.

    On a cluster every machine would write to its own disk and reads would find nothing.
    """
    context = spark.sparkContext
    named = spark.conf.get(_FOLDER_SETTING, None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local["):
            raise RuntimeError(f"{_FOLDER_SETTING} must name a folder that all machines share")
        # The setting itself cannot change in a running session.
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tremorgrade-"))
        named = context.getCheckpointDir()
    return named

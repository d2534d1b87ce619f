"""Write several tables and show them together: all in a staging folder, then swapped in."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Staging:
    """Tables written beside ``path`` and moved into it by ``swap``.

    Until then readers see the tables of before; a job that dies leaves them as they were.
    A table is renamed, not copied, and the others in ``path`` stay.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self.folder = f"{self.path}/_staging-{uuid.uuid4().hex}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path: Callable = hadoop.Path
        self._files = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.names: list[str] = []

    def write(self, name: str, rows: DataFrame, fmt: str = "parquet") -> None:
        writer = rows.write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{self.folder}/{name}")
        self.names.append(name)

    def swap(self) -> None:
        """Move what was written into place, and clear the staging folder."""
        for name in self.names:
            target, before = self._path(f"{self.path}/{name}"), self._path(f"{self.folder}/before-{name}")
            if self._files.exists(target) and not self._files.rename(target, before):
                raise OSError(f"cannot move {target} away")
            if not self._files.rename(self._path(f"{self.folder}/{name}"), target):
                raise OSError(f"cannot move {name} to {target}")
        self._files.delete(self._path(self.folder), True)

    def has(self, name: str) -> bool:
        """Whether ``path`` holds this table already."""
        return self._files.exists(self._path(f"{self.path}/{name}"))

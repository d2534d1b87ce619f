"""Write reports and tables. Sorting happens here and nowhere else.

Every sink takes ``labels``, a function of a table's name and rows that gives the rows under
the names their readers know, such as ``tremorgrade.labels.in_chinese``.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tremorgrade.plans.evaluation import Evaluation
from tremorgrade.sinks.folders import Staging

log = logging.getLogger(__name__)

Labels = Callable[[str, DataFrame], DataFrame]


def times_as_text(rows: DataFrame) -> DataFrame:
    """Timestamps as text to the second, for people and spreadsheets."""
    columns = []
    for field in rows.schema:
        name = f"`{field.name.replace('`', '``')}`"
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            columns.append(f"date_format({name}, 'yyyy-MM-dd HH:mm:ss') AS {name}")
        else:
            columns.append(name)
    return rows.selectExpr(*columns)


def write_scorecard(
    evaluation: Evaluation, path: str, fmt: str = "parquet", labels: Labels | None = None
) -> list[str]:
    """One directory per KPI and one long ``scorecard``; returns the names written.

    The totals are computed once. A KPI that fails holds no other up; all that failed
    are named in the error raised at the end.
    """
    return _write_all(evaluation.stored().kpi_tables(), path, fmt, labels)


def write_details(
    evaluation: Evaluation, path: str, fmt: str = "parquet", labels: Labels | None = None
) -> None:
    """The wide report, sorted by wave; text formats get readable times."""
    rows = evaluation.details().orderBy("id").drop("id")
    if fmt == "csv":
        rows = times_as_text(rows)
    _writer(labels("details", rows) if labels else rows, fmt).mode("overwrite").save(path)


def write_tables(
    evaluation: Evaluation,
    path: str,
    fmt: str = "parquet",
    start=None,
    end=None,
    labels: Labels | None = None,
) -> list[str]:
    """Every table under one path, from one graded frame; with a time range those by event
    id and on the range too. Readers see all of them change at once, at the end."""
    return _write_all(evaluation.stored().tables(start, end), path, fmt, labels)


def write_timed(
    evaluation: Evaluation, start, end, path: str, fmt: str = "parquet", labels: Labels | None = None
) -> list[str]:
    """The by-id tables, their cut by time, and the four KPIs on the cut."""
    return _write_all(evaluation.stored().timed_tables(start, end), path, fmt, labels)


def save_tables(
    evaluation: Evaluation, database: str, start=None, end=None, labels: Labels | None = None
) -> list[str]:
    """Every table as a table of ``database``, in place of those of before.

    What all of them read is computed before the first is replaced.
    """
    stored = evaluation.stored()
    tables = stored.tables(start, end)
    return _each(
        tables,
        lambda name, rows: rows.write.mode("overwrite").saveAsTable(f"{database}.{name}"),
        labels,
    )


class NotAllWritten(RuntimeError):
    """Raised after everything else was written; ``failed`` and ``written`` have the names."""

    def __init__(self, failed: dict[str, Exception], written: list[str]) -> None:
        super().__init__(f"not written: {', '.join(failed)}; written: {', '.join(written) or 'none'}")
        self.failed, self.written = failed, written


def _write_all(tables: dict[str, DataFrame], path: str, fmt: str, labels: Labels | None) -> list[str]:
    """All into a staging folder, then those that succeeded into place."""
    staging = Staging(next(iter(tables.values())).sparkSession, path)
    try:
        return _each(tables, lambda name, rows: staging.write(name, rows, fmt), labels)
    finally:
        staging.swap()


def _each(tables: dict[str, DataFrame], write: Callable, labels: Labels | None) -> list[str]:
    written: list[str] = []
    failed: dict[str, Exception] = {}
    for name, rows in tables.items():
        try:
            rows = rows.orderBy("id") if "id" in rows.columns else rows
            write(name, labels(name, rows) if labels else rows)
            written.append(name)
        except Exception as error:
            log.exception("could not write %s", name)
            failed[name] = error
    if failed:
        raise NotAllWritten(failed, written) from next(iter(failed.values()))
    return written


def _writer(rows: DataFrame, fmt: str):
    writer = rows.write.format(fmt)
    return writer.option("header", True) if fmt == "csv" else writer

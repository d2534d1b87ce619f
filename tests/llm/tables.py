"""Small tables with the cases every operator must stand."""

from __future__ import annotations

import duckdb

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def documents(spark, rows):
    """From (doc_id, text, lang, source)."""
    full = [(i, text, lang, source, None if text is None else len(text)) for i, text, lang, source in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def twin(sql: str, sf_dir: str, *tables: str) -> tuple[list[str], list[tuple]]:
    """Columns and rows of a registered query's SQL."""
    engine = duckdb.connect()
    for name in tables:
        engine.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = engine.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def same(rows, names, expected) -> None:
    assert sorted(rows.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, rows.select(names).collect()))) == sorted(map(repr, expected))

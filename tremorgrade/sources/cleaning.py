"""Clean the answer key: text in, typed rows and a quarantine out.

Everything is a projection: each row carries its own errors as bits of one number, and
rows without any are loaded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorgrade.schema import (
    ANSWER_KEY_FIELDS,
    ANSWER_KEY_SCHEMA,
    TEXT_LIMITS,
    TRUTH_COLUMNS,
)
from tremorgrade.session import computed_once, spread
from tremorgrade.sources.answer_key import add_row_ids

# Fixed value: the wave type that carries no truth.
INTERFERENCE = "干扰波"
#: Name under which the rows read are counted while a key is cleaned.
READ = "answer_key_rows_read"

# Every character counted as white space, the ideographic space included.
_WHITESPACE = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
_SPACES = "'" + "".join(f"\\u{code:04X}" for code in _WHITESPACE) + "'"

_DIGITS = r"\\d+(_\\d+)*"
_INTEGER = f"^[+-]?{_DIGITS}$"
_NUMBER = (
    rf"(?i)^[+-]?((({_DIGITS})([.]({_DIGITS})?)?|[.]{_DIGITS})(e[+-]?{_DIGITS})?|inf|infinity|nan)$"
)

# The accepted forms of a time. Only dashed dates may have a fraction.
_DASHED = r"^\\d{4}-\\d{1,2}-\\d{1,2}\\s+\\d{1,2}:\\d{1,2}:\\d{1,2}([.]\\d{1,6})?$"
_SLASHED = r"^\\d{4}/\\d{1,2}/\\d{1,2}\\s"
_COMPACT_DATE = r"^(\\d{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\\d|0[1-9]|[1-9])(?=\\s)"


def null_interference(rows: DataFrame, label: str = INTERFERENCE) -> DataFrame:
    """Drop the truth columns of interference waves."""
    escaped = label.replace("\\", "\\\\").replace("'", "\\'")
    is_noise = f"earthquake_type = '{escaped}'"
    return _replace(
        rows, {c: f"CASE WHEN {is_noise} THEN NULL ELSE {c} END" for c in TRUTH_COLUMNS}
    )


def blank_to_null(rows: DataFrame) -> DataFrame:
    """Turn empty and all-space text into null; other text stays as it is."""
    texts = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
    kept = {c: f"CASE WHEN {stripped(quoted(c))} <> '' THEN {quoted(c)} END" for c in texts}
    return _replace(rows, kept)


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def stripped(text: str) -> str:
    return f"btrim({text}, {_SPACES})"


def parse_time(text: str) -> str:
    """SQL text for a time in one of the accepted forms; null for all else, so for "null".

    With a dot: dashed date and one to six places. Exactly 19 characters:
    dashed date. Otherwise dashed, compact or slashed date.
    """
    return _time_of(stripped(text))


def _time_of(t: str) -> str:
    """One form to check and to cast: the others are first written as dashed dates."""
    dashed = (
        f"CASE WHEN length({t}) = 19 OR instr({t}, '.') > 0 THEN {t}"
        f" WHEN {t} RLIKE '{_SLASHED}' THEN replace({t}, '/', '-')"
        f" ELSE regexp_replace({t}, '{_COMPACT_DATE}', '$1-$2-$3') END"
    )
    # The cast knows a single space between date and clock.
    one_gap = rf"regexp_replace({_of_form(dashed, _DASHED)}, '\\s+', ' ')"
    return f"try_cast({one_gap} AS TIMESTAMP_NTZ)"


def _number(t: str, form: str, kind: str) -> str:
    return f"try_cast(replace({_of_form(t, form)}, '_', '') AS {kind})"


def _of_form(text: str, form: str) -> str:
    """The text if it has the form, else '', which no cast takes. (A CASE would be torn apart
    by the optimizer, and its value no longer be seen as the same in two places.)"""
    return f"regexp_extract({text}, '{form}', 0)"


# How each kind of field is read from its stripped text.
_READERS = {
    T.TimestampNTZType: _time_of,
    T.IntegerType: lambda t: _number(t, _INTEGER, "INT"),
    T.DoubleType: lambda t: _number(t, _NUMBER, "DOUBLE"),
}


def typed(rows: DataFrame) -> DataFrame:
    """Add ``_v_<column>``, the values in their target types, and ``_errors``, a bit per error.

    Plain columns in two steps: stripped texts, then values and bits. ``READ`` counts the
    rows between them, which also keeps the steps in two pieces of generated code. A value
    stands a second time in its bit, so it gets a method of its own. All methods stay small
    enough to be compiled; with everything in one, every row would be interpreted.
    """
    names = {f.name for f in ANSWER_KEY_FIELDS if type(f.dataType) in _READERS}
    strip = [f"{stripped(name)} AS _t_{name}" for name in sorted(names)]
    return _values(rows.selectExpr("*", *strip).observe(READ, F.count(F.lit(1)).alias("rows")), rows.columns)


def _cleaned_and_typed(rows: DataFrame, interference: str) -> DataFrame:
    """``null_interference``, ``blank_to_null`` and ``typed`` with every text stripped once."""
    nulled = null_interference(rows, interference)
    names = [f.name for f in ANSWER_KEY_FIELDS]
    strip = {name: stripped(name) for name in names}
    texts = nulled.selectExpr("*", *[f"{sql} AS _t_{name}" for name, sql in strip.items()])
    blank = {name: f"CASE WHEN _t_{name} <> '' THEN {name} END" for name in names}
    return _values(_replace(texts, blank).observe(READ, F.count(F.lit(1)).alias("rows")), rows.columns)


def _values(texts: DataFrame, columns: list[str]) -> DataFrame:
    values = {
        f.name: _READERS[type(f.dataType)](f"_t_{f.name}")
        for f in ANSWER_KEY_FIELDS
        if type(f.dataType) in _READERS
    }
    for name, limit in TEXT_LIMITS.items():
        # Spaces beyond the limit are cut, anything else beyond it is an error.
        values[name] = f"substring({name}, 1, {limit})"
    bits = " + ".join(_error_bit(f, values[f.name]) for f in ANSWER_KEY_FIELDS)
    return texts.selectExpr(
        *map(quoted, columns),
        *[f"{values[f.name]} AS _v_{f.name}" for f in ANSWER_KEY_FIELDS],
        f"{bits} AS _errors",
    )


def _kinds_of(field: T.StructField) -> list[str]:
    """What can be wrong with a field, first thing first; a row has at most one of them."""
    kinds = []
    if isinstance(field.dataType, T.IntegerType):
        kinds.append("out_of_range")
    if isinstance(field.dataType, (T.IntegerType, T.DoubleType)):
        kinds.append("bad_value")
    if field.name in TEXT_LIMITS:
        kinds.append("too_long")
    if not field.nullable:
        kinds.append("missing")
    elif isinstance(field.dataType, T.TimestampNTZType):
        kinds.append("no_time")
    return kinds


_BITS = {
    f"{kind}:{f.name}": 1 << bit
    for bit, (f, kind) in enumerate((f, kind) for f in ANSWER_KEY_FIELDS for kind in _kinds_of(f))
}
#: Every possible error, as it is shown, with its bit. A text that is no time where none is
#: asked for (``no_time``) has a bit too, but a row is loaded without it.
ERRORS = {name: bit for name, bit in _BITS.items() if not name.startswith("no_time:")}
ANY = sum(ERRORS.values())
UNREADABLE = sum(bit for name, bit in ERRORS.items() if name.startswith("bad_value:"))


def _error_bit(field: T.StructField, value: str) -> str:
    """SQL for the bit of what is wrong with a field, 0 if nothing is."""
    name, cases = field.name, []
    unread = f"WHEN {value} IS NULL AND {name} IS NOT NULL THEN "
    bits = {kind: f"{_BITS[f'{kind}:{name}']}L" for kind in _kinds_of(field)}
    if "out_of_range" in bits:
        whole = f"_t_{name} RLIKE '{_INTEGER}'"
        cases.append(f"{unread} CASE WHEN {whole} THEN {bits['out_of_range']} ELSE {bits['bad_value']} END")
    elif "bad_value" in bits or "no_time" in bits:
        cases.append(unread + (bits.get("bad_value") or bits["no_time"]))
    if "too_long" in bits:
        cases.append(f"WHEN length(rtrim({name})) > {TEXT_LIMITS[name]} THEN {bits['too_long']}")
    if "missing" in bits:
        cases.append(f"WHEN {value} IS NULL THEN {bits['missing']}")
    return f"CASE {' '.join(cases)} ELSE 0L END"


def error_names(bits: str = "_errors") -> str:
    """SQL for the list of errors that the bits stand for."""
    each = ", ".join(f"CASE WHEN {bits} & {bit}L <> 0 THEN '{name}' END" for name, bit in ERRORS.items())
    return f"array_compact(array({each}))"


def _replace(rows: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return rows.selectExpr(
        *[f"{expressions[c]} AS {quoted(c)}" if c in expressions else quoted(c) for c in rows.columns]
    )


# Nullability is settled by the checks, not by the reader.
_NULLABLE_KEY = T.StructType(
    [T.StructField(f.name, f.dataType, True, f.metadata) for f in ANSWER_KEY_SCHEMA]
)


@dataclass(frozen=True)
class Ingested:
    """Cleaned rows with their errors, split on demand.

    ``checked`` has the texts as cleaned, ``_v_`` columns with their values, the bits
    ``_errors`` and the list ``errors``. Each table reads the raw rows anew; where several
    are wanted, ``stored`` reads them once.
    """

    checked: DataFrame

    @property
    def loaded(self) -> DataFrame:
        """The answer key: rows without an error."""
        good = self.checked.where(f"_errors & {ANY}L = 0")
        values = [f"_v_{f.name} AS {f.name}" for f in ANSWER_KEY_FIELDS]
        return good.selectExpr("id", *values).to(_NULLABLE_KEY)

    @property
    def rejected(self) -> DataFrame:
        """Rows with errors: number, text as cleaned, and the errors."""
        bad = self.checked.where(f"_errors & {ANY}L <> 0")
        return bad.drop("_errors", *[f"_v_{f.name}" for f in ANSWER_KEY_FIELDS])

    def report(self) -> DataFrame:
        """One row of counts. ``parsed`` rows convert but may still be refused."""
        counts = self.checked.selectExpr(*[f"{sql} AS {name}" for name, sql in _COUNTS.items()])
        return _with_share(counts)

    def stored(self) -> Stored:
        """The rows checked once, written to the shared folder and counted on the way.

        Texts are written for rejected rows only, as nothing else reads them again.
        """
        seen = Observation()
        texts = [c for c in self.checked.columns if c[0] != "_" and c not in ("id", "errors")]
        bad = f"_errors & {ANY}L <> 0"
        rows = self.checked.selectExpr(
            "id",
            *[f"CASE WHEN {bad} THEN {quoted(c)} END AS {quoted(c)}" for c in texts],
            *[f"_v_{f.name}" for f in ANSWER_KEY_FIELDS],
            "_errors",
            f"CASE WHEN {bad} THEN errors ELSE array() END AS errors",
        )
        counts = [F.expr(sql).alias(name) for name, sql in _COUNTS.items()]
        kept = computed_once(rows.observe(seen, *counts))
        return Stored(kept, tuple(seen.get[name] or 0 for name in _COUNTS))


@dataclass(frozen=True)
class Stored(Ingested):
    """``counts``: rows read, parsed, loaded and rejected, seen while the rows were written."""

    counts: tuple[int, ...]

    def report(self) -> DataFrame:
        schema = ", ".join(f"{name} BIGINT" for name in _COUNTS)
        return _with_share(self.checked.sparkSession.createDataFrame([self.counts], schema))


_COUNTS = {
    "rows_read": "count(1)",
    "parsed": f"count_if(_errors & {UNREADABLE}L = 0)",
    "loaded": f"count_if(_errors & {ANY}L = 0)",
    "rejected": f"count_if(_errors & {ANY}L <> 0)",
}


def _with_share(counts: DataFrame) -> DataFrame:
    loaded_pct = "round(100 * loaded / nullif(parsed, 0), 2)"
    return counts.selectExpr("*", f"coalesce(CAST({loaded_pct} AS DECIMAL(5,2)), 0.00BD) AS loaded_pct")


def ingest(raw: DataFrame, interference: str = INTERFERENCE) -> Ingested:
    """Clean text rows. An ``id`` column already there is kept, else rows are numbered.

    Checking costs far more than reading, so a scan of few partitions is dealt out first.
    """
    rows = spread(raw, "id") if "id" in raw.columns else _numbered(raw)
    checked = _cleaned_and_typed(rows, interference)
    return Ingested(checked.selectExpr("*", f"{error_names()} AS errors"))


def _numbered(raw: DataFrame) -> DataFrame:
    """Rows numbered by their places in the scan, then dealt out like it."""
    rows, cores = add_row_ids(raw), raw.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, "id") if raw.rdd.getNumPartitions() < cores else rows

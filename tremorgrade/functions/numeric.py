"""Rounding and time arithmetic as SQL expression text, for ``selectExpr``.

Text, because one parsed expression costs the driver far less than a tree of
Column calls, and the reports hold hundreds of expressions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00"}


def rounded(value: str, places: int) -> str:
    """Round a double half away from zero through an exact decimal.

    Rounding the double itself works on its shortest text, so 1.675 held as
    1.6749999999999998 would go down; twelve decimal places absorb that noise.
    Null for NaN, infinity and magnitudes from 1e18 up, which no decimal holds.
    """
    return f"round(try_cast({value} AS DECIMAL(30,12)), {places})"


def seconds_between(later: str, earlier: str) -> str:
    """Seconds from ``earlier`` to ``later``, exact, rounded to milliseconds."""
    return f"round(CAST({later} - {earlier} AS DECIMAL(20,6)), 3)"


def micros(ts: str) -> str:
    """Microseconds since 1970 of a timestamp_ntz, whatever the session zone.

    In a UTC session the cast to an instant is exact and cheap; elsewhere it
    would shift around clock changes, so the difference to the epoch is used.
    """
    if SparkSession.active().conf.get("spark.sql.session.timeZone") in _UTC_NAMES:
        return f"unix_micros(CAST({ts} AS TIMESTAMP_LTZ))"
    since = f"{ts} - TIMESTAMP_NTZ '1970-01-01 00:00:00'"
    return f"CAST(CAST({since} AS DECIMAL(18,6)) * 1000000 AS BIGINT)"


def hundredths(part: str, whole: str) -> str:
    """``part / whole`` as a percentage in hundredths, rounded half up.

    Integer arithmetic, so no quotient is rounded twice. Null if whole is 0.
    """
    return f"((20000 * {part} + {whole}) DIV (2 * nullif({whole}, 0)))"


def percent_text(in_hundredths: str) -> str:
    """Hundredths of a percent as text with two places, e.g. ``66.67%``."""
    return f"concat(CAST(CAST({in_hundredths} AS DECIMAL(20,0)) * 0.01BD AS STRING), '%')"

"""The eighteen KPIs as data, and the two steps that compute them.

Step one aggregates: all KPIs on one frame share one aggregate, with their row
filters inside it. Step two works on that single row and writes the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tremorgrade.functions import hundredths, percent_text

YES, NO = "yes", "no"


@dataclass(frozen=True)
class Share:
    """How many rows pass, as count, rate text and verdict.

    ``limit`` is in percent and compared with the exact ratio, or with the
    rate as shown (two places) if ``as_shown``. ``rate_passes`` replaces
    ``passes`` in the rate text only. ``names`` are the four output columns.
    ``null_if_empty``: the count over no rows is null, not 0.
    """

    passes: str
    limit: int
    standard: str
    at_most: bool = False
    as_shown: bool = False
    rate_passes: str | None = None
    null_if_empty: bool = False
    names: tuple[str, str, str, str] = ("pass_count", "pass_rate", "standard", "verdict")


@dataclass(frozen=True)
class Extra:
    """One more output column: max, min, avg, count_if, max_text or max_within."""

    name: str
    kind: str
    of: str
    limit: int | None = None


@dataclass(frozen=True)
class Kpi:
    """``on`` names the frame: p, s or both (per wave), p_by_id or s_by_id."""

    name: str
    on: str
    item: str
    rows: str | None = None
    total: bool = True
    shares: tuple[Share, ...] = ()
    extras: tuple[Extra, ...] = ()
    empty_rate: str = "NAN%"
    empty_verdict: str | None = None


def _spread(of: str, order: str = "avg max min") -> tuple[Extra, ...]:
    return tuple(Extra(f"{kind}_value", kind, of) for kind in order.split())


_MISS_NAMES = ("miss_count", "miss_rate", "standard", "verdict")


def _km_names(km: int) -> tuple[str, str, str, str]:
    return tuple(f"within_{km}km_{part}" for part in ("count", "rate", "standard", "verdict"))


# Limits, standards and the oddities kept on purpose. The 80 and
# 120 gal delays count 0.1 s as a pass but leave it out of the rate; the 40 gal
# delay is strict throughout; the magnitude verdict asks for 50 percent under a
# text that says 95.
KPIS = (
    Kpi(
        "kpi_p_send", "p", "P alarm transmission time ≤0.1s",
        shares=(Share("p_send_time <= 0.1", 95, "≥95%"),),
        extras=_spread("p_send_time", "max min avg"),
    ),
    Kpi(
        "kpi_p_epicenter", "p", "P alarm epicentre deviation",
        shares=(
            Share("epicenter_deviation_km <= 60", 60, "≥60%", as_shown=True, null_if_empty=True,
                  names=_km_names(60)),
            Share("epicenter_deviation_km <= 100", 80, "≥80%", as_shown=True, null_if_empty=True,
                  names=_km_names(100)),
        ),
        extras=(
            Extra("max_value", "max", "epicenter_deviation_km"),
            Extra("max_within_300km", "max_within", "epicenter_deviation_km", 300),
        ),
    ),
    Kpi(
        "kpi_p_judge", "p", "P alarm judge time at the station ≤3s",
        shares=(Share("p_wave_judge_time_sta <= 3", 90, "≥90%"),),
        extras=_spread("p_wave_judge_time_sta", "avg"),
    ),
    Kpi(
        "kpi_p_magnitude", "p", "P alarm magnitude deviation ≤1",
        shares=(Share("magnitude_diff <= 1", 50, "≥95%", as_shown=True),),
        extras=_spread("magnitude_diff", "avg"),
    ),
    Kpi(
        "kpi_p_miss", "p", "P alarms missed",
        shares=(Share("p_first_jk_time IS NULL", 5, "≤5%", at_most=True, names=_MISS_NAMES),),
    ),
    Kpi(
        "kpi_s40_send", "s", "S alarm transmission time ≤0.1s (40gal)", rows="s_eligible",
        shares=(Share("s_send_time < 0.1", 95, "95%"),),
        extras=_spread("s_send_time"),
    ),
    Kpi(
        "kpi_s80_send", "s", "S alarm transmission time ≤0.1s (80gal)",
        rows="s_eligible AND gal80_send_time IS NOT NULL",
        shares=(Share("gal80_send_time <= 0.1", 95, "95%", rate_passes="gal80_send_time < 0.1"),),
        extras=_spread("gal80_send_time"),
    ),
    Kpi(
        "kpi_s120_send", "s", "S alarm transmission time ≤0.1s (120gal)",
        rows="s_eligible AND gal120_send_time IS NOT NULL",
        shares=(Share("gal120_send_time <= 0.1", 95, "95%", rate_passes="gal120_send_time < 0.1"),),
        extras=_spread("gal120_send_time"),
    ),
    Kpi(
        "kpi_s_miss", "s", "S alarms missed", rows="s_eligible",
        shares=(Share("s_first_jk_time IS NULL", 0, "≤0%", at_most=True, names=_MISS_NAMES),),
    ),
    Kpi(
        "kpi_s_before_p", "both", "S alarm before P alarm", total=False,
        extras=(Extra("s_before_p_count", "count_if", "p_first_jk_time > s_first_jk_time"),),
    ),
    Kpi(
        "kpi_s40_judge", "s", "S alarm judge time ≤0.5s (40gal)", rows="s_eligible",
        shares=(Share("swave_judge_time_station <= 0.5", 70, "≥70%"),),
        extras=_spread("swave_judge_time_station"),
    ),
    Kpi(
        "kpi_s80_judge", "s", "S alarm judge time ≤0.5s (80gal)",
        rows="s_eligible AND gal80_judge_time_station IS NOT NULL",
        shares=(Share("gal80_judge_time_station <= 0.5", 70, "≥70%"),),
        extras=_spread("gal80_judge_time_station"),
    ),
    Kpi(
        "kpi_s120_judge", "s", "S alarm judge time ≤0.5s (120gal)",
        rows="s_eligible AND gal120_judge_time_station IS NOT NULL",
        shares=(Share("gal120_judge_time_station <= 0.5", 70, "≥70%"),),
        extras=_spread("gal120_judge_time_station"),
    ),
    Kpi(
        "kpi_s_peak", "s", "S alarm peak deviation ≤5%", rows="s_eligible",
        shares=(Share("peak_deviation_percent <= 5", 95, "≥95%"),),
        extras=(Extra("max_deviation", "max_text", "peak_deviation_percent"),),
    ),
)

_TIMED = {"empty_rate": "NaN%", "empty_verdict": "NULL"}

TIMED_KPIS = (
    Kpi(
        "tkpi_p_send", "p_by_id", "P alarm transmission time ≤0.1s",
        shares=(Share("send_time <= 0.1", 95, "≥95%"),),
        extras=_spread("send_time", "max min avg"), **_TIMED,
    ),
    Kpi(
        "tkpi_s40_send", "s_first", "S alarm transmission time ≤0.1s (40gal)",
        shares=(Share("send_time < 0.1", 95, "95%"),),
        extras=_spread("send_time"), **_TIMED,
    ),
    Kpi(
        "tkpi_s80_send", "s_by_id", "S alarm transmission time ≤0.1s (80gal)",
        rows="gal80_send_time IS NOT NULL",
        shares=(Share("gal80_send_time <= 0.1", 95, "95%", rate_passes="gal80_send_time < 0.1"),),
        extras=_spread("gal80_send_time"), **_TIMED,
    ),
    Kpi(
        "tkpi_s120_send", "s_by_id", "S alarm transmission time ≤0.1s (120gal)",
        rows="gal120_send_time IS NOT NULL",
        shares=(Share("gal120_send_time <= 0.1", 95, "95%", rate_passes="gal120_send_time < 0.1"),),
        extras=_spread("gal120_send_time"), **_TIMED,
    ),
)


def aggregate_kpis(frame: DataFrame, kpis) -> DataFrame:
    """Step one: one row that holds the counts and extremes of all ``kpis``."""
    columns = {name: sql for kpi in kpis for name, sql in _aggregates(kpi).items()}
    return frame.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def kpi_row(totals: DataFrame, kpi: Kpi) -> DataFrame:
    """Step two: the one-row table of one KPI."""
    return totals.selectExpr(*[f"{sql} AS {name}" for name, sql in _fields(kpi).items()])


def run_kpi(frame: DataFrame, kpi: Kpi) -> DataFrame:
    return kpi_row(aggregate_kpis(frame, [kpi]), kpi)


def scorecard(totals: DataFrame, kpis) -> DataFrame:
    """Step two in long form: one row per KPI and field, values as text."""
    rows = [
        f"'{kpi.name}', {number}, '{name}', CAST({sql} AS STRING)"
        for kpi in kpis
        for number, (name, sql) in enumerate(_fields(kpi).items(), start=1)
    ]
    return totals.selectExpr(
        f"stack({len(rows)}, {', '.join(rows)}) AS (kpi, field_no, field, value)"
    )


def _aggregates(kpi: Kpi) -> dict[str, str]:
    rows = kpi.rows or "true"
    found = {f"{kpi.name}__total": f"count_if({rows})"} if kpi.total else {}
    for number, share in enumerate(kpi.shares):
        passes = f"count_if({rows} AND {share.passes})"
        if share.null_if_empty:
            passes = f"sum(CASE WHEN {share.passes} THEN 1 ELSE 0 END) FILTER (WHERE {rows})"
        found[f"{kpi.name}__pass{number}"] = passes
        if share.rate_passes:
            found[f"{kpi.name}__rate{number}"] = f"count_if({rows} AND {share.rate_passes})"
    for extra in kpi.extras:
        found[f"{kpi.name}__{extra.name}"] = _extreme(extra, rows)
    return found


def _extreme(extra: Extra, rows: str) -> str:
    if extra.kind == "count_if":
        return f"count_if({rows} AND {extra.of})"
    if extra.kind == "avg":
        # Measures have three places: the sum is exact and only the division rounds, half up.
        total = f"sum(CAST({extra.of} AS DECIMAL(28,3))) FILTER (WHERE {rows})"
        count = f"count({extra.of}) FILTER (WHERE {rows})"
        mean = f"(2000 * abs({total}) + {count}) DIV (2 * nullif({count}, 0))"
        return f"CAST(sign({total}) * CAST({mean} AS DECIMAL(20,0)) AS DECIMAL(20,0)) * 0.001BD"
    function = "min" if extra.kind == "min" else "max"
    return f"{function}({extra.of}) FILTER (WHERE {rows})"


def _fields(kpi: Kpi) -> dict[str, str]:
    total = f"{kpi.name}__total"
    fields = {"item": f"'{kpi.item}'"}
    if kpi.total:
        fields["total"] = total
    for number, share in enumerate(kpi.shares):
        passed = f"{kpi.name}__pass{number}"
        rated = f"{kpi.name}__rate{number}" if share.rate_passes else passed
        rate = percent_text(hundredths(rated, total))
        count_name, rate_name, standard_name, verdict_name = share.names
        fields[count_name] = passed
        fields[rate_name] = f"coalesce({rate}, '{kpi.empty_rate}')"
        fields[standard_name] = f"'{share.standard}'"
        fields[verdict_name] = _verdict(kpi, share, passed, total)
    for extra in kpi.extras:
        held = f"{kpi.name}__{extra.name}"
        if extra.kind == "max_text":
            held = f"concat(CAST({held} AS STRING), '%')"
        elif extra.kind == "max_within":
            # A maximum over nothing is not within the limit.
            held = f"CASE WHEN {held} <= {extra.limit} THEN '{YES}' ELSE '{NO}' END"
        fields[extra.name] = held
    return fields


def _verdict(kpi: Kpi, share: Share, passed: str, total: str) -> str:
    reached, asked = f"100 * {passed}", f"{share.limit} * {total}"
    if share.as_shown:
        reached, asked = hundredths(passed, total), str(100 * share.limit)
    met = f"{reached} <= {asked}" if share.at_most else f"{reached} >= {asked}"
    empty = "NULL" if kpi.empty_verdict is None else f"'{kpi.empty_verdict}'"
    return f"CASE WHEN {total} = 0 THEN {empty} WHEN {met} THEN '{YES}' ELSE '{NO}' END"

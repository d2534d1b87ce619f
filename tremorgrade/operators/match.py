"""Match an alarm log to evaluation windows.

For every window: the first alarm in it, the first alarm over each level, and
the peak value. Both window ends count, so an alarm at the instant where two
windows meet belongs to both.

The match is a range join, written as an equi-join on time cells. A window goes
into the cell size just above its own length, so it touches at most two cells,
and as windows hardly overlap a cell of that size holds at most some eighteen
of them: no cell pairs many windows with many alarms, however uneven the
timetable. An alarm looks into one cell per cell size in use, usually two or
three.

The alarm log is read twice. The first pass reads only the time and the graded
value and keeps, per window, the earliest instants and the peak: plain numbers,
which aggregate in hash tables before any shuffle. The second pass fetches the
rest of the row, and breaks ties by alarm id, for those instants only; so only
these few rows are ever sorted.

With few waves the log is probed where it lies. With many it is shuffled, but
first merged to one row per instant, which is all the first pass needs: an
instant with a third of all alarms is one row. What is still hot, a cell with
many instants or the rows of a wanted instant, Spark measures and splits: both
sides of these joins come straight from a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrade.functions import micros
from tremorgrade.operators.sizing import KeyProfile
from tremorgrade.session import computed_once
from tremorgrade.sources.alarms import between

WINDOW = ["send_time", "next_send_time"]

# Cell size n is 16**n microseconds wide; the largest spans 36,000 years.
_SIZE_BITS = 4
_LARGEST = 15


@dataclass(frozen=True)
class First:
    """The first alarm of a window, or the first whose value reaches ``level``."""

    name: str
    columns: tuple[str, ...]
    level: int | None = None


def match_windows(
    windows: DataFrame,
    alarms: DataFrame,
    alarm_id: str,
    firsts: list[First],
    profile: KeyProfile,
    value: str | None = None,
) -> DataFrame:
    """One row per distinct window that holds an alarm.

    Columns: the two window ends; per ``First`` a struct ``name`` of
    ``jk_time``, the alarm id and the asked columns (null if no alarm reaches
    the level); and ``peak``, the largest ``value``, if ``value`` is given.
    """
    in_range = between(alarms, _instant(profile.first), _instant(profile.last))
    earliest = _earliest(windows, in_range, firsts, profile, value)
    return _fetch(earliest, in_range, alarm_id, firsts, profile, value)


def cell_sizes():
    """Aggregate over windows: a bit for each cell size they need."""
    used = f"CASE WHEN next_send_time >= send_time THEN shiftleft(1, {_size(_length())}) END"
    return F.expr(f"coalesce(bit_or({used}), 0)")


def _earliest(windows, alarms, firsts, profile, value) -> DataFrame:
    """First pass: per window the wanted instants and the peak."""
    if not profile.small:
        alarms = _per_instant(alarms, value)
    kept = ["jk_time", *([value] if value else [])]
    used = profile.cell_sizes
    if used is None:
        used = windows.select(cell_sizes()).first()[0]
    sizes = ", ".join(str(n) for n in range(_LARGEST + 1) if used >> n & 1) or "NULL"
    probes = alarms.selectExpr(*kept, f"explode(array({sizes})) AS _size").selectExpr(
        *kept, f"{_cell_id(_cell(micros('jk_time')))} AS _cell"
    )
    met = _join(probes, _window_cells(windows), "_cell", profile).where(
        "jk_time BETWEEN send_time AND next_send_time"
    )
    aggregates = [F.expr(f"min(jk_time) {_reached(f, value)} AS {f.name}") for f in firsts]
    if value:
        aggregates.append(F.max(value).alias("peak"))
    return met.groupBy(*WINDOW).agg(*aggregates)


def _per_instant(alarms: DataFrame, value: str | None) -> DataFrame:
    """The log merged per instant, before its shuffle already: the peak tells which levels
    are reached."""
    instants = alarms.groupBy("jk_time")
    return instants.agg(F.max(value).alias(value)) if value else instants.agg(F.lit(1)).select("jk_time")


def _fetch(earliest, alarms, alarm_id, firsts, profile, value) -> DataFrame:
    """Second pass: the alarm rows at the wanted instants, smallest id first."""
    kept = [*WINDOW, *(["peak"] if value else [])]
    each = ", ".join(f"'{f.name}', {f.name}" for f in firsts)
    wanted = earliest.selectExpr(*kept, f"stack({len(firsts)}, {each}) AS (_first, jk_time)")
    wanted = wanted.where("jk_time IS NOT NULL")

    needed = {c for f in firsts for c in f.columns} | ({value} if value else set())
    rows = alarms.select("jk_time", alarm_id, *sorted(needed))
    found = _join(rows, wanted if profile.small else computed_once(wanted), "jk_time", profile)
    aggregates = []
    for f in firsts:
        row = ", ".join(["jk_time", alarm_id, *f.columns])
        mine = f"_first = '{f.name}'" + (f" AND {value} >= {f.level}" if f.level else "")
        aggregates.append(F.expr(f"min(struct({row})) FILTER (WHERE {mine}) AS {f.name}"))
    if value:
        aggregates.append(F.max("peak").alias("peak"))
    return found.groupBy(*WINDOW).agg(*aggregates)


def _window_cells(windows: DataFrame) -> DataFrame:
    """Each distinct window in its one or two cells."""
    first, last = _cell(micros("send_time")), _cell(micros("next_send_time"))
    return (
        windows.where("next_send_time >= send_time")
        .select(*WINDOW)
        .distinct()
        .selectExpr(*WINDOW, f"{_size(_length())} AS _size")
        .selectExpr(*WINDOW, "_size", f"explode(sequence({first}, {last})) AS _at")
        .selectExpr(*WINDOW, f"{_cell_id('_at')} AS _cell")
    )


def _length() -> str:
    return f"{micros('next_send_time')} - {micros('send_time')}"


def _size(length: str) -> str:
    """Smallest n with 16**n >= length."""
    cases = " ".join(
        f"WHEN {length} <= {2 ** (_SIZE_BITS * n)} THEN {n}" for n in range(_LARGEST)
    )
    return f"CASE {cases} ELSE {_LARGEST} END"


def _cell(at: str) -> str:
    """Number of the cell of size ``_size`` that holds an instant, also before 1970."""
    return f"shiftright({at}, _size * {_SIZE_BITS})"


def _cell_id(cell: str) -> str:
    """Cell and size in one long, the key type that hash joins handle best."""
    return f"shiftleft({cell}, {_SIZE_BITS}) + _size"


def _reached(first: First, value: str | None) -> str:
    return f"FILTER (WHERE {value} >= {first.level})" if first.level else ""


def _join(alarms, lookup, on, profile) -> DataFrame:
    """Join the log to a key-sized frame without moving the log if that is safe."""
    return alarms.join(F.broadcast(lookup) if profile.small else lookup, on)


def _instant(at) -> str:
    return f"CAST({'NULL' if at is None else repr(str(at))} AS TIMESTAMP_NTZ)"

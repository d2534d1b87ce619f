"""Grade an alarm system: answer key and alarm logs in, tables out."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, Observation

from tremorgrade.operators import by_id, grade
from tremorgrade.operators.match import cell_sizes
from tremorgrade.operators.sizing import KeyProfile, Sizing, profile_key
from tremorgrade.operators.windows import add_windows
from tremorgrade.plans import details as report
from tremorgrade.plans import kpi as kpis
from tremorgrade.session import computed_once

_BY_NAME = {k.name: k for k in (*kpis.KPIS, *kpis.TIMED_KPIS)}


class Evaluation:
    """Tables over one answer key and its P and S alarm logs.

    Tables are lazy but for what is stored on the way. The first one that needs the
    windows counts the waves, which decides between the broadcast and the shuffled plans,
    and computes the windows once, as every match starts from them. The shuffled plans also
    store the instants wanted and the values matched, key-sized frames that joins then read.
    """

    def __init__(
        self,
        key: DataFrame,
        p_alarms: DataFrame,
        s_alarms: DataFrame,
        sizing: Sizing = Sizing(),
    ):
        self.key = key
        self.p_alarms = p_alarms
        self.s_alarms = s_alarms
        self.sizing = sizing

    @cached_property
    def _bounds(self) -> KeyProfile:
        return profile_key(self.key, self.sizing)

    @cached_property
    def windows(self) -> DataFrame:
        """The key with ``next_send_time``."""
        return computed_once(add_windows(self.key, self._bounds).observe(self._seen, cell_sizes().alias("sizes")))

    @cached_property
    def _seen(self) -> Observation:
        """What is seen of the windows while they are written."""
        return Observation()

    @cached_property
    def profile(self) -> KeyProfile:
        """What is known about the key and its windows."""
        self.windows  # noqa: B018
        return replace(self._bounds, cell_sizes=self._seen.get["sizes"] or 0)

    @cached_property
    def graded_p(self) -> DataFrame:
        return grade.grade_p(self.windows, self.p_alarms, self.profile)

    @cached_property
    def graded_s(self) -> DataFrame:
        """Only waves eligible for S alarms."""
        eligible = grade.s_eligible(self.windows)
        return grade.grade_s(eligible, self.s_alarms, self.profile)

    @cached_property
    def graded(self) -> DataFrame:
        """All waves with both kinds of alarms."""
        return grade.grade_s(self.windows, self.s_alarms, self.profile, onto=self.graded_p)

    def answer_key(self) -> DataFrame:
        return self.windows

    def p_matched(self) -> DataFrame:
        return grade.p_matched(self.graded_p)

    def p_compare(self) -> DataFrame:
        return grade.p_compare(self.graded_p)

    def s_matched(self) -> DataFrame:
        return grade.s_matched(self.graded_s)

    def s_compare(self) -> DataFrame:
        return grade.s_compare(self.graded_s)

    def details(self) -> DataFrame:
        return report.details(self.graded)

    def kpi(self, name: str) -> DataFrame:
        """The one-row table of one of the fourteen KPIs."""
        kpi = _BY_NAME[name]
        frames = {"p": "graded_p", "s": "graded_s", "both": "graded"}
        return kpis.run_kpi(getattr(self, frames[kpi.on]), kpi)

    def totals(self) -> DataFrame:
        """One row from which all fourteen KPI tables and the scorecard follow."""
        return kpis.aggregate_kpis(self.graded, kpis.KPIS)

    def scorecard(self) -> DataFrame:
        """All fourteen KPIs from one pass over the graded waves, in long form."""
        return kpis.scorecard(self.totals(), kpis.KPIS)

    def p_by_id(self) -> DataFrame:
        return by_id.p_by_id(self.p_alarms)

    def s_by_id(self) -> DataFrame:
        return by_id.s_by_id(self.s_alarms)

    def p_by_id_in_range(self, start, end) -> DataFrame:
        return by_id.p_by_id_in_range(self.p_alarms, start, end)

    def s_by_id_in_range(self, start, end) -> DataFrame:
        return by_id.s_by_id_in_range(self.s_alarms, start, end)

    def timed_kpi(self, name: str, start, end) -> DataFrame:
        """The one-row table of one of the four KPIs on a time range."""
        return timed_kpi(name, self.p_alarms, self.s_alarms, start, end)

    def tables(self, start=None, end=None) -> dict[str, DataFrame]:
        """Every table by name; those by event id and on a time range only with a range."""
        found = {
            "answer_key": self.answer_key(),
            "p_matched": self.p_matched(),
            "p_compare": self.p_compare(),
            "s_matched": self.s_matched(),
            "s_compare": self.s_compare(),
            "details": self.details(),
            **self.kpi_tables(),
        }
        return found if start is None else found | self.timed_tables(start, end)

    def kpi_tables(self) -> dict[str, DataFrame]:
        """The fourteen KPIs and the scorecard, from one row of totals."""
        totals = self.totals()
        found = {k.name: kpis.kpi_row(totals, k) for k in kpis.KPIS}
        return found | {"scorecard": kpis.scorecard(totals, kpis.KPIS)}

    def timed_tables(self, start, end) -> dict[str, DataFrame]:
        return {
            "p_by_id": self.p_by_id(),
            "s_by_id": self.s_by_id(),
            "p_by_id_in_range": self.p_by_id_in_range(start, end),
            "s_by_id_in_range": self.s_by_id_in_range(start, end),
            **{k.name: self.timed_kpi(k.name, start, end) for k in kpis.TIMED_KPIS},
        }

    def stored(self) -> Evaluation:
        """The same tables for whoever wants many of them: all read stored frames."""
        return StoredEvaluation(self)


class StoredEvaluation(Evaluation):
    """An evaluation whose tables read three stored frames instead of the logs.

    The waves graded for both kinds of alarms, and the first reports per event id of either
    kind, are each computed when a table first needs them and written to the shared folder.
    A log is read three times for all tables together: twice by its match, once by event id.
    """

    def __init__(self, of: Evaluation):
        super().__init__(of.key, of.p_alarms, of.s_alarms, of.sizing)
        self.of = of

    @cached_property
    def windows(self) -> DataFrame:
        return self.of.windows

    @cached_property
    def profile(self) -> KeyProfile:
        return self.of.profile

    @cached_property
    def graded(self) -> DataFrame:
        return computed_once(self.of.graded)

    @property
    def graded_p(self) -> DataFrame:
        return self.graded

    @property
    def graded_s(self) -> DataFrame:
        return self.graded.where("s_eligible")

    @cached_property
    def _totals(self) -> DataFrame:
        return computed_once(super().totals())

    def totals(self) -> DataFrame:
        return self._totals

    @cached_property
    def _p_by_id(self) -> DataFrame:
        return computed_once(self.of.p_by_id())

    @cached_property
    def _s_by_id(self) -> DataFrame:
        return computed_once(self.of.s_by_id())

    def p_by_id(self) -> DataFrame:
        return self._p_by_id

    def s_by_id(self) -> DataFrame:
        return self._s_by_id

    def p_by_id_in_range(self, start, end) -> DataFrame:
        return by_id.in_range(self._p_by_id, start, end)

    def s_by_id_in_range(self, start, end) -> DataFrame:
        return by_id.in_range(self._s_by_id, start, end)

    def timed_kpi(self, name: str, start, end) -> DataFrame:
        kpi = _BY_NAME[name]
        reports = self._p_by_id if kpi.on == "p_by_id" else self._s_by_id
        return kpis.run_kpi(by_id.in_range(reports, start, end), kpi)


def timed_kpi(name: str, p_alarms: DataFrame, s_alarms: DataFrame, start, end) -> DataFrame:
    """A KPI on the first reports per event id; needs no answer key."""
    kpi = _BY_NAME[name]
    if kpi.on == "p_by_id":
        return kpis.run_kpi(by_id.p_by_id_in_range(p_alarms, start, end), kpi)
    if kpi.on == "s_first":
        return kpis.run_kpi(by_id.s_first_in_range(s_alarms, start, end), kpi)
    return kpis.run_kpi(by_id.s_by_id_in_range(s_alarms, start, end), kpi)

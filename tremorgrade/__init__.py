"""Grade an event-alarm system against an answer key, as Spark DataFrames."""

from tremorgrade.operators.sizing import Sizing
from tremorgrade.plans.evaluation import Evaluation, timed_kpi
from tremorgrade.sources.answer_key import read_answer_key
from tremorgrade.sources.cleaning import ingest

__all__ = ["Evaluation", "Sizing", "ingest", "read_answer_key", "timed_kpi"]

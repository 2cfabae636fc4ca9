"""Run listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import q
from tablewright.session import settled

MAX_RUNS = 100
SUCCEEDED = "succeeded"


def latest_state(updates: DataFrame, run: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The merged state of each run: per field, its latest value that was set.

    ``max_by`` over the rows that set a field is combined before the shuffle, so a run
    with very many updates stays cheap.
    """
    at = F.struct(*[q(o) for o in order])
    return updates.groupBy(q(run)).agg(*[
        F.max_by(q(f), F.when(q(f).isNotNull(), at)).alias(f) for f in fields
    ])


def run_history(runs: DataFrame, status: DataFrame, metrics: DataFrame, run: str, added: str, state: str = "status",
                measured: Sequence[str] = ("model_name", "score"), succeeded: str = SUCCEEDED, n: int = MAX_RUNS) -> DataFrame:
    """The newest runs with their status; measures only where the run succeeded.

    The newest runs are picked first: at most ``n``, so the lookups filter by their keys, which
    the scans can push down.
    """
    newest = settled(runs.orderBy(q(added).desc(), q(run).desc()).limit(n))
    keys = [r[run] for r in newest.select(q(run)).collect()]
    known = status.filter(q(run).isin(keys))
    scored = metrics.filter(q(run).isin(keys)).select(q(run), *[q(m) for m in measured])
    joined = newest.join(known, run, "left").join(scored, run, "left")
    shown = [F.when(q(state) == succeeded, q(m)).alias(m) for m in measured]
    return joined.select(q(run), q(added), q(state), *shown).orderBy(q(added).desc(), q(run).desc())

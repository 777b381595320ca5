"""The report over stored sessions, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom import fixed, schemas
from gradeloom.operators import report, rollup
from gradeloom.sources import commits
from gradeloom.sources.store import of_sessions, read_generations, read_scores, read_sessions


def session_report(
    generations: DataFrame,
    scores: DataFrame,
    sessions: DataFrame,
    last: float = fixed.DEFAULT_LAST_SESSIONS,
    all: bool = False,
    session_ids: list[str] | None = None,
    dataset_id: str | None = None,
    by: tuple[str, ...] = ("model",),
    exact: bool = True,
) -> DataFrame:
    """Latest sessions -> their generations -> scores -> one ordered row per model."""
    chosen = report.latest_sessions(sessions, last, all, session_ids)
    kept = of_sessions(generations, session_ids or chosen)
    if dataset_id is not None:
        kept = report.filter_dataset(kept, dataset_id)
    return report.order_report(report.model_report(kept, scores, by, exact))


def stored_report(
    spark: SparkSession, base: str, since_days: float = fixed.DEFAULT_SINCE_DAYS, environment: str | None = None,
    now=None, last: float = fixed.DEFAULT_LAST_SESSIONS, dataset_id: str | None = None,
) -> DataFrame:
    """The report over a store's folders (generations, scores, sessions), reading the chosen sessions' folders alone.

    The chosen sessions are at most `last`, so their ids are read first.
    """
    sessions = read_sessions(spark, f"{base}/sessions", since_days, environment, now)
    chosen = [r["session_id"] for r in report.latest_sessions(sessions, last).collect()]
    kept = read_generations(spark, f"{base}/generations", chosen)
    if dataset_id is not None:
        kept = report.filter_dataset(kept, dataset_id)
    scores = read_scores(spark, f"{base}/scores", session_ids=chosen)
    return report.order_report(report.model_report(kept, scores))


def rolled_report(
    spark: SparkSession, base: str, since_days: float = fixed.DEFAULT_SINCE_DAYS, environment: str | None = None,
    now=None, last: float = fixed.DEFAULT_LAST_SESSIONS, dataset_id: str | None = None, all: bool = False,
    by: tuple[str, ...] = ("model",), exact: bool = True,
) -> DataFrame:
    """The rows of `stored_report` from the kept totals of the sessions (see `rollup`), without their generations.

    With `all`, sessions are joined as a table instead of being listed.
    """
    sessions = read_sessions(spark, f"{base}/sessions", since_days, environment, now)
    chosen = report.latest_sessions(sessions, last, all)
    if not all:
        chosen = [r["session_id"] for r in chosen.collect()]
    kept = rollup.read_rollup(spark, f"{base}/rollup", chosen, dataset_id)
    return report.order_report(rollup.rollup_report(kept, by, exact))


def add_late_scores(spark: SparkSession, base: str, scores: DataFrame, part: str) -> None:
    """Adds scores with their `session_id` to sessions that are stored already, and to their kept totals.

    Reads the generations of these sessions alone; their ids, one per session
    of the scores, are listed first. If it ends half way, the same part again
    puts it right, as it replaces what it added before.
    """
    layout = f"{schemas.SCORES}, session_id string"
    named = scores.where(F.col("session_id").isNotNull())
    ids = [r["session_id"] for r in named.select("session_id").distinct().collect()]
    commits.amend(named, f"{base}/scores", part)
    # As written, so that the scores are evaluated once and both tables have the same.
    written = commits.read(spark, f"{base}/scores", layout, ids, part)
    rollup.add_scores(read_generations(spark, f"{base}/generations", ids), written, f"{base}/rollup", part)

"""Stored generations, scores and sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom import fixed, schemas
from gradeloom.operators.spread import join_unique, salted_join
from gradeloom.sources import commits


def of_sessions(generations: DataFrame, session_ids: DataFrame | list[str] | None) -> DataFrame:
    """Generations of the given sessions.

    A list prunes partitions at planning time. A table is semi-joined with a
    salt, as one session may hold a large share of the generations.
    """
    if session_ids is None:
        return generations
    if isinstance(session_ids, list):
        return generations.where(F.col("session_id").isin(session_ids))
    wanted = session_ids.select("session_id").distinct()
    return salted_join(generations, wanted, ["session_id"], "left_semi", ["observation_id"])


def stored(spark: SparkSession, path: str, layout: str, session_ids: list[str] | None = None) -> DataFrame:
    """Rows of a table, committed (what is seen of it) or appended (all of it), optionally of some sessions."""
    if commits.has_log(spark, path):
        return commits.read(spark, path, layout, session_ids)
    rows = spark.read.schema(layout).parquet(path)
    return rows if session_ids is None else of_sessions(rows, session_ids)


def read_generations(
    spark: SparkSession, path: str, session_ids: DataFrame | list[str] | None = None
) -> DataFrame:
    """Stored generation observations, optionally of some sessions."""
    if isinstance(session_ids, list):
        return stored(spark, path, schemas.GENERATIONS, session_ids)
    return of_sessions(stored(spark, path, schemas.GENERATIONS), session_ids)


def read_scores(
    spark: SparkSession,
    path: str,
    observation_ids: DataFrame | None = None,
    session_ids: DataFrame | list[str] | None = None,
) -> DataFrame:
    """Stored score rows that belong to an observation, optionally to given ones or to given sessions.

    Sessions prune the folders that `write_scores` makes, so that other
    sessions' scores aren't read.
    """
    layout = f"{schemas.SCORES}, session_id string"
    if isinstance(session_ids, list):
        scores = stored(spark, path, layout, session_ids)
    elif session_ids is not None:
        scores = of_sessions(stored(spark, path, layout), session_ids)
    else:
        # Scores that somebody else wrote may come without their sessions.
        scores = stored(spark, path, layout if commits.has_log(spark, path) else schemas.SCORES)
    scores = scores.where(F.col("observation_id").isNotNull()).drop("session_id")
    if observation_ids is None:
        return scores
    wanted = observation_ids.select("observation_id").distinct()
    return join_unique(scores, wanted, "observation_id", "left_semi")


def recent_sessions(
    sessions: DataFrame,
    since_days: float = fixed.DEFAULT_SINCE_DAYS,
    environment: str | None = None,
    now: dt.datetime | None = None,
) -> DataFrame:
    """Sessions created in the last days, optionally of one environment."""
    if since_days != since_days or since_days in (float("inf"), float("-inf")) or since_days < 0:
        since_days = fixed.DEFAULT_SINCE_DAYS
    start = (now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) - dt.timedelta(days=since_days)
    kept = sessions.where(F.col("created_at") >= F.lit(start).cast(sessions.schema["created_at"].dataType))
    return kept if environment is None else kept.where(F.col("environment") == environment)


def read_sessions(
    spark: SparkSession,
    path: str,
    since_days: float = fixed.DEFAULT_SINCE_DAYS,
    environment: str | None = None,
    now: dt.datetime | None = None,
) -> DataFrame:
    return recent_sessions(stored(spark, path, schemas.SESSIONS), since_days, environment, now)

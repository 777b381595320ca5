"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.sources import commits

DEFAULT_PROJECT = "default"


def _write(rows: DataFrame, path: str, attempt: str | None, sessions: DataFrame | None, by_session: bool = True) -> None:
    """Appends, or with an attempt commits, so that the newest attempt at a session replaces the ones before."""
    if attempt is not None:
        commits.commit(rows, path, sessions, attempt, by_session=by_session)
    elif by_session:
        # The hint keeps a session in few files and still splits one that holds most of the rows.
        rows.hint("rebalance", "session_id").write.mode("append").partitionBy("session_id").parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def write_scores(scores: DataFrame, path: str, attempt: str | None = None, sessions: DataFrame | None = None) -> None:
    """Writes score rows, partitioned by session.

    Without an attempt rows are appended. With one, they are a commit (see
    `commits`): written again, they replace what their sessions had, and those
    of `sessions` that have no rows are emptied.
    """
    _write(scores, path, attempt, sessions)


def write_generations(generations: DataFrame, path: str, attempt: str | None = None, sessions: DataFrame | None = None) -> None:
    """Writes generation rows, partitioned by session (see `generations_of`), as `write_scores` does."""
    _write(generations, path, attempt, sessions)


def write_sessions(sessions: DataFrame, path: str, attempt: str | None = None) -> None:
    """Writes session rows, which are few, as `write_scores` does."""
    _write(sessions, path, attempt, None, by_session=False)


def with_projects(df: DataFrame, projects: DataFrame | list[str] | None) -> DataFrame:
    """Every row once per project; one default project where none are given.

    A table of projects stays a table: its names become one array, which every
    row is joined with as a scalar.
    """
    if isinstance(projects, DataFrame):
        named = F.array_compact(F.sort_array(F.collect_set("project")))
        names = projects.agg(named.alias("names")).scalar()
        names = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(DEFAULT_PROJECT)))
    else:
        names = F.array(*[F.lit(p) for p in dict.fromkeys(projects or [DEFAULT_PROJECT])])
    return df.withColumn("project", F.explode(names))


def fan_out(
    df: DataFrame, projects: DataFrame | list[str] | None, base_path: str, mode: str = "append"
) -> None:
    """Writes the same rows to every project, in one job."""
    with_projects(df, projects).write.mode(mode).partitionBy("project").parquet(base_path)


def write_report_json(report: DataFrame, items: DataFrame, sessions: DataFrame, path: str) -> None:
    """The report as JSON: model rows, item rows and session ids, one folder each.

    Item lists are rows of their own: one model may have any number of them.
    """
    report.write.mode("overwrite").json(f"{path}/models")
    items.write.mode("overwrite").json(f"{path}/items")
    sessions.select("session_id").write.mode("overwrite").json(f"{path}/sessions")

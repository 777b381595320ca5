"""Tables that are replaced session by session: a commit log over Parquet folders.

Every commit writes its rows to a folder of its own and is seen only once its
entry stands in the log, so a writer that dies leaves nothing to be seen. A
commit belongs to an attempt at its sessions: parts of one attempt add up, a
part that is committed again replaces itself, and of several attempts at a
session only the one that began last is seen, also where it has no rows.

    path/commit=<id>/session_id=<s>/...   rows
    path/_sessions/commit=<id>/...        the commit's sessions and their attempt
    path/_log/<number>.json               the commit; its number is its place in the order

Readers decide by whole folders wherever they can: the folders of commits that
are seen for all their sessions are scanned as they are, and only commits that
were overtaken for some of their sessions are joined with what is seen of them.
`compact` folds the seen rows of many commits into one, `vacuum` removes folders
that nobody sees any more.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators.spread import join_null_safe
from gradeloom.sources import files

LOG, SESSIONS = "_log", "_sessions"
ENTRY = "number long, commit string, part string, upto long"


def has_log(spark: SparkSession, path: str) -> bool:
    return files.exists(spark, path, LOG)


def commit(
    rows: DataFrame, path: str, sessions: DataFrame | None = None, attempt: str | None = None, part: str = "",
    by_session: bool = True, order: tuple[str, ...] = (),
) -> int:
    """Writes rows and makes them seen in one step; returns the number of the commit.

    `sessions` are all sessions that the commit speaks for, those without rows
    included; without it, the sessions of the rows. Without an attempt the
    commit is one of its own and replaces what its sessions had. `by_session`
    lays out a folder per session, for tables in which a session has many rows,
    its files sorted by `order`, so that filters on these columns skip pages.
    """
    name = uuid.uuid4().hex
    named = _written(rows, f"{path}/commit={name}", sessions, by_session, order)
    return _publish(rows.sparkSession, path, name, named.withColumn("attempt", F.lit(attempt or name)), part, None)


def amend(
    rows: DataFrame, path: str, part: str, sessions: DataFrame | None = None, by_session: bool = True, order: tuple[str, ...] = ()
) -> int:
    """Commits rows as a part of the newest attempt at each session, such as what comes after a run has been stored.

    A session that has no attempt begins one. Where another attempt at a session
    begins meanwhile, the rows belong to the former one and are not seen.
    """
    spark, name = rows.sparkSession, uuid.uuid4().hex
    named = _written(rows, f"{path}/commit={name}", sessions, by_session, order)
    if has_log(spark, path):
        named = join_null_safe(named, _newest(entries(spark, path)), ["session_id"])
    else:
        named = named.withColumn("newest", F.lit(None).cast("string"))
    return _publish(spark, path, name, named.withColumn("attempt", F.coalesce("newest", F.lit(name))), part, None)


def _written(rows: DataFrame, folder: str, sessions: DataFrame | None, by_session: bool, order: tuple[str, ...]) -> DataFrame:
    """Writes a commit's rows; returns the sessions that it speaks for."""
    _write(rows, folder, by_session, order)
    if sessions is None:
        sessions = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    return sessions.select(F.col("session_id").cast("string").alias("session_id")).distinct()


def _write(rows: DataFrame, folder: str, by_session: bool, order: tuple[str, ...]) -> None:
    if not by_session:
        rows.write.parquet(folder)
        return
    spread = rows.hint("rebalance", "session_id")
    if order:
        spread = spread.sortWithinPartitions("session_id", *order)
    spread.write.partitionBy("session_id").parquet(folder)


def _publish(spark: SparkSession, path: str, name: str, sessions: DataFrame, part: str, upto: int | None) -> int:
    sessions.select("session_id", "attempt").write.parquet(f"{path}/{SESSIONS}/commit={name}")
    number = last_number(spark, path) + 1
    # Another writer may take the number first; the entry then goes behind it.
    while not files.create(
        spark, json.dumps({"number": number, "commit": name, "part": part, "upto": upto}), path, LOG, f"{number:020d}.json"
    ):
        number += 1
    return number


def last_number(spark: SparkSession, path: str) -> int:
    taken = [int(n.removesuffix(".json")) for n in files.names(spark, path, LOG) if n.endswith(".json") and n[:-5].isdigit()]
    return max(taken, default=0)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, attempt, commit, part, number, upto) of all commits; half-written entries are none."""
    log = spark.read.schema(ENTRY).json(f"{path}/{LOG}").where("number IS NOT NULL AND commit IS NOT NULL")
    layout = "session_id string, attempt string, commit string"
    return spark.read.schema(layout).parquet(f"{path}/{SESSIONS}").join(log, "commit")


def _newest(known: DataFrame) -> DataFrame:
    """The attempt at each session that began last."""
    attempts = known.groupBy("session_id", "attempt").agg(F.min("number").alias("begun"))
    return attempts.groupBy("session_id").agg(F.max_by("attempt", "begun").alias("newest"))


def seen(spark: SparkSession, path: str, session_ids: list[str] | None = None) -> DataFrame:
    """Entries with `is_seen`: whether the commit's rows of the session count.

    A compaction stands in the order where the last commit stood that it read,
    so commits that came while it ran still count.
    """
    known = entries(spark, path)
    if session_ids is not None:
        known = known.where(F.col("session_id").isin(session_ids))
    place = F.struct(F.coalesce("upto", "number").alias("place"), "number")
    newest = _newest(known)
    parts = known.groupBy("session_id", "attempt", "part").agg(F.max(place).alias("last"))
    marked = join_null_safe(join_null_safe(known, newest, ["session_id"]), parts, ["session_id", "attempt", "part"])
    is_seen = (F.col("attempt") == F.col("newest")) & (F.col("number") == F.col("last.number"))
    return marked.withColumn("is_seen", is_seen).drop("newest", "last")


def read(spark: SparkSession, path: str, layout: str, session_ids: list[str] | None = None, part: str | None = None) -> DataFrame:
    """The seen rows, optionally of some sessions; `layout` names their columns, session_id among them.

    Runs a job over the log when it is called; one row per commit comes back.
    """
    pairs = seen(spark, path, session_ids)
    if part is not None:
        pairs = pairs.where(F.col("part") == part)
    counted = pairs.groupBy("commit").agg(F.count_if("is_seen").alias("n"), F.count("*").alias("of"))
    counts = counted.where("n > 0").collect()
    whole = [r["commit"] for r in counts if r["n"] == r["of"]]
    overtaken = [r["commit"] for r in counts if r["n"] < r["of"]]

    def scan(names: list[str]) -> DataFrame:
        found = _scan(spark, path, layout, names)
        return found if session_ids is None else found.where(F.col("session_id").isin(session_ids))

    nothing = spark.createDataFrame([], layout)
    if not counts:
        return nothing
    kept = scan(whole) if whole else None
    if overtaken:
        shown = pairs.where("is_seen").select("session_id", "commit")
        rest = join_null_safe(scan(overtaken), shown, ["session_id", "commit"], "left_semi")
        kept = rest if kept is None else kept.unionByName(rest)
    return kept.select(*nothing.columns)


def _scan(spark: SparkSession, path: str, layout: str, names: list[str]) -> DataFrame:
    # Commits without rows have no files; their folders are there all the same.
    folders = [f"{path}/commit={c}" for c in names]
    return spark.read.schema(f"{layout}, commit string").option("basePath", path).parquet(*folders)


def of_attempt(spark: SparkSession, path: str, layout: str, attempt: str) -> DataFrame:
    """All rows that an attempt has committed, seen or not."""
    named = entries(spark, path).where((F.col("attempt") == attempt) & F.col("upto").isNull())
    names = [r["commit"] for r in named.select("commit").distinct().collect()]
    return _scan(spark, path, layout, names).drop("commit") if names else spark.createDataFrame([], layout)


def compact(spark: SparkSession, path: str, layout: str, by_session: bool = True, order: tuple[str, ...] = ()) -> int:
    """Folds the seen rows of each part into one commit; returns how many commits it read.

    Parts keep apart, so that one committed again later still replaces itself.
    """
    upto, folded = last_number(spark, path), 0
    shown = seen(spark, path).where("is_seen")
    parts = [r for r in shown.groupBy("part").agg(F.count_distinct("commit").alias("n")).collect() if r["n"] > 1]
    for r in parts:
        name = uuid.uuid4().hex
        rows = read(spark, path, layout, part=r["part"])
        sessions = shown.where(F.col("part") == r["part"]).select("session_id", "attempt")
        _write(rows if by_session else rows.coalesce(1), f"{path}/commit={name}", by_session, order)
        _publish(spark, path, name, sessions, r["part"], upto)
        folded += r["n"]
    return folded


def vacuum(spark: SparkSession, path: str, older_than_hours: float = 168.0) -> list[str]:
    """Removes folders that are not seen and were last changed before that time; returns their commits.

    The time has to be longer than any read or write takes: younger folders may
    belong to a commit under way, or to a reader of an earlier state.
    """
    kept = {r["commit"] for r in seen(spark, path).where("is_seen").select("commit").distinct().collect()}
    limit = time.time() * 1000 - older_than_hours * 3_600_000
    gone = []
    for name, changed in files.names(spark, path).items():
        commit_id = name.removeprefix("commit=")
        if name.startswith("commit=") and commit_id not in kept and changed <= limit:
            files.delete(spark, path, name)
            gone.append(commit_id)
    return sorted(gone)

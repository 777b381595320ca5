"""Runs that are watched while they land: verdicts that come later, sessions that end, progress.

All state is Spark's own and ends with the watermark, but for `progress_now`
without a window, which keeps one small row per session. Every micro-batch
owns a folder `batch_id=<n>` that it overwrites when it is run again; `compact`
folds the folders before a batch into one that readers take in their place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeloom.functions.identity import is_finite
from gradeloom.sources import files

SNAPSHOTS = "_snapshots"
VERDICT, CORRECTION, EXPIRED = "verdict", "correction", "expired"


# --- folders of micro-batches ---------------------------------------------------------------------


def _run(rows: DataFrame, mode: str, path: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        rows.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Batches that were written whole; a batch that died has no success mark and is run again."""
    found = [n.removeprefix("batch_id=") for n in files.names(spark, path) if n.startswith("batch_id=")]
    return sorted(int(n) for n in found if files.exists(spark, path, f"batch_id={n}", "_SUCCESS"))


def _snapshot(spark: SparkSession, path: str) -> int | None:
    """The last batch that the newest whole snapshot holds."""
    found = [n.removeprefix("upto=") for n in files.names(spark, path, SNAPSHOTS) if n.startswith("upto=")]
    return max((int(n) for n in found if files.exists(spark, path, SNAPSHOTS, f"upto={n}", "_SUCCESS")), default=None)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """All rows written so far, with their `batch_id`: the newest snapshot and the batches after it.

    A stream without a whole batch has no columns to read yet, which is an error.
    """
    upto = _snapshot(spark, path)
    after = [b for b in _batches(spark, path) if upto is None or b > upto]
    parts = []
    if upto is not None:
        parts.append(spark.read.parquet(f"{path}/{SNAPSHOTS}/upto={upto}"))
    if after:
        folders = [f"{path}/batch_id={b}" for b in after]
        batches = spark.read.option("basePath", path).parquet(*folders)
        parts.append(batches.withColumn("batch_id", F.col("batch_id").cast("long")))
    if not parts:
        raise ValueError(f"no batch has landed in {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact(spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], keep: int = 1) -> int | None:
    """Folds all but the newest `keep` batches into a snapshot; returns the last batch in it.

    `fold` takes rows with `batch_id` and gives fewer rows of the same columns:
    `newest` or `merged`, by how the stream writes. Readers see the snapshot
    once it is whole. The folders it holds stay until `vacuum`, for readers that
    have begun; a batch that may still be run again is never folded.
    """
    whole = _batches(spark, path)
    upto = whole[-keep - 1] if len(whole) > keep else None
    before = _snapshot(spark, path)
    if upto is None or (before is not None and upto <= before):
        return before
    rows = landed(spark, path).where(F.col("batch_id") <= upto)
    fold(rows).select(rows.columns).write.mode("overwrite").parquet(f"{path}/{SNAPSHOTS}/upto={upto}")
    return upto


def vacuum(spark: SparkSession, path: str) -> None:
    """Removes batches and older snapshots that the newest snapshot holds."""
    upto = _snapshot(spark, path)
    if upto is None:
        return
    for name in files.names(spark, path):
        if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) <= upto:
            files.delete(spark, path, name)
    for name in files.names(spark, path, SNAPSHOTS):
        if int(name.removeprefix("upto=")) < upto:
            files.delete(spark, path, SNAPSHOTS, name)


def newest(by: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    """A fold for streams that write each group anew: the row of the newest batch."""

    def fold(rows: DataFrame) -> DataFrame:
        values = F.struct(*[c for c in rows.columns if c not in by])
        return rows.groupBy(*by).agg(F.max_by(values, "batch_id").alias("_row")).select(*by, "_row.*")

    return fold


# --- verdicts that come after their replies -------------------------------------------------------


def match_verdicts(
    replies: DataFrame, verdicts: DataFrame, key: str = "observation_id", replied: str = "replied_at",
    judged: str = "judged_at", watermark: str = "10 minutes", patience: str = "1 hour",
) -> DataFrame:
    """Replies joined with the verdicts that follow them, as a stream: key, times, score, kind.

    A verdict may come up to `patience` after its reply, before or after it in
    the stream. A reply whose time is up is written once as `expired`, without
    a score, and leaves the state. A verdict without such a reply is written as
    `correction` once no reply can match it any more, so nothing that lands
    within the watermark is lost.
    """
    left = replies.select(F.col(key).alias("_reply"), F.col(replied).alias("replied_at"))
    right = verdicts.select(F.col(key).alias("_verdict"), F.col(judged).alias("judged_at"), F.col("score").cast("double"))
    met = (
        (F.col("_reply") == F.col("_verdict"))
        & (F.col("judged_at") >= F.col("replied_at"))
        & (F.col("judged_at") <= F.col("replied_at") + F.expr(f"INTERVAL {patience}"))
    )
    joined = left.withWatermark("replied_at", watermark).join(right.withWatermark("judged_at", watermark), met, "full")
    kind = F.when(F.col("_verdict").isNull(), EXPIRED).when(F.col("_reply").isNull(), CORRECTION).otherwise(VERDICT)
    return joined.select(
        F.coalesce("_reply", "_verdict").alias(key), "replied_at", "judged_at", "score", kind.alias("kind")
    )


def stream_verdicts(
    replies: DataFrame, verdicts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Writes what `match_verdicts` finds, a folder per micro-batch."""
    return _run(match_verdicts(replies, verdicts, **options), "append", path, checkpoint, trigger)


def latest_verdict(key: str = "observation_id") -> Callable[[DataFrame], DataFrame]:
    """A fold: one row per reply. The verdict judged last stands; any verdict stands over an expiry."""

    def fold(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c != key]
        # Among equal times the order of all values decides, so reruns agree.
        order = F.struct(F.col("kind") != EXPIRED, "judged_at", "score", "kind", "replied_at", "batch_id")
        return rows.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_row")).select(key, "_row.*")

    return fold


def read_verdicts(spark: SparkSession, path: str, key: str = "observation_id") -> DataFrame:
    """The verdict of each reply as of now: key, score (null while there is none), kind."""
    return latest_verdict(key)(landed(spark, path)).select(key, "score", "kind")


# --- sessions that end ----------------------------------------------------------------------------


def _measures(error: str = "error") -> tuple[Column, Column]:
    valid = is_finite(F.col("score")) & F.col(error).isNull()
    return valid, ~is_finite(F.col("score")) & F.col(error).isNull()


def closed_sessions(
    results: DataFrame, by: tuple[str, ...] = ("session_id", "model"), time_column: str = "ts",
    idle: str = "1 hour", watermark: str = "10 minutes",
) -> DataFrame:
    """Totals of each group, given once it has been idle; then its state is gone.

    A group that goes on after it was closed gives another row of totals;
    totals of one group add up.
    """
    scored, unscored = _measures()
    return (
        results.withWatermark(time_column, watermark)
        .groupBy(*by, F.session_window(F.col(time_column), idle).alias("_open"))
        .agg(
            F.count_if(scored).alias("n"),
            F.sum(F.when(scored, F.col("score").cast("double"))).alias("sum_score"),
            F.count_if(unscored).alias("unscored"),
        )
        .select(*by, F.col("_open.start").alias("first_at"), F.col("_open.end").alias("closed_at"), "n", "sum_score", "unscored")
    )


def stream_closed_sessions(
    results: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Writes each session's totals when it ends."""
    return _run(closed_sessions(results, **options), "append", path, checkpoint, trigger)


def merged(by: tuple[str, ...] = ("session_id", "model")) -> Callable[[DataFrame], DataFrame]:
    """A fold for totals that add up."""

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by).agg(
            F.min("first_at").alias("first_at"), F.max("closed_at").alias("closed_at"), F.sum("n").alias("n"),
            F.sum("sum_score").alias("sum_score"), F.sum("unscored").alias("unscored"), F.max("batch_id").alias("batch_id"),
        )

    return fold


def read_closed_sessions(spark: SparkSession, path: str, by: tuple[str, ...] = ("session_id", "model")) -> DataFrame:
    """The leaderboard of ended sessions."""
    totals = merged(by)(landed(spark, path))
    mean = F.when(F.col("n") > 0, F.col("sum_score") / F.col("n"))
    return totals.select(*by, "first_at", "closed_at", "n", mean.alias("mean_score"), "unscored")


# --- progress while replies land ------------------------------------------------------------------


def progress_now(results: DataFrame, time_column: str | None = None, watermark: str | None = None) -> DataFrame:
    """Per session: done, mean time, time left, as of the replies so far; the same for batch and stream.

    `total` is the planned number of pairs. A missing time counts as 0, as in
    `progress`. With a time column and a watermark replies are counted per day,
    and days that are over leave the state.
    """
    rows = results.withWatermark(time_column, watermark) if watermark else results
    day = [F.window(time_column, "1 day").alias("day")] if time_column else []
    counted = rows.groupBy("session_id", *day).agg(
        F.count("*").alias("completed"),
        F.sum(F.coalesce("elapsed_ms", F.lit(0)).cast("long")).alias("sum_ms"),
        F.max("total").cast("long").alias("total"),
    )
    return counted.select("session_id", *(["day"] if day else []), "completed", "sum_ms", "total")


def stream_progress(
    results: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Writes, per micro-batch, the sessions that got replies in it."""
    return _run(progress_now(results, **options), "update", path, checkpoint, trigger)


def read_progress(spark: SparkSession, path: str, daily: bool = False) -> DataFrame:
    """Each session's newest progress: completed, total, remaining, mean_ms, eta_ms."""
    by = ("session_id", "day") if daily else ("session_id",)
    now = newest(by)(landed(spark, path))
    if daily:
        now = now.groupBy("session_id").agg(
            F.sum("completed").alias("completed"), F.sum("sum_ms").alias("sum_ms"), F.max("total").alias("total")
        )
    mean, left = F.col("sum_ms") / F.col("completed"), F.col("total") - F.col("completed")
    return now.select(
        "session_id", "completed", "total", left.alias("remaining"), mean.alias("mean_ms"),
        F.when(left > 0, mean * left).alias("eta_ms"),
    )

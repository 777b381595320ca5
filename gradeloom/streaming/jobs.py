"""Scoring and leaderboards while responses land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeloom.functions.identity import is_finite
from gradeloom.operators.scoring import all_scores
from gradeloom.operators.sinks import fan_out
from gradeloom.streaming import live


def stream_scores(
    responses: DataFrame,
    base_path: str,
    checkpoint: str,
    projects=None,
    schema: dict | None = None,
    schemas: dict[str, dict] | None = None,
    extra=None,
    keys: tuple[str, ...] = ("session_id", "observation_id"),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Scores responses as they arrive and writes them to every project.

    Each micro-batch owns one folder and overwrites it when it is run again, so
    a replayed batch adds no duplicates.
    """
    scored = all_scores(responses, schema, schemas, extra, keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        fan_out(batch, projects, f"{base_path}/batch_id={batch_id}", mode="overwrite")

    return (
        scored.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def leaderboard(results: DataFrame, by: tuple[str, ...] = ("session_id", "model"), window: str | None = None,
                time_column: str = "ts", watermark: str | None = None) -> DataFrame:
    """n, mean score and unscored per group; the same plan for batch and stream.

    With a watermark and a window the state of old windows is dropped.
    """
    scored = is_finite(F.col("score")) & F.col("error").isNull()
    unscored = ~is_finite(F.col("score")) & F.col("error").isNull()
    source = results.withWatermark(time_column, watermark) if watermark else results
    groups = [*by, *([F.window(time_column, window)] if window else [])]
    return source.groupBy(*groups).agg(
        F.count_if(scored).alias("n"),
        F.avg(F.when(scored, F.col("score"))).alias("mean_score"),
        F.count_if(unscored).alias("unscored"),
    )


def stream_leaderboard(
    results: DataFrame,
    path: str,
    checkpoint: str,
    by: tuple[str, ...] = ("session_id", "model"),
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Live leaderboard: each micro-batch writes the rows it changed to its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        leaderboard(results, by, **options)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_leaderboard(spark: SparkSession, path: str, by: tuple[str, ...] = ("session_id", "model")) -> DataFrame:
    """Current leaderboard: the newest written row of each group.

    Reads the newest snapshot and the batches after it; `compact_leaderboard` makes one.
    """
    return live.newest(by)(live.landed(spark, path)).drop("batch_id")


def compact_leaderboard(spark: SparkSession, path: str, by: tuple[str, ...] = ("session_id", "model")) -> None:
    """Folds written batches, so that readers and the folder grow with the groups and not with the batches."""
    live.compact(spark, path, live.newest(by))
    live.vacuum(spark, path)

"""Run summaries over a results table: one row per (session, model, provider, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.identity import is_finite
from gradeloom.operators.spread import join_null_safe

GROUP = ("model", "provider")


def _scored() -> Column:
    return is_finite(F.col("score"))


def result_status(results: DataFrame) -> DataFrame:
    """Adds `status` (ERROR / UNSCORED / SCORED) and its summary text."""
    status = F.when(F.col("error").isNotNull(), "ERROR").when(~_scored(), "UNSCORED").otherwise("SCORED")
    score_text = F.when(F.col("score") == F.floor("score"), F.col("score").cast("long").cast("string")).otherwise(
        F.col("score").cast("string")
    )
    reasoning = F.coalesce(F.col("reasoning"), F.lit(""))
    text = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR - "), F.col("error")))
        .when(~_scored(), F.concat(F.lit("UNSCORED - "), reasoning))
        .otherwise(F.concat(F.lit("score="), score_text, F.lit("/5 - "), reasoning))
    )
    return results.withColumns({"status": status, "summary": text})


def classify_errors(failures: DataFrame, message: str = "message") -> DataFrame:
    """Adds `fatal`: the message carries a credentials status (401 or 403)."""
    return failures.withColumn("fatal", F.coalesce(F.col(message).rlike(r"\((401|403)\b"), F.lit(False)))


def avg_score_by_model(results: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Mean judge score and its count; failed and unscored results are left out."""
    return (
        results.where(F.col("error").isNull() & _scored())
        .groupBy(*by)
        .agg(F.avg("score").alias("avg_score"), F.count("*").alias("n"))
    )


def unscored_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("error").isNull() & ~_scored()).alias("unscored"))


def schema_validity_by_model(results: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Responses that conform and responses that were checked; models without any are left out.

    Counted by condition: a filter on the value would be moved below the scoring
    and make it run twice.
    """
    return (
        results.where(F.col("error").isNull())
        .groupBy(*by)
        .agg(F.count_if(F.col("schema_value") == 1).alias("passed"), F.count("schema_value").alias("total"))
        .where(F.col("total") > 0)
    )


def schema_failures(results: DataFrame) -> DataFrame:
    """The checked responses that do not conform, with the reason."""
    return results.where(
        F.col("error").isNull() & F.col("schema_value").isNotNull() & (F.col("schema_value") != 1)
    ).select("model", "provider", "item_id", "schema_comment")


def truncated_results(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNull() & F.coalesce(F.col("truncated"), F.lit(False)))


def _timing_aggregates() -> list[Column]:
    return [
        F.sum("elapsed_ms").alias("total_ms"),
        F.max("elapsed_ms").alias("slowest_ms"),
        F.sum(F.coalesce(F.col("tokens_in"), F.lit(0))).alias("tokens_in"),
        F.sum(F.coalesce(F.col("tokens_out"), F.lit(0))).alias("tokens_out"),
        F.count("*").alias("n"),
    ]


def timing_by_model(results: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Time and tokens per model; failed results count, untimed ones do not."""
    return results.where(F.col("elapsed_ms").isNotNull()).groupBy(*by).agg(*_timing_aggregates())


def timing_with_total(results: DataFrame) -> DataFrame:
    """`timing_by_model` plus an `ALL` row of wall time, output tokens and items.

    The total rolls up the per-model rows, not the results. `ALL` counts every
    result, timed or not.
    """
    timed = F.col("elapsed_ms").isNotNull()
    per_model = results.groupBy(*GROUP).agg(
        F.sum("elapsed_ms").alias("total_ms"),
        F.max("elapsed_ms").alias("slowest_ms"),
        F.sum(F.when(timed, F.coalesce(F.col("tokens_in"), F.lit(0)))).alias("tokens_in"),
        F.sum(F.when(timed, F.coalesce(F.col("tokens_out"), F.lit(0)))).alias("tokens_out"),
        F.count_if(timed).alias("timed"),
        F.count("*").alias("n"),
        F.min("started_ms").alias("start"),
        F.max(F.col("started_ms") + F.coalesce(F.col("elapsed_ms"), F.lit(0))).alias("end"),
    )
    is_total = F.grouping("model") == 1
    return (
        per_model.groupingSets([["model", "provider"], []], "model", "provider")
        .agg(
            is_total.alias("is_total"),
            F.sum("total_ms").alias("sum_ms"),
            F.max("slowest_ms").alias("slowest_ms"),
            F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
            F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
            F.sum("timed").alias("timed"),
            F.sum("n").alias("items"),
            (F.max("end") - F.min("start")).alias("wall_ms"),
        )
        .where(F.col("is_total") | (F.col("timed") > 0))
        .select(
            F.when(F.col("is_total"), F.lit("ALL")).otherwise(F.col("model")).alias("model"),
            "provider",
            F.when(F.col("is_total"), F.col("wall_ms")).otherwise(F.col("sum_ms")).alias("total_ms"),
            "slowest_ms",
            "tokens_in",
            "tokens_out",
            F.when(F.col("is_total"), F.col("items")).otherwise(F.col("timed")).alias("n"),
        )
    )


def slowest_fastest(timing: DataFrame) -> DataFrame:
    """Models with the largest and smallest total time; no row for a single model."""
    name = F.struct("model", "provider")
    slowest = F.min_by(name, F.struct(-F.col("total_ms"), F.col("model"), F.col("provider")))
    fastest = F.min_by(name, F.struct(F.col("total_ms"), F.col("model"), F.col("provider")))
    return (
        timing.agg(
            slowest.alias("s"),
            F.max("total_ms").alias("slowest_ms"),
            fastest.alias("f"),
            F.min("total_ms").alias("fastest_ms"),
            F.count("*").alias("models"),
        )
        .where("models > 1")
        .select(
            F.col("s.model").alias("slowest_model"),
            F.col("s.provider").alias("slowest_provider"),
            "slowest_ms",
            F.col("f.model").alias("fastest_model"),
            F.col("f.provider").alias("fastest_provider"),
            "fastest_ms",
        )
    )


def progress(results: DataFrame, chunk: int = 65536) -> DataFrame:
    """After each finished pair: done, remaining, running mean time, time left.

    `position` is the 1-based place in the session, `total` the planned number of
    pairs; without that column it is the number of results. A session may be a third of
    all rows, so the running sums are made in two steps: totals per chunk of
    positions, then sums inside each chunk on top of those before it.
    """
    timed = results.withColumns(
        {
            "_chunk": F.floor((F.col("position") - 1) / chunk),
            "_ms": F.coalesce(F.col("elapsed_ms"), F.lit(0)).cast("long"),
        }
    )
    chunks = timed.groupBy("session_id", "_chunk").agg(
        F.sum("_ms").alias("_sum"), F.count("*").alias("_count")
    )
    session = Window.partitionBy("session_id")
    earlier = session.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(
        "session_id",
        "_chunk",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_count_before"),
        F.sum("_count").over(session).alias("_count_all"),
    )
    inside = (
        Window.partitionBy("session_id", "_chunk")
        .orderBy("position")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        timed.withColumns({"_sum_in": F.sum("_ms").over(inside), "_count_in": F.count("*").over(inside)})
        .transform(lambda df: join_null_safe(df, before, ["session_id", "_chunk"], "inner"))
        .withColumn("completed", F.col("_count_before") + F.col("_count_in"))
        .withColumn("mean_ms", (F.col("_sum_before") + F.col("_sum_in")) / F.col("completed"))
        .withColumn("total", F.col("total") if "total" in results.columns else F.col("_count_all"))
        .withColumn("remaining", F.col("total") - F.col("completed"))
    )
    return placed.select(
        *[c for c in results.columns if c != "total"],
        "completed",
        "total",
        "remaining",
        "mean_ms",
        F.when(F.col("remaining") > 0, F.col("mean_ms") * F.col("remaining")).alias("eta_ms"),
    )

"""Reading results back: generations and scores to a per-model report."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.functions import identity
from gradeloom.operators.quantiles import approx_quantiles, exact_quantiles
from gradeloom.operators.spread import join_null_safe, join_unique

LATENCY_QUANTILES = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95}

# Totals of `scores_by_observation` that add up over observations.
SCORE_TOTALS = ["judge_sum", "judge_n", "unscored", "schema_pass", "schema_total", "truncated"]


def _score_aggregates() -> list:
    value = F.col("value_num")
    is_judge = (F.col("name") == fixed.JUDGE_SCORE) & value.isNotNull()
    is_schema = F.col("name") == fixed.SCHEMA_SCORE
    is_cut = F.col("name") == fixed.TRUNCATION_SCORE
    return [
        F.sum(F.when(is_judge, value)).alias("judge_sum"),
        F.count_if(is_judge).alias("judge_n"),
        F.min(F.when(is_judge, value)).alias("judge_min"),
        F.max(F.when(is_judge, value)).alias("judge_max"),
        F.count_if(F.col("name") == fixed.JUDGE_ERROR).alias("unscored"),
        F.count_if(is_schema & (value == 1)).alias("schema_pass"),
        F.count_if(is_schema).alias("schema_total"),
        F.count_if(is_cut & (value == 1)).alias("truncated"),
    ]


def scores_by_observation(scores: DataFrame) -> DataFrame:
    """Score rows folded to one row per observation; rows without an id are dropped."""
    return (
        scores.where(F.col("observation_id").isNotNull())
        .groupBy("observation_id")
        .agg(*_score_aggregates())
    )


def join_scores(generations: DataFrame, scores: DataFrame) -> DataFrame:
    """Every generation with its score totals; counts are 0 where it has none.

    Scores are folded before the join, so the row count stays that of the
    generations and a much-scored observation is reduced map-side. Copies of one
    generation are joined apart (see `join_unique`).
    """
    return join_score_totals(generations, scores_by_observation(scores))


def join_score_totals(generations: DataFrame, totals: DataFrame) -> DataFrame:
    """`join_scores` with scores that are folded already, one row per observation.

    Where both lie in equally many buckets of the id (see `bucketed`), the join
    needs no shuffle.
    """
    joined = join_unique(generations, totals, "observation_id", "left")
    counts = ["judge_n", "unscored", "schema_pass", "schema_total", "truncated"]
    return joined.fillna(0, subset=counts)


def filter_dataset(generations: DataFrame, dataset_id: str) -> DataFrame:
    """Generations tagged with the dataset; no tags means no match."""
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    return generations.where(F.array_contains(tags, f"{fixed.DATASET_TAG}{dataset_id}"))


def latest_sessions(
    sessions: DataFrame,
    last: float = fixed.DEFAULT_LAST_SESSIONS,
    all: bool = False,
    session_ids: list[str] | None = None,
) -> DataFrame:
    """Newest evaluation sessions first; explicit ids bypass the discovery."""
    if session_ids:
        ids = F.explode(F.array(*[F.lit(s) for s in session_ids])).alias("session_id")
        return sessions.sparkSession.range(1).select(ids)
    if not math.isfinite(last) or last <= 0:
        last = fixed.DEFAULT_LAST_SESSIONS
    found = sessions.where(F.col("session_id").startswith(fixed.SESSION_PREFIX))
    ordered = found.orderBy(F.col("created_at").desc(), "session_id")
    return ordered if all else ordered.limit(int(last))


def named_generations(generations: DataFrame) -> DataFrame:
    """Adds what the report groups by: model, item, provider, latency in ms."""
    trace = F.col("trace_name")
    return generations.withColumns(
        {
            "model": identity.resolve_model_name(F.col("model"), trace),
            "item_id": identity.resolve_item_id(trace),
            "provider": identity.provider_from_tags(F.col("tags")),
            "latency_ms": identity.sec_to_ms(F.col("latency")),
        }
    )


def report_items(generations: DataFrame) -> DataFrame:
    """The report's item lists in long form: one row per generation."""
    return named_generations(generations).select("model", "item_id", "latency_ms")


def generation_totals() -> list:
    """Sums of named generations that add up over groups."""
    return [
        F.count("*").alias("n"),
        F.sum("latency_ms").alias("latency_sum"),
        F.count("latency_ms").alias("latency_n"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("total_cost").alias("cost"),
        F.min("start_time").alias("first_time"),
    ]


def totals_by(per_provider: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by provider folded to one row per group.

    The "first seen" provider is that of the earliest tagged generation.
    """
    first_provider = F.min_by(
        "provider", F.when(F.col("provider").isNotNull(), F.struct("first_time", "provider"))
    )
    return per_provider.groupBy(*keys).agg(
        *([first_provider.alias("provider")] if "provider" not in keys else []),
        F.sum("n").alias("n"),
        (F.sum("latency_sum") / F.nullif(F.sum("latency_n"), F.lit(0))).alias("latency_mean_ms"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
    )


def score_sums() -> list:
    """Sums of folded scores that add up over groups."""
    return [
        *[F.sum(c).alias(c) for c in SCORE_TOTALS],
        F.min("judge_min").alias("judge_min"),
        F.max("judge_max").alias("judge_max"),
    ]


def scores_by(named: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Score totals per group of named generations; only ids and keys meet the folded scores."""
    folded = scores_by_observation(scores)
    return named.select("observation_id", *keys).join(folded, "observation_id").groupBy(*keys).agg(*score_sums())


def assembled(totals: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """The report's columns from totals of generations and scores, and quantiles, per group."""
    joined = join_null_safe(totals, quantiles, keys)
    counts = ["judge_n", "unscored", "schema_pass", "schema_total", "truncated"]
    return joined.fillna(0, subset=counts).select(
        *keys,
        *([c for c in ["provider"] if c not in keys]),
        "n",
        F.when(F.col("judge_n") > 0, F.col("judge_sum") / F.col("judge_n")).alias("judge_avg"),
        "judge_min",
        "judge_max",
        "judge_n",
        "unscored",
        "schema_pass",
        "schema_total",
        "truncated",
        "latency_mean_ms",
        *LATENCY_QUANTILES,
        "tokens_in",
        "tokens_out",
        "cost",
    )


def model_report(
    generations: DataFrame,
    scores: DataFrame,
    by: tuple[str, ...] = ("model",),
    exact: bool = True,
) -> DataFrame:
    """One row per model over stored generations and scores.

    Generations are counted and summed without any join. Only `(id, group)`
    pairs meet the folded scores, so that join shuffles two narrow columns; ids
    are unique here, so no key of it is hot. Groups by model name alone unless
    `by` also names the provider. A sketch job runs when this is called (see
    `exact_quantiles`).
    """
    keys = list(by)
    named = named_generations(generations)

    # Folded by provider as well, so that the big pass only keeps numbers per
    # group; the provider is then picked among a few rows per model.
    per_provider = named.groupBy(*dict.fromkeys([*keys, "provider"])).agg(*generation_totals())
    base = totals_by(per_provider, keys)

    scored = scores_by(named, scores, keys)
    quantiles = (exact_quantiles if exact else approx_quantiles)(
        named, keys, "latency_ms", LATENCY_QUANTILES
    )

    return assembled(join_null_safe(base, scored, keys), quantiles, keys)


def order_report(report: DataFrame) -> DataFrame:
    """Best judge average first (none counts as -1), then most generations, then name."""
    return report.orderBy(
        F.coalesce(F.col("judge_avg"), F.lit(-1.0)).desc(), F.col("n").desc(), F.col("model")
    )


def best_models(report: DataFrame) -> DataFrame:
    """Models within the tie margin of the highest judge average, with a tie flag."""
    every = Window.partitionBy(F.lit(0))  # one row per model, so this stays small
    best = report.select("model", "judge_avg", "judge_n", F.max("judge_avg").over(every).alias("_best"))
    close = best.where(F.abs(F.col("judge_avg") - F.col("_best")) < fixed.TIE_MARGIN)
    return close.select("model", "judge_avg", "judge_n", (F.count("*").over(every) > 1).alias("tie"))


def fastest_model(report: DataFrame) -> DataFrame:
    """Smallest median latency; the earlier model in report order wins a tie."""
    rank = F.struct(
        F.col("latency_p50_ms"),
        -F.coalesce(F.col("judge_avg"), F.lit(-1.0)),
        -F.col("n"),
        F.col("model"),
    )
    timed = report.where(F.col("latency_p50_ms").isNotNull())
    return timed.agg(
        F.min_by("model", rank).alias("model"), F.min("latency_p50_ms").alias("latency_p50_ms")
    ).where(F.col("model").isNotNull())


def unscored_total(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.sum("unscored"), F.lit(0)).alias("unscored"))

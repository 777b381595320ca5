"""Kept totals: what the report needs of each session, so that it reads no generations.

A session's rows are partial sums that add up, in whatever parts they come:

- `totals`: sums of generations and of scores per model, provider and datasets.
  Scores that land later add rows of their own.
- `buckets`: how many latencies fall in each bucket of a fixed logarithmic
  scale. Counts of fixed buckets add up exactly, whoever made them.
- `values`: the latencies themselves with their counts, sorted by bucket.

Quantiles find the wanted ranks in the counts of `buckets` and then read those
buckets of `values` alone; the approximate ones stop at the counts. All three
kinds are in one table and come in one commit, so a session's report never mixes
two states of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.operators import report
from gradeloom.operators.quantiles import wanted_parts, within_parts
from gradeloom.operators.spread import join_null_safe, salted_join
from gradeloom.sources import commits

LAYOUT = (
    "session_id string, kind string, model string, provider string, datasets array<string>, "
    "bucket int, value double, count bigint, "
    "n bigint, latency_sum double, latency_n bigint, tokens_in bigint, tokens_out bigint, cost double, "
    "first_time timestamp, judge_sum double, judge_n bigint, unscored bigint, schema_pass bigint, "
    "schema_total bigint, truncated bigint, judge_min double, judge_max double"
)
GROUP = ["session_id", "model", "provider", "datasets"]
TOTALS, BUCKETS, VALUES = "totals", "buckets", "values"
ORDER = ("kind", "bucket", "value")
RUN = "run"

# Buckets per factor e of the scale: neighbours are 0.4 % apart.
STEPS = 256
# Logarithms of doubles lie between -745 and 710; bucket numbers of positive values begin at 1.
OFFSET, HIGHEST = 746 * STEPS, 710 * STEPS
# Ranges of buckets in one filter. More wanted ranges than that are joined across their narrowest gaps.
RANGES = 32


def bucket_of(value: Column) -> Column:
    """The bucket of a number: ascending with it, mirrored below 0, and 0 at 0."""
    step = F.least(F.floor(F.ln(F.abs(value)) * STEPS), F.lit(HIGHEST)) + OFFSET
    return F.when(value == 0, 0).otherwise(F.signum(value) * step).cast("int")


def middle_of(bucket: Column) -> Column:
    """A number in the middle of the bucket."""
    size = F.exp((F.abs(bucket) - OFFSET + F.lit(0.5)) / STEPS)
    return F.when(bucket == 0, 0.0).otherwise(F.signum(bucket) * size)


def _named(generations: DataFrame) -> DataFrame:
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    datasets = F.array_sort(F.array_distinct(F.filter(tags, lambda t: t.startswith(fixed.DATASET_TAG))))
    return report.named_generations(generations).withColumn("datasets", datasets)


def _laid_out(rows: DataFrame) -> DataFrame:
    """The rows in the table's layout; columns that they lack are null."""
    spark = rows.sparkSession
    return spark.createDataFrame([], LAYOUT).unionByName(rows, allowMissingColumns=True)


def generation_partials(generations: DataFrame) -> DataFrame:
    """Totals, bucket counts and values of generations: three levels of one aggregation, so they are read once."""
    latency = F.when(~F.isnan("latency_ms"), F.col("latency_ms"))
    named = _named(generations).withColumns({"value": latency, "bucket": bucket_of(latency)})
    levels = [GROUP, [*GROUP, "bucket"], [*GROUP, "bucket", "value"]]
    folded = named.groupingSets(levels, *GROUP, "bucket", "value").agg(
        F.grouping_id().alias("level"), *report.generation_totals()
    )
    kinds = F.element_at(F.array(F.lit(VALUES), F.lit(BUCKETS), F.lit(None), F.lit(TOTALS)), (F.col("level") + 1).cast("int"))
    is_total = F.col("kind") == TOTALS
    sums = ["latency_sum", "latency_n", "tokens_in", "tokens_out", "cost", "first_time"]
    return (
        folded.withColumn("kind", kinds)
        # Generations without a latency count in the totals alone.
        .where(is_total | F.col("bucket").isNotNull())
        .withColumns({"count": F.when(~is_total, F.col("n")), **{c: F.when(is_total, F.col(c)) for c in sums}})
        .withColumn("n", F.when(is_total, F.col("n")))
        .drop("level")
    )


def score_partials(generations: DataFrame, scores: DataFrame) -> DataFrame:
    """Totals of scores per group of the generations that they belong to; scores of no generation are left out."""
    return report.scores_by(_named(generations), scores, GROUP).withColumn("kind", F.lit(TOTALS))


def write_rollup(
    generations: DataFrame, scores: DataFrame, path: str, attempt: str | None = None, sessions: DataFrame | None = None
) -> int:
    """Keeps the totals of sessions, in place of what was kept of them before; see `commits.commit`."""
    rows = generation_partials(generations).unionByName(score_partials(generations, scores), allowMissingColumns=True)
    return commits.commit(_laid_out(rows), path, sessions, attempt, RUN, order=ORDER)


def add_scores(generations: DataFrame, scores: DataFrame, path: str, part: str) -> int:
    """Adds scores that came after their session's totals were written.

    Needs the generations of these sessions alone. The same part again replaces
    what it added; another attempt at a session does away with it.
    """
    if part == RUN:
        raise ValueError(f"the part {RUN!r} is that of the totals themselves")
    sessions = generations.select("session_id")
    return commits.amend(_laid_out(score_partials(generations, scores)), path, part, sessions, order=ORDER)


def read_rollup(
    spark: SparkSession, path: str, session_ids: DataFrame | list[str] | None = None, dataset_id: str | None = None
) -> DataFrame:
    """Kept rows, optionally of some sessions (a list prunes folders) and of one dataset."""
    rows = commits.read(spark, path, LAYOUT, session_ids if isinstance(session_ids, list) else None)
    if isinstance(session_ids, DataFrame):
        wanted = session_ids.select("session_id").distinct()
        rows = salted_join(rows, wanted, ["session_id"], "left_semi", ["model", "bucket", "value"])
    if dataset_id is not None:
        rows = rows.where(F.array_contains("datasets", f"{fixed.DATASET_TAG}{dataset_id}"))
    return rows


def compact_rollup(spark: SparkSession, path: str) -> int:
    return commits.compact(spark, path, LAYOUT, order=ORDER)


def ranges_of(buckets: list[int], limit: int = RANGES) -> list[tuple[int, int]]:
    """Ascending numbers as at most `limit` ranges that hold them all, joined across the narrowest gaps."""
    gaps = sorted(range(1, len(buckets)), key=lambda i: buckets[i - 1] - buckets[i])
    cuts = sorted(i for i in gaps[: limit - 1] if buckets[i] - buckets[i - 1] > 1)
    begins, ends = [0, *cuts], [*cuts, len(buckets)]
    return [(buckets[b], buckets[e - 1]) for b, e in zip(begins, ends, strict=True)] if buckets else []


def rolled_quantiles(rolled: DataFrame, by: list[str], wanted: dict[str, float], exact: bool = True) -> DataFrame:
    """One row per group with a column per entry of `wanted`, from kept rows.

    Exact, it runs a job over the bucket counts when it is called, which returns
    the distinct wanted buckets: at most two per group and quantile, and no more
    than the scale has. The filter then skips what lies outside of them;
    not exact, a quantile is the middle of its bucket, 0.2 % off at most.
    """
    counted = (
        rolled.where(F.col("kind") == BUCKETS)
        .groupBy(*by, F.col("bucket").alias("_bucket"))
        .agg(F.sum("count").alias("_c"))
    )
    targets = wanted_parts(counted, by, wanted)
    if not exact:
        parts = counted.select(*by, "_bucket", middle_of(F.col("_bucket")).alias("_v"), "_c")
        return within_parts(parts, targets, by, wanted, F.sum("_c"))
    found = [r["_bucket"] for r in targets.select("_bucket").distinct().orderBy("_bucket").collect()]
    inside = reduce(lambda a, b: a | b, [F.col("bucket").between(*r) for r in ranges_of(found)], F.lit(False))
    values = rolled.where((F.col("kind") == VALUES) & inside)
    parts = values.select(*by, F.col("bucket").alias("_bucket"), F.col("value").alias("_v"), "count")
    return within_parts(parts, targets, by, wanted, F.sum("count"))


def rollup_report(rolled: DataFrame, by: tuple[str, ...] = ("model",), exact: bool = True) -> DataFrame:
    """The rows of `model_report`, from kept rows."""
    keys = list(by)
    totals = rolled.where(F.col("kind") == TOTALS)
    sums = [F.sum(c).alias(c) for c in ["n", "latency_sum", "latency_n", "tokens_in", "tokens_out", "cost"]]
    per_provider = totals.groupBy(*dict.fromkeys([*keys, "provider"])).agg(*sums, F.min("first_time").alias("first_time"))
    scored = totals.groupBy(*keys).agg(*report.score_sums())
    quantiles = rolled_quantiles(rolled, keys, report.LATENCY_QUANTILES, exact)
    return report.assembled(join_null_safe(report.totals_by(per_provider, keys), scored, keys), quantiles, keys)

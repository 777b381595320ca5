"""Exact, linearly interpolated quantiles per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.operators.spread import broadcast_bytes, constant_array, join_null_safe, partitions, with_count_below

# Bytes that a group's wanted buckets take in a broadcast, for each wanted quantile: two rows at most.
GROUP_BYTES = 256


def _low(q: float) -> Column:
    return F.floor((F.col("_n") - 1) * F.lit(float(q)))


def _high(q: float) -> Column:
    return F.ceil((F.col("_n") - 1) * F.lit(float(q)))


def _within(rank: Column, start: Column, end: Column) -> Column:
    return (rank >= start) & (rank < end)


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, wanted: dict[str, float], buckets: int | None = None
) -> DataFrame:
    """One row per group with a column per entry of `wanted` (name -> quantile).

    The built-in exact percentile keeps all distinct values of a group in one
    buffer. Here the value range is cut into `buckets` even parts, the parts are
    counted per group, and only those that hold a wanted rank are shuffled and
    sorted, each part in its own task. No task sorts more than about 1/buckets
    of the distinct values of the whole table, however large one group is. There
    are as many parts as the session has partitions, and 256 at least.

    Cutting the range runs a job when this is called; it returns `buckets`
    numbers and the rough number of groups, which says whether the wanted parts
    are small enough to broadcast by the session's own limit.
    """
    buckets = buckets or max(256, partitions(df))
    present = df.select(*by, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    cuts = [i / buckets for i in range(1, buckets)]
    sketch = present.agg(
        F.percentile_approx("_v", cuts, 8 * buckets), F.approx_count_distinct(F.struct(*by))
    ).first()
    bounds = constant_array(sketch[0] or [], T.DoubleType())
    marked = with_count_below(present, "_v", bounds, buckets - 1, "_bucket")
    counted = marked.groupBy(*by, "_bucket").agg(F.count("*").alias("_c"))
    targets = wanted_parts(counted, by, wanted)
    if sketch[1] * GROUP_BYTES * len(wanted) <= broadcast_bytes(df):
        targets = F.broadcast(targets)
    return within_parts(marked, targets, by, wanted, F.count("*"))


def wanted_parts(counted: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """The parts (`_bucket`) of each group that hold a wanted rank, with the group's values and those before the part.

    `counted` has one row per group and part, with the part's values as `_c`.
    """
    group = Window.partitionBy(*by)
    # One row per group and part, so a window partition has as many rows as there are parts.
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select(
        *by,
        "_bucket",
        "_c",
        F.sum("_c").over(group).alias("_n"),
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
    )
    holds_a_rank = F.lit(False)
    for q in wanted.values():
        for rank in (_low(q), _high(q)):
            holds_a_rank = holds_a_rank | _within(rank, F.col("_before"), F.col("_before") + F.col("_c"))
    return placed.where(holds_a_rank).select(*by, "_bucket", "_n", "_before")


def within_parts(
    valued: DataFrame, targets: DataFrame, by: list[str], wanted: dict[str, float], weight: Column
) -> DataFrame:
    """The quantiles from the values (`_v`) in the wanted parts; `weight` aggregates how often a value is there.

    Only the wanted parts are left by the join; equal values are merged before they are shuffled.
    """
    keys = [*by, "_bucket", "_n", "_before", "_v"]
    merged = (
        join_null_safe(valued, targets, [*by, "_bucket"], "inner")
        .groupBy(*keys)
        .agg(weight.alias("_w"))
    )
    ordered = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("_end", F.col("_before") + F.sum("_w").over(ordered))
    start = F.col("_end") - F.col("_w")

    picks = [F.max("_n").alias("_n")]
    for i, q in enumerate(wanted.values()):
        for side, rank in (("lo", _low(q)), ("hi", _high(q))):
            picks.append(
                F.max(F.when(_within(rank, start, F.col("_end")), F.col("_v"))).alias(f"_{side}{i}")
            )
    return _between(ranked.groupBy(*by).agg(*picks), by, wanted)


def _between(picked: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    columns = []
    for i, (name, q) in enumerate(wanted.items()):
        fraction = (F.col("_n") - 1) * F.lit(float(q)) - _low(q)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        columns.append((low + (high - low) * fraction).alias(name))
    return picked.select(*by, *columns)


def approx_quantiles(
    df: DataFrame, by: list[str], value: str, wanted: dict[str, float], accuracy: int = 10000
) -> DataFrame:
    """The same columns from a bounded sketch: one pass, rank error 1/accuracy."""
    return df.groupBy(*by).agg(
        *[F.percentile_approx(value, q, accuracy).cast("double").alias(name) for name, q in wanted.items()]
    )

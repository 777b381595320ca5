"""Joins and orderings that keep one hot key from landing in one task."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.session import scratch_path


def salted_join(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str,
    salt_by: list[str],
    salts: int | None = None,
) -> DataFrame:
    """Joins a large table to a much smaller one that has one row per key.

    The small side is copied once per salt and each row of the large side picks
    one salt, so a key that holds a third of the large side is spread over
    `salts` tasks. No broadcast is forced: where the small side is measured to
    be small, Spark broadcasts it by itself and the salt costs nothing. Without
    a number of salts it is the root of the session's number of partitions, so
    that both the copies and the share of a task stay small against the whole.
    """
    salts = salts or max(2, math.isqrt(partitions(large)))
    salt = "_salt"
    spread = large.withColumn(salt, F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, salt], how).drop(salt)


def partitions(df: DataFrame) -> int:
    """Partitions of a shuffle in the table's session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def broadcast_bytes(df: DataFrame) -> int:
    """Size up to which the table's session broadcasts, 0 where it never does."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[-1:], 1)
    return max(0, int(text.rstrip("kmg")) * unit)


def hot_keys(df: DataFrame, key: str, share: float | None = None) -> list:
    """Keys (null included) that hold more than `share` of the rows: by default more than a partition's.

    Runs a job: a bounded frequent-items sketch over one column. At most
    1/share keys come back.
    """
    share = share or 1 / partitions(df)
    limit = math.ceil(1 / share)
    counted = df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(key).isNull()).alias("nulls"),
        F.expr(f"approx_top_k(`{key}`, {limit}, {max(50_000, 10 * limit)})").alias("top"),
    ).first()
    floor = max(share * counted["n"], 2)
    found = [row[0] for row in counted["top"] or [] if row[0] is not None and row[1] >= floor]
    return found + ([None] if counted["nulls"] >= floor else [])


def join_unique(large: DataFrame, unique: DataFrame, key: str, how: str, share: float | None = None) -> DataFrame:
    """Joins a table with one that has a row per key, whatever the skew of the first.

    Rows of hot keys are joined apart: the other side has one row for each of
    those few keys, so that part is a broadcast of bounded size. For left, inner
    and left_semi joins. Finding the hot keys runs a job when this is called.
    """
    hot = hot_keys(large, key, share)
    if not hot:
        return large.join(unique, key, how)
    values = [k for k in hot if k is not None]
    # Null keys match nothing; next to the hot ones they cost nothing either.
    is_hot = F.col(key).isNull() | F.col(key).isin(values)
    few = unique.where(F.col(key).isin(values))
    rest = large.where(~is_hot).join(unique, key, how)
    return rest.unionByName(large.where(is_hot).join(F.broadcast(few), key, how))


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match each other; keeps the left keys."""
    renamed = reduce(lambda df, k: df.withColumnRenamed(k, f"_right_{k}"), on, right)
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in on]
    )
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in on])


def constant_array(values: list, element_type: T.DataType) -> Column:
    """A short Python list as an array constant."""
    return F.from_json(F.lit(json.dumps(values, default=str)), T.ArrayType(element_type))


def with_count_below(df: DataFrame, value: str, bounds: Column, size: int, name: str) -> DataFrame:
    """Adds how many of the ascending constant `bounds` (at most `size`) are below a column.

    A binary search with one projection per step: a row costs log2(size)
    comparisons, all in generated code.
    """
    found = df.withColumn(name, F.lit(0))
    for bit in reversed(range(size.bit_length())):
        step = F.lit(1 << bit)
        below = F.try_element_at(bounds, F.col(name) + step) < F.col(value)
        found = found.withColumn(name, F.col(name) + F.when(below, step).otherwise(0))
    return found


def with_row_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the 0-based position of each row in the order of a unique key.

    A plain row_number over the whole table would sort it in one task. Here the
    keys alone are sorted in ranges and written to the shared folder, with
    numbers that begin anew in each range. A range adds the size of those
    before it; the ranges are as many as the session has partitions, so their
    sizes are few. The rows then get the numbers by a join on the key.
    """
    keys = df.select(key).repartitionByRange(partitions(df), key).sortWithinPartitions(key)
    path = scratch_path(df.sparkSession, "row-index")
    keys.select(key, F.monotonically_increasing_id().alias("_id")).write.parquet(path)
    numbered = df.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_id", 33))
    sizes = numbered.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    index = numbered.join(before, "_range").select(F.col(key).alias("_key"), (F.col("_before") + inside).alias(name))
    return df.join(index, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import written


def star(links: DataFrame, large: bool) -> DataFrame:
    """Moves the larger (or the smaller) neighbours of each node to its smallest neighbour."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between long values to (a, b): each linked node but the least of its component, and that one.

    Alternates two steps that hang nodes to smaller ones, until nothing moves.
    The number of rounds grows with the logarithm of the longest chain. Each
    round is a written table; only two sums come to the driver.
    """
    state = written(links.where(F.col("a") != F.col("b")).distinct(), "links")
    seen = None
    while True:
        state = written(star(star(state, large=True), large=False), "links")
        sums = state.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum((F.hash("b", "a")).cast("decimal(38,0)"))
        ).first()
        if sums == seen:
            return state
        seen = sums

"""Tables in buckets: the same rows, joined without a shuffle, in this session and in another."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_rollup import made_up

from gradeloom import scratch_path
from gradeloom.operators import report
from gradeloom.sources import bucketed, files


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_generations_and_score_totals_meet_without_a_shuffle(spark):
    gens, scores = made_up(spark, 11)
    paths = [scratch_path(spark, name) for name in ("gens", "totals", "scores")]
    for df, path in zip((gens, report.scores_by_observation(scores), scores), paths, strict=True):
        bucketed.write(df, path, "observation_id", 5)
    stored, totals, all_scores = (bucketed.read(spark, p) for p in paths)
    assert rows(stored, "observation_id") == rows(gens, "observation_id")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = report.join_score_totals(stored, totals)
        assert rows(joined, "observation_id") == rows(report.join_scores(gens, scores), "observation_id")
        plan = plan_of(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "Exchange" in plan_of(report.join_scores(gens, scores))
        # Scores that were not folded before are folded within their buckets.
        assert "Exchange" not in plan_of(report.join_scores(stored, all_scores))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_another_session_reads_the_buckets_from_their_layout(spark):
    path = scratch_path(spark, "it's`")
    df = spark.range(50).select((F.col("id") % 7).alias("a key.x"), F.array(F.col("id").cast("string")).alias("b"), F.struct("id").alias("c"))
    bucketed.write(df, path, "a key.x", 3)
    spark.sql(f"DROP TABLE {bucketed._name(path)}")
    found = bucketed.read(spark, path)
    assert found.schema.simpleString() == df.schema.simpleString() and rows(found, "c") == rows(df, "c")
    assert "Exchange" not in plan_of(found.groupBy("`a key.x`").count())
    with pytest.raises(ValueError):
        bucketed.write(df, path, "a key.x")


def test_what_was_not_written_whole_is_not_read(spark):
    path = scratch_path(spark, "half")
    bucketed.write(spark.range(5), path, "id", 2)
    files.delete(spark, path, "_layout")
    with pytest.raises(ValueError):
        bucketed.read(spark, path)

"""The commit log: attempts, parts, writers that die, compaction, and the store on top of it."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradeloom import schemas, scratch_path
from gradeloom.operators import sinks
from gradeloom.plans import evaluation
from gradeloom.plans.report import stored_report
from gradeloom.sources import commits, files, store

LAYOUT = "session_id string, n long"


def made(spark, *pairs):
    return spark.createDataFrame(list(pairs), LAYOUT)


def seen(spark, path, **options):
    return sorted((r["session_id"], r["n"]) for r in commits.read(spark, path, LAYOUT, **options).collect())


@pytest.mark.parametrize("by_session", [True, False])
def test_the_newest_attempt_at_a_session_is_seen(spark, by_session):
    path = scratch_path(spark, "log")
    commits.commit(made(spark, ("a", 1), ("a", 2), ("b", 3)), path, by_session=by_session)
    commits.commit(made(spark, ("c", 4)), path, by_session=by_session)
    assert seen(spark, path) == [("a", 1), ("a", 2), ("b", 3), ("c", 4)]
    commits.commit(made(spark, ("a", 9)), path, by_session=by_session)
    assert seen(spark, path) == [("a", 9), ("b", 3), ("c", 4)]
    assert seen(spark, path, session_ids=["a", "x"]) == [("a", 9)] and seen(spark, path, session_ids=["x"]) == []
    # An attempt that speaks for a session without rows empties it.
    commits.commit(made(spark, ("c", 5)), path, made(spark, ("c", 0), ("b", 0)), by_session=by_session)
    assert seen(spark, path) == [("a", 9), ("c", 5)]
    commits.commit(made(spark), path, made(spark, ("a", 0)), by_session=by_session)
    assert seen(spark, path) == [("c", 5)]


def test_parts_of_an_attempt_add_up_and_replace_themselves(spark):
    path = scratch_path(spark, "log")
    commits.commit(made(spark, ("a", 1)), path, attempt="one", part="x")
    commits.commit(made(spark, ("a", 2)), path, attempt="one", part="y")
    assert seen(spark, path) == [("a", 1), ("a", 2)]
    commits.commit(made(spark, ("a", 3)), path, attempt="one", part="x")
    assert seen(spark, path) == [("a", 2), ("a", 3)]
    commits.commit(made(spark, ("a", 7)), path, attempt="two", part="x")
    # What comes late from an attempt that was given up is not seen.
    commits.commit(made(spark, ("a", 4)), path, attempt="one", part="z")
    assert seen(spark, path) == [("a", 7)]


def test_a_writer_that_dies_leaves_nothing_to_be_seen(spark):
    path = scratch_path(spark, "log")
    commits.commit(made(spark, ("a", 1), ("b", 1)), path)

    def breaks(n):
        if n == 3:
            raise RuntimeError("lost")
        return n

    dying = made(spark, ("a", 2), ("b", 3)).repartition(2, "n").withColumn("n", F.udf(breaks, "long")("n"))
    with pytest.raises(Exception, match="lost"):
        commits.commit(dying, path)
    assert seen(spark, path) == [("a", 1), ("b", 1)]
    # Dead after the rows, before the entry; and in the middle of the entry.
    made(spark, ("a", 5)).write.partitionBy("session_id").parquet(f"{path}/commit=dead")
    made(spark, ("a", 5)).selectExpr("session_id", "'dead' AS attempt").write.parquet(f"{path}/_sessions/commit=dead")
    assert seen(spark, path) == [("a", 1), ("b", 1)]
    files.create(spark, '{"number": 2, "com', path, "_log", f"{2:020d}.json")
    assert seen(spark, path) == [("a", 1), ("b", 1)]
    assert commits.commit(made(spark, ("a", 6)), path) == 3
    assert seen(spark, path) == [("a", 6), ("b", 1)]
    assert len(commits.vacuum(spark, path)) == 0
    assert "dead" in commits.vacuum(spark, path, older_than_hours=-1)
    assert seen(spark, path) == [("a", 6), ("b", 1)]


def test_two_writers_take_different_numbers(spark):
    path = scratch_path(spark, "log")
    assert [commits.commit(made(spark, ("a", i)), path) for i in range(2)] == [1, 2]
    assert not files.create(spark, "{}", path, "_log", f"{2:020d}.json")
    files.create(spark, json.dumps({"number": 3, "commit": "x"}), path, "_log", f"{3:020d}.json")
    assert commits.commit(made(spark, ("a", 5)), path) == 4 and seen(spark, path) == [("a", 5)]


def test_compaction_keeps_what_is_seen(spark):
    path = scratch_path(spark, "log")
    for i in range(4):
        commits.commit(made(spark, ("a", i), (f"s{i}", i)), path, attempt=f"try-{i}", part="x")
    commits.commit(made(spark, ("a", 8)), path, attempt="try-3", part="y")
    before = seen(spark, path)
    assert before == [("a", 3), ("a", 8), ("s0", 0), ("s1", 1), ("s2", 2), ("s3", 3)]
    assert commits.compact(spark, path, LAYOUT) == 4 and seen(spark, path) == before
    # A commit that took its number while the compaction read is later than it.
    number = commits.last_number(spark, path)
    commits.commit(made(spark, ("s1", 11)), path, attempt="try-9", part="x")
    commits.commit(made(spark, ("a", 33)), path, attempt="try-3", part="x")
    commits.commit(made(spark, ("a", 0)), path, attempt="try-0", part="late")
    after = [("a", 8), ("a", 33), ("s0", 0), ("s1", 11), ("s2", 2), ("s3", 3)]
    assert number == 6 and seen(spark, path) == after
    commits.compact(spark, path, LAYOUT)
    assert seen(spark, path) == after
    commits.vacuum(spark, path, older_than_hours=-1)
    assert seen(spark, path) == after
    # One folder per part is left.
    assert sum(n.startswith("commit=") for n in files.names(spark, path)) == 2


def test_folders_that_are_seen_whole_are_scanned_without_a_join(spark):
    path = scratch_path(spark, "log")
    for s in "abc":
        commits.commit(made(spark, *[(s, i) for i in range(5)]), path)
        commits.commit(made(spark, (s, 7)), path)
    plan = commits.read(spark, path, LAYOUT)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    some = commits.read(spark, path, LAYOUT, ["b"])
    assert len(some.inputFiles()) == 1 and [tuple(r) for r in some.collect()] == [("b", 7)]


def stored_twice(spark, scored):
    results = spark.createDataFrame([(f"o{i}", "eval-1", "m", 4.0) for i in range(3)], "observation_id string, session_id string, model string, score double")
    scores = spark.createDataFrame(
        [("eval-1", f"o{i}", "llm-judge-score", float(i), None, "NUMERIC", None) for i in range(scored)], f"session_id string, {schemas.SCORES}"
    )
    return results, scores


def test_scores_written_again_in_an_attempt_replace_themselves(spark):
    path = scratch_path(spark, "scores")
    sessions, scores = stored_twice(spark, 3)
    sinks.write_scores(scores, path, "first", sessions)
    sinks.write_scores(scores, path, "first", sessions)
    assert store.read_scores(spark, path).count() == 3
    sinks.write_scores(scores.limit(0), path, "second", sessions)
    assert store.read_scores(spark, path).count() == 0 and store.read_scores(spark, path, session_ids=["eval-1"]).count() == 0


def test_a_run_stored_again_is_reported_once(spark):
    from test_evaluation import judge_json, plan, run

    base = scratch_path(spark, "store")
    done = run(spark, plan(spark), judge_json)
    evaluation.store(done, base, "test")
    first = rows(stored_report(spark, base, 30_000))
    evaluation.store(done, base, "test")
    assert rows(stored_report(spark, base, 30_000)) == first and first[0]["n"] == 3
    # A store that dies before the sessions are written shows the session as it was.
    sinks.write_sessions(store.read_sessions(spark, f"{base}/sessions", 30_000).withColumn("environment", F.lit("other")), f"{base}/sessions", "x")
    assert [r["environment"] for r in store.read_sessions(spark, f"{base}/sessions", 30_000).collect()] == ["other"]

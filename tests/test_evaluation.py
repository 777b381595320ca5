"""Whole runs, and the streams."""

import hashlib
import json
import sys

import pytest
from conftest import one, rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gradeloom import scratch_path
from gradeloom.functions import identity, json_text
from gradeloom.operators import report, scoring, summary
from gradeloom.plans import evaluation
from gradeloom.plans.report import session_report
from gradeloom.sources import store
from gradeloom.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = {"type": "object", "properties": {"summary": {"type": "string"}}, "required": ["summary"]}
ITEM = ("dataset_id string, item_id string, input string, criteria string, image string, options map<string,string>, "
        "response_format string, schema_id string, item_index int")


def plan(spark, image=None, schema_id=None, n=3):
    models = spark.createDataFrame([("vendor/m:free", "groq", None, 0)],
                                   "model string, provider string, params map<string,string>, model_index int")
    items = spark.createDataFrame([("text", f"i{i}", f"question {i}", "be right", image, None, None, schema_id, i) for i in range(n)], ITEM)
    return evaluation.plan_requests(models, items, "eval-1")


def answers():
    def call(body, row):
        return {"choices": [{"message": {"content": '{"summary": "fine"}'}}],
                "usage": {"prompt_tokens": 11, "completion_tokens": 7, "total_tokens": 18}}

    return call


def judge_json():
    return lambda body, row: {"choices": [{"message": {"content": '{"score": 4, "reasoning": "ok"}'}}]}


def judge_prose():
    return lambda body, row: {"choices": [{"message": {"content": "A fine answer."}}]}


def run(spark, requests, judge, **options):
    return evaluation.evaluate(
        requests, client_factory=answers, responses_path=scratch_path(spark, "responses"), judge_client_factory=judge,
        results_path=scratch_path(spark, "results"), max_concurrency=2, **options,
    )


def test_healthy_run(spark):
    made = run(spark, plan(spark), judge_json)
    scores = rows(made.scores, "observation_id")
    assert [(r["name"], r["value_num"]) for r in scores] == [("llm-judge-score", 4.0)] * 3
    found = rows(made.observations, "id")
    assert [r["type"] for r in found] == ["GENERATION", "SPAN"] * 3 and {r["level"] for r in found} == {None}
    assert found[0]["tokens_total"] == 18 and found[0]["name"] == "groq-completion" and found[1]["name"] == "eval:vendor/m:free:i0"
    assert json.loads(found[1]["input"]) == {"prompt": "question 0", "criteria": "be right"}
    gens = made.results.withColumns({"latency": F.col("elapsed_ms") / 1000, "total_cost": F.lit(0.0),
                                     "start_time": F.lit(None).cast("timestamp"), "model": F.lit("")})
    table = one(report.model_report(gens, made.scores))
    assert (table["model"], table["provider"], table["n"], table["judge_avg"], table["tokens_in"]) == ("vendor/m:free", "groq", 3, 4.0, 33)


def test_judge_that_returns_prose(spark):
    made = run(spark, plan(spark), judge_prose)
    assert [(r["name"], r["value_num"], r["value_str"]) for r in rows(made.scores)] == [("llm-judge-error", None, "unscored")] * 3


def test_schema_scored_run(spark):
    image = "data:image/png;base64,AAAA"
    media = spark.createDataFrame([(hashlib.sha256(image.encode()).hexdigest(), image)], "media_id string, image string")
    made = run(spark, plan(spark, image, "s", 1), judge_json, schemas={"s": SCHEMA}, media=media)
    assert {r["name"]: r["value_num"] for r in rows(made.scores)} == {"llm-judge-score": 4.0, "json-schema-valid": 1.0}
    assert one(made.results)["metadata"]["hasImage"] == "true"


def seeing():
    def call(body, row):
        assert body["messages"][0]["content"][1]["image_url"]["url"].startswith("data:image/png")
        return {"choices": [{"message": {"content": "seen"}}]}

    return call


def test_images_meet_the_requests_only_at_the_call(spark):
    models = spark.createDataFrame([(f"m{i}", "groq", None, i) for i in range(3)], "model string, provider string, params map<string,string>, model_index int")
    items = spark.createDataFrame([("d", "i", "look", "c", "data:image/png;base64,AAAA", None, None, None, 0)], ITEM)
    requests = evaluation.plan_requests(models, items, "eval-1")
    assert "image" not in requests.columns and "messages" not in requests.columns
    assert {r["metadata"]["hasImage"] for r in requests.collect()} == {"true"}
    replies = evaluation.evaluate(
        requests, client_factory=seeing, responses_path=scratch_path(spark, "r"), media=evaluation.media_table(items),
        judge_recorded=spark.createDataFrame([], "model string, provider string, item_id string, raw string"),
    )
    assert [r["output"] for r in replies.results.collect()] == ["seen"] * 3


def test_items_bring_their_schema_and_bad_items_are_not_sent(spark):
    models = spark.createDataFrame([("m", "groq", None, 0)], "model string, provider string, params map<string,string>, model_index int")
    wanted = json.dumps(SCHEMA)
    items = spark.createDataFrame(
        [("d", "good", "q", "c", None, None, None, wanted, None, 0), ("d", "bad", None, "c", None, None, None, wanted, "missing: input", 1),
         ("d", "free", "q", "c", None, None, None, None, None, 2)],
        "dataset_id string, item_id string, input string, criteria string, image string, options map<string,string>, "
        "response_format string, score_schema string, error string, item_index int",
    )
    requests = evaluation.plan_requests(models, items, "eval-1")
    formats = {r["item_id"]: r["effective"].get("response_format") for r in requests.collect()}
    assert json.loads(formats["good"])["json_schema"]["schema"] == SCHEMA and formats["free"] is None
    made = run(spark, requests, judge_json)
    found = {r["item_id"]: r for r in made.results.collect()}
    assert (found["good"]["schema_value"], found["bad"]["error"], found["free"]["schema_value"]) == (1, "missing: input", None)
    assert found["bad"]["attempts"] == 0
    names = [(r["observation_id"], r["name"]) for r in made.scores.collect()]
    assert ("eval-1/groq/m/good", "json-schema-valid") in names and len(names) == 3
    assert one(summary.schema_validity_by_model(made.results)) == {"model": "m", "provider": "groq", "passed": 1, "total": 1}
    total = [r for r in summary.timing_with_total(made.results).collect() if r["model"] == "ALL"]
    assert total[0]["n"] == 3 and total[0]["total_ms"] >= 0


def test_a_stored_run_is_reported(spark):
    base = scratch_path(spark, "store")
    made = run(spark, plan(spark), judge_json)
    evaluation.store(made, base, "test")
    found = session_report(store.read_generations(spark, f"{base}/generations"), store.read_scores(spark, f"{base}/scores"),
                           spark.read.parquet(f"{base}/sessions"), dataset_id="text")
    row = one(found)
    assert (row["model"], row["provider"], row["n"], row["judge_avg"], row["tokens_in"]) == ("vendor/m:free", "groq", 3, 4.0, 33)
    assert row["latency_mean_ms"] is not None
    seen = rows(made.observations.where("type = 'GENERATION'"))
    assert seen[0]["tags"][0] == "dataset:text" and seen[0]["start_time"] is not None and seen[0]["metadata"]["provider"] == "groq"


def test_live_runs_need_paths(spark):
    with pytest.raises(ValueError, match="responses_path"):
        evaluation.evaluate(plan(spark), client_factory=answers)
    recorded = spark.createDataFrame([], "model string, provider string, item_id string, raw string")
    with pytest.raises(ValueError, match="results_path"):
        evaluation.evaluate(plan(spark), recorded, judge_client_factory=judge_json)


def test_missing_recordings_lose_only_their_rows(spark):
    reply = json.dumps({"choices": [{"message": {"content": "hello"}}]})
    recorded = spark.createDataFrame([("vendor/m:free", "groq", "i1", reply)], "model string, provider string, item_id string, raw string")
    made = evaluation.evaluate(plan(spark), recorded, judge_recorded=recorded)
    assert [(r["item_id"], r["output"], r["error"]) for r in rows(made.results, "item_id")] == [
        ("i0", None, "no recorded response"), ("i1", "hello", None), ("i2", None, "no recorded response"),
    ]
    assert [r["name"] for r in rows(made.scores)] == ["llm-judge-error"]
    assert sorted((r["level"] or "") for r in rows(made.observations.where("type = 'SPAN'"))) == ["", "ERROR", "ERROR"]


def test_filters_on_computed_columns_keep_plans_small(spark):
    """A filter is moved below the columns it names; those must not multiply on the way."""
    reply = json.dumps({"choices": [{"message": {"content": '{"score": 4}'}}]})
    recorded = spark.createDataFrame([("vendor/m:free", "groq", "i1", reply)], "model string, provider string, item_id string, raw string")
    made = evaluation.evaluate(plan(spark, schema_id="s"), recorded, judge_recorded=recorded, schemas={"s": SCHEMA})
    for df in (made.results.where("score > 3 AND reasoning <> 'x' AND output <> ''"), made.scores.where("value_num = 0")):
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 400_000
        assert df.count() == 1
    parsed = spark.createDataFrame([('{"summary": 1}',)], "output string")
    checked = scoring.validate_json(parsed.withColumn("v", json_text.extract_json_loose(F.col("output"))), "v", SCHEMA)
    bad = checked.where("NOT valid AND checked > 1 AND size(errors) = 1")
    assert len(bad._jdf.queryExecution().optimizedPlan().toString()) < 400_000
    assert bad.count() == 1


def land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def responses(spark, ids, score="4.0"):
    return spark.range(*ids).selectExpr(
        "'s' session_id", "id observation_id", "concat('m', id % 2) model", "'{}' output", f"cast({score} as double) score",
        "'r' reasoning", "cast(null as boolean) truncated", "cast(null as string) done_reason", "cast(null as string) error",
    )


def test_stream_scores_survive_restart_and_replay(spark):
    base = scratch_path(spark, "stream")
    land(responses(spark, (0, 5)), f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema

    def go():
        source = spark.readStream.schema(schema).parquet(f"{base}/in")
        jobs.stream_scores(source, f"{base}/out", f"{base}/state", ["a", "b"], SCHEMA).awaitTermination()

    go()
    land(responses(spark, (5, 8)), f"{base}/in")
    go()
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == 8 * 2 * 2 and out.dropDuplicates(["project", "observation_id", "name"]).count() == 32
    # A batch that is run again overwrites its own folder.
    from gradeloom.operators.sinks import fan_out

    again = scoring.all_scores(responses(spark, (5, 8)), SCHEMA, keys=("session_id", "observation_id"))
    fan_out(again, ["a", "b"], f"{base}/out/batch_id=1", mode="overwrite")
    assert spark.read.parquet(f"{base}/out").count() == 32


def test_stream_leaderboard_updates(spark):
    base = scratch_path(spark, "board")
    land(responses(spark, (0, 4), "id"), f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema

    def go():
        source = spark.readStream.schema(schema).parquet(f"{base}/in")
        jobs.stream_leaderboard(source, f"{base}/out", f"{base}/state").awaitTermination()
        return rows(jobs.read_leaderboard(spark, f"{base}/out"), "model")

    assert [(r["n"], r["mean_score"], r["unscored"]) for r in go()] == [(2, 1.0, 0), (2, 2.0, 0)]
    land(responses(spark, (4, 7), "if(id = 6, null, id)"), f"{base}/in")
    assert [(r["n"], r["mean_score"], r["unscored"]) for r in go()] == [(3, 2.0, 1), (3, 3.0, 0)]
    jobs.compact_leaderboard(spark, f"{base}/out")
    land(responses(spark, (7, 8), "9"), f"{base}/in")
    assert [(r["n"], r["mean_score"], r["unscored"]) for r in go()] == [(3, 2.0, 1), (4, 4.5, 0)]


def test_leaderboard_with_window_drops_old_state(spark):
    stream = spark.readStream.format("rate").load().selectExpr("timestamp ts", "'m' model", "1.0D score", "cast(null as string) error")
    board = jobs.leaderboard(stream, ("model",), window="1 minute", watermark="5 minutes")
    assert board.isStreaming and "window" in board.columns


def test_provider_of_tags(spark):
    df = spark.createDataFrame([(["a", "provider:x:y", "provider:z"],), (["a"],), (None,)], "t array<string>")
    assert [r["p"] for r in rows(df.select(identity.provider_from_tags(F.col("t")).alias("p")))] == ["x:y", None, None]


def test_a_run_that_is_stored_more_than_once_is_evaluated_once(spark, tmp_path):
    from workload import run

    made = run._evaluation(spark, "/root/testdata/sf0.001", str(tmp_path / "results"))
    for table in (made.results, made.scores):
        files = table.inputFiles()
        assert files and all(str(tmp_path) in f for f in files)

"""Verdicts, judge scores, truncation scores, scorers."""

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.operators import judging, scoring


@pytest.mark.parametrize(
    "content,truncated,score,reasoning",
    [
        ('{"score":5,"reasoning":"Correct."}', False, 5.0, "Correct."),
        ('```json\n{"score": 4, "reasoning": "Close."}\n```', None, 4.0, "Close."),
        ('```\n{"score": 4}\n```  ', None, 4.0, ""),
        ('{"score":9,"reasoning":null}', None, 9.0, ""),
        ('{"score":"4.5"}', None, 4.5, ""),
        ('{"score":" 3 "}', None, 3.0, ""),
        ("I think it's pretty good actually.", None, None, "Failed to parse judge output (not valid JSON)"),
        ('{"score": "excellent"}', None, None, "Failed to parse judge output (score is not a finite number)"),
        ('{"score": null}', None, None, "Failed to parse judge output (score is not"),
        ('{"score": true}', None, None, "Failed to parse judge output (score is not"),
        ('{"score": ""}', None, None, "Failed to parse judge output (score is not"),
        ('{"score": []}', None, None, "Failed to parse judge output (score is not"),
        ('{"score": 1e999}', None, None, "Failed to parse judge output (score is not"),
        ('{"score": "NaN"}', None, None, "Failed to parse judge output (score is not"),
        ("5", None, None, "Failed to parse judge output (score is not"),
        ('{"score": 4} and more', None, None, "Failed to parse judge output (not valid JSON)"),
        ('{"score": 4, "reasoning": "cut o', True, None, "Judge response was truncated at 512 tokens"),
        ('{"score": 4}', True, None, "Judge response was truncated"),
        (None, None, None, "Failed to parse judge output"),
    ],
)
def test_parse_verdicts(spark, content, truncated, score, reasoning):
    df = spark.createDataFrame([(content, truncated)], "content string, truncated boolean")
    found = one(judging.parse_verdicts(df))
    assert found["score"] == score
    assert found["reasoning"] == reasoning if score is not None else found["reasoning"].startswith(reasoning)


def test_judge_scores_never_write_zero_for_unscored(spark):
    df = spark.createDataFrame(
        [(1, 4.0, "ok"), (2, None, "Failed"), (3, float("nan"), "nan"), (4, 9.0, ""), (5, 0.0, "bad")],
        "observation_id long, score double, reasoning string",
    )
    found = rows(scoring.build_judge_scores(df), "observation_id")
    assert [(r["name"], r["value_num"], r["value_str"], r["data_type"]) for r in found] == [
        ("llm-judge-score", 4.0, None, "NUMERIC"),
        ("llm-judge-error", None, "unscored", "CATEGORICAL"),
        ("llm-judge-error", None, "unscored", "CATEGORICAL"),
        ("llm-judge-score", 9.0, None, "NUMERIC"),
        ("llm-judge-score", 0.0, None, "NUMERIC"),
    ]
    assert found[1]["comment"] == "Failed"


def test_truncation_is_three_valued(spark):
    df = spark.createDataFrame(
        [(1, True, "MAX_TOKENS"), (2, False, None), (3, None, None), (4, True, None)],
        "observation_id long, truncated boolean, done_reason string",
    )
    found = rows(scoring.truncation_scores(df), "observation_id")
    assert [(r["observation_id"], r["value_num"]) for r in found] == [(1, 1.0), (2, 0.0), (4, 1.0)]
    assert "done_reason: MAX_TOKENS" in found[0]["comment"]
    assert "done_reason: stop" in found[1]["comment"]
    assert "done_reason: length" in found[2]["comment"]


def test_all_scores_skip_errors_and_fuse(spark):
    df = spark.createDataFrame(
        [(1, "{}", 5.0, "r", True, None, None), (2, None, None, None, None, None, "API error (500)")],
        "observation_id long, output string, score double, reasoning string, truncated boolean, "
        "done_reason string, error string",
    )
    made = scoring.all_scores(df, schema={"type": "object"}, extra=[scoring.score_regex(r"^\{")])
    assert {(r["observation_id"], r["name"]) for r in rows(made)} == {
        (1, "llm-judge-score"), (1, "json-schema-valid"), (1, "response-truncated"), (1, "regex-match"),
    }
    # One scan of the responses, whatever the number of scorers.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan


def test_registered_scorer_may_return_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "observation_id long, output string")

    def per_text(results):
        counted = results.groupBy("output").agg(F.min("observation_id").alias("observation_id"))
        return counted.select("observation_id", F.lit(1.0).alias("value_num")).select(
            "observation_id", F.lit("seen").alias("name"), "value_num",
            F.lit(None).cast("string").alias("value_str"), F.lit(fixed.NUMERIC).alias("data_type"),
            F.lit(None).cast("string").alias("comment"),
        )

    scoring.register_scorer("seen", per_text)
    made = scoring.score_rows(df, ["seen", scoring.score_regex("a")])
    assert made.count() == 4


def test_judge_prompt_holds_all_parts(spark):
    df = spark.createDataFrame([("Say 100%", "100 %d", "exact")], "input string, output string, criteria string")
    prompt = one(judging.build_judge_prompts(df))["judge_prompt"]
    assert "impartial evaluator" in prompt
    for part in ('"""\nSay 100%\n"""', '"""\n100 %d\n"""', '"""\nexact\n"""', "1 = completely fails"):
        assert part in prompt


def test_judge_requests_are_short_and_deterministic(spark):
    df = spark.createDataFrame([("i", "o", "c")], "input string, output string, criteria string")
    hosted = one(judging.build_judge_requests(df, "judge"))["request"]
    assert '"temperature":0' in hosted and '"max_completion_tokens":512' in hosted and "think" not in hosted
    local = one(judging.build_judge_requests(df, "judge", "ollama"))["request"]
    assert '"think":false' in local and '"num_predict":512' in local

"""Provider replies and request bodies."""

import json

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from gradeloom.operators import matrix, requests, responses


def normalized(spark, provider, body):
    raw = body if isinstance(body, str) else json.dumps(body)
    return one(responses.normalize_responses(spark.createDataFrame([(provider, raw)], "provider string, raw string")))


@pytest.mark.parametrize(
    "message,text",
    [
        ({"content": "hi"}, "hi"),
        ({"content": " hi "}, " hi "),
        ({"content": [{"type": "text", "text": "part one "}, {"type": "text", "text": "part two"}]}, "part one part two"),
        ({"content": [{"type": "image_url"}, {"text": " x "}]}, "x"),
        ({"content": [None, {"type": "text", "text": "y"}]}, "y"),
        ({"content": None, "reasoning_content": "thought"}, "thought"),
        ({"content": "", "reasoning": "more thought"}, "more thought"),
        ({"content": "final", "thinking": "hmm"}, "final"),
        ({"content": " ", "thinking": "hmm"}, "hmm"),
        ({"content": " "}, " "),
        ({"content": [], "reasoning_content": None, "thinking": "t"}, "t"),
        ({}, ""),
    ],
)
def test_message_text(spark, message, text):
    assert normalized(spark, "groq", {"choices": [{"message": message}]})["content"] == text
    assert normalized(spark, "ollama", {"message": message})["content"] == text


def test_no_choices(spark):
    assert normalized(spark, "groq", {"choices": []})["content"] == ""
    assert normalized(spark, "groq", {})["content"] == ""


def test_openai_usage_and_unknown_truncation(spark):
    found = normalized(spark, "nvidia", {"choices": [{"message": {"content": "x"}, "finish_reason": "length"}],
                                         "usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}})
    assert (found["tokens_in"], found["tokens_out"], found["tokens_total"]) == (3, 4, 7)
    assert found["truncated"] is None and found["done_reason"] is None and found["load_ms"] is None
    assert normalized(spark, "groq", {"choices": []})["tokens_total"] == 0


@pytest.mark.parametrize("reason,cut", [("length", True), ("stop", False), (None, False)])
def test_native_reply(spark, reason, cut):
    body = {"message": {"content": "x"}, "prompt_eval_count": 30, "eval_count": 7, "load_duration": 4200400000,
            "eval_duration": "n/a"}
    if reason:
        body["done_reason"] = reason
    found = normalized(spark, "ollama", body)
    assert found["truncated"] is cut and found["done_reason"] == reason
    assert (found["tokens_in"], found["tokens_out"], found["tokens_total"]) == (30, 7, 37)
    assert (found["load_ms"], found["eval_ms"], found["prompt_eval_ms"]) == (4200, None, None)


def test_candidates_reply(spark):
    body = {"candidates": [{"content": {"parts": [{"text": "a"}, {}, {"text": "b"}]}, "finishReason": "MAX_TOKENS"}],
            "usageMetadata": {"promptTokenCount": 1, "candidatesTokenCount": 2, "totalTokenCount": 5}}
    found = normalized(spark, "gemini", body)
    assert (found["content"], found["truncated"], found["done_reason"]) == ("ab", True, "MAX_TOKENS")
    assert (found["tokens_in"], found["tokens_out"], found["tokens_total"]) == (1, 2, 5)
    assert normalized(spark, "gemini", {"candidates": []})["content"] == ""


def test_unreadable_reply_is_an_error(spark):
    found = normalized(spark, "groq", "<html>bad gateway</html>")
    assert found["error"] == "provider reply is not valid JSON" and found["content"] is None


def body_for(spark, provider, text="hi", image=None, effective=None):
    df = spark.createDataFrame(
        [("m", provider, text, image, effective or {})],
        "model string, provider string, input string, image string, effective map<string,string>",
    ).withColumn("messages", requests.build_messages(F.col("input"), F.col("image")))
    return json.loads(one(requests.build_provider_requests(df))["request"])


IMAGE = "data:image/jpeg;base64,/9j/4AA="
FORMAT = '{"type":"json_schema","json_schema":{"name":"x","strict":true,"schema":{"type":"object"}}}'


def test_openai_body(spark):
    effective = {"temperature": "0.6", "max_completion_tokens": "2048", "top_p": "0.95", "response_format": FORMAT,
                 "reasoning_effort": "max"}
    body = body_for(spark, "groq", "hi", None, effective)
    assert body == {"model": "m", "messages": [{"role": "user", "content": "hi"}], "temperature": 0.6,
                    "max_completion_tokens": 2048, "top_p": 0.95, "stream": False, "response_format": json.loads(FORMAT)}
    body = body_for(spark, "nvidia", "hi", IMAGE, effective)
    assert body["max_tokens"] == 2048 and "max_completion_tokens" not in body and body["reasoning_effort"] == "max"
    assert body["messages"][0]["content"] == [
        {"type": "text", "text": "hi"}, {"type": "image_url", "image_url": {"url": IMAGE}},
    ]


def test_native_body(spark):
    effective = {"temperature": "0.8", "max_completion_tokens": "8192", "repeat_penalty": "1.15", "think": "false",
                 "response_format": FORMAT, "keep_alive": "10m"}
    body = body_for(spark, "ollama", "hi", IMAGE, effective)
    assert body == {
        "model": "m",
        "messages": [{"role": "user", "content": "hi", "images": ["/9j/4AA="]}],
        "stream": False,
        "options": {"temperature": 0.8, "num_predict": 8192, "repeat_penalty": 1.15},
        "format": {"type": "object"},
        "think": False,
        "keep_alive": "10m",
    }
    assert body_for(spark, "ollama") == {"model": "m", "messages": [{"role": "user", "content": "hi"}], "stream": False}
    assert body_for(spark, "ollama", effective={"response_format": '{"type":"json_object"}'})["format"] == "json"
    assert body_for(spark, "ollama", image="AAAA")["messages"][0]["images"] == ["AAAA"]


def test_contents_body(spark):
    effective = {"temperature": "0", "max_completion_tokens": "5", "response_format": FORMAT}
    body = body_for(spark, "gemini", "hi", IMAGE, effective)
    assert body == {
        "contents": [{"role": "user", "parts": [{"text": "hi"}, {"inlineData": {"mimeType": "image/jpeg", "data": "/9j/4AA="}}]}],
        "generationConfig": {"temperature": 0, "maxOutputTokens": 5, "responseMimeType": "application/json",
                             "thinkingConfig": {"thinkingBudget": 0}},
    }


def test_several_messages(spark):
    parts = "array<struct<type:string,text:string,url:string>>"
    df = spark.createDataFrame(
        [("m", [("user", [("text", "one", None), ("text", "two", None)]), ("assistant", [("text", "", None)])], {})],
        f"model string, messages array<struct<role:string,parts:{parts}>>, effective map<string,string>",
    )
    native = json.loads(one(requests.build_provider_requests(df.withColumn("provider", F.lit("ollama"))))["request"])
    assert [m["content"] for m in native["messages"]] == ["one\ntwo", ""]
    other = json.loads(one(requests.build_provider_requests(df.withColumn("provider", F.lit("gemini"))))["request"])
    assert other["contents"] == [{"role": "user", "parts": [{"text": "one"}, {"text": "two"}]}]


def test_effective_params_layers(spark):
    df = spark.createDataFrame(
        [
            ("groq", {"temperature": "0.1", "seed": "1"}, {"temperature": "0.2"}, FORMAT),
            ("ollama", None, {"think": "false", "seed": None}, None),
            ("elsewhere", {"x": "1"}, None, None),
        ],
        "provider string, params map<string,string>, options map<string,string>, response_format string",
    )
    found = [r["effective"] for r in rows(matrix.effective_params(df))]
    assert found == [
        {"temperature": "0.2", "max_completion_tokens": "2048", "top_p": "0.95", "response_format": FORMAT},
        {"think": "false"},
        {"x": "1"},
    ]


def test_response_format(spark):
    df = spark.createDataFrame([('{"type":"object"}',), (None,)], "s string")
    found = [r["f"] for r in rows(df.select(requests.to_response_format(F.col("s")).alias("f")))]
    assert json.loads(found[0])["json_schema"] == {"name": "eval_response", "strict": True, "schema": {"type": "object"}}
    assert found[1] is None


def test_trace_identity(spark):
    df = spark.createDataFrame(
        [("a:b", "ollama", "i1", "text", None), ("x" * 300, "groq", "i2", "image", IMAGE)],
        "model string, provider string, item_id string, dataset_id string, image string",
    )
    first, second = rows(requests.trace_identity(df, F.lit("http://10.0.0.1:1")), "item_id")
    assert first["trace_name"] == "eval:a:b:i1"
    assert first["tags"] == ["dataset:text", "provider:ollama/remote"]
    assert first["metadata"] == {"datasetId": "i1", "model": "a:b", "provider": "ollama",
                                 "providerTag": "ollama/remote", "hasImage": "false"}
    assert len(second["metadata"]["model"]) == 200 and second["metadata"]["hasImage"] == "true"

"""Model lists, matrix, catalogs, misspelt names."""

import json
import random
import sys

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from gradeloom.operators import catalogs, matrix, preflight
from gradeloom.operators.inference import TransportError

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_normalize_models(spark):
    entries = ['"plain-model"', '{"id":"a","provider":"ollama"}', '{"id":"b"}',
               '{"id":"c","provider":"nvidia","reasoning_effort":"max","seed":7}']
    df = spark.createDataFrame([(e,) for e in entries], "entry string")
    assert rows(matrix.normalize_models(df)) == [
        {"model": "plain-model", "provider": "groq", "params": None},
        {"model": "a", "provider": "ollama", "params": None},
        {"model": "b", "provider": "groq", "params": None},
        {"model": "c", "provider": "nvidia", "params": {"reasoning_effort": "max", "seed": "7"}},
    ]


def test_enabled_providers(spark):
    df = spark.createDataFrame([("a", "groq"), ("b", "ollama"), ("c", "gemini")], "model string, provider string")
    assert [r["model"] for r in matrix.filter_enabled(df, " groq, ,ollama ").collect()] == ["a", "b"]
    assert matrix.filter_enabled(df).count() == 3
    assert rows(matrix.skipped_providers(df, ["groq"]), "provider") == [{"provider": "gemini"}, {"provider": "ollama"}]
    with pytest.raises(ValueError, match="unknown provider 'grok'"):
        matrix.filter_enabled(df, "grok")


def test_eval_matrix_positions(spark):
    models = spark.createDataFrame([("m0", 0), ("m1", 1)], "model string, model_index int")
    items = spark.createDataFrame([("i0", 0), ("i1", 1), ("i2", 2)], "item_id string, item_index int")
    found = [(r["model"], r["item_id"], r["position"]) for r in rows(matrix.eval_matrix(models, items), "position")]
    assert found == [("m0", "i0", 1), ("m0", "i1", 2), ("m0", "i2", 3), ("m1", "i0", 4), ("m1", "i1", 5), ("m1", "i2", 6)]
    assert matrix.eval_matrix(models.where("model = 'x'"), items).count() == 0
    plan = matrix.eval_matrix(models, items)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_combine_keeps_duplicates(spark):
    df = spark.createDataFrame([("a", "ollama")], "model string, provider string")
    assert [r["list_rank"] for r in rows(matrix.combine_models(df, df), "list_rank")] == [0, 1]


def test_catalogs(spark):
    native = {"models": [{"name": "qwen:2b", "model": "qwen:2b", "capabilities": ["completion", "vision"]}, {"name": "text:1b"}]}
    hosted = {"data": [{"id": "x"}, {"id": "x"}, {"id": ""}, {}]}
    other = {"models": [{"name": "models/g1", "supportedGenerationMethods": ["generateContent"]},
                        {"name": "models/g2", "supportedGenerationMethods": ["embed"]}, {"name": "models/g3"}]}
    df = spark.createDataFrame(
        [("ollama", json.dumps(native)), ("groq", json.dumps(hosted)), ("gemini", json.dumps(other)), ("nvidia", "oops")],
        "provider string, raw string",
    )
    found = {(r["provider"], r["model"]) for r in rows(preflight.catalog_ids(df))}
    assert found == {("ollama", "qwen:2b"), ("ollama", "text:1b"), ("groq", "x"), ("gemini", "g1")}
    details = preflight.catalog_details(df)
    models = spark.createDataFrame([("ollama", "qwen:2b"), ("ollama", "text:1b"), ("ollama", "new:1b"), ("groq", "x")],
                                   "provider string, model string")
    assert [r["model"] for r in rows(preflight.not_vision_capable(models, details))] == ["text:1b"]
    wanted = models.union(spark.createDataFrame([("groq", "judge"), ("groq", "judge")], "provider string, model string"))
    missing = {(r["provider"], r["model"]) for r in rows(preflight.missing_models(wanted, preflight.catalog_ids(df)))}
    assert missing == {("ollama", "new:1b"), ("groq", "judge")}


def test_unsupported_params_once(spark):
    df = spark.createDataFrame(
        [("groq", {"repeat_penalty": "1.15"}, None)] * 3
        + [("ollama", {"repeat_penalty": "1.15"}, {"think": "true"}), ("groq", {"seed": None}, {"top_p": "1"}), ("own", {"x": "1"}, None)],
        "provider string, params map<string,string>, options map<string,string>",
    )
    found = rows(preflight.unsupported_params(df, matrix.supported_params(spark)))
    assert found == [{"provider": "groq", "param": "repeat_penalty"}]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def closest(key, known, limit=2):
    best = min(((levenshtein(key, k), i, k) for i, k in enumerate(known)), default=None)
    return best[2] if best and best[0] <= limit else None


def suggestions(spark, keys, known):
    k = spark.createDataFrame([(x,) for x in keys], "key string")
    n = spark.createDataFrame([(x, i) for i, x in enumerate(known)], "key string, ordinal int")
    return {r["key"]: r["suggestion"] for r in rows(preflight.closest_match(k, n))}


def test_closest_match(spark):
    known = ["model", "max_retries", "min_request_interval_ms", "base_url", "top_p"]
    found = suggestions(spark, ["max_retrries", "modle", "model", "xyz", "base_url_2", "topp"], known)
    assert found == {"max_retrries": "max_retries", "modle": "model", "xyz": None, "base_url_2": "base_url", "topp": "top_p"}


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.text("abé", max_size=5), min_size=1, max_size=12),
    st.lists(st.text("abé", max_size=5), min_size=1, max_size=12, unique=True),
)
def test_closest_match_against_brute_force(spark, keys, known):
    assert suggestions(spark, keys, known) == {k: closest(k, known) for k in keys if k not in known}


def test_long_keys_meet_on_segments(spark):
    """Brute force over lengths around the limit, and a key of a thousand characters."""
    rng = random.Random(11)
    names = ["".join(rng.choice("abcd") for _ in range(n)) for n in range(28, 40) for _ in range(3)] + ["x" * 500 + "y" * 500]
    keys = set()
    for name in names:
        for edits in (1, 2, 3):
            text = list(name)
            for _ in range(edits):
                at = rng.randrange(len(text))
                rng.choice([lambda: text.pop(at), lambda: text.insert(at, "z"), lambda: text.__setitem__(at, "q")])()
            keys.add("".join(text))
    known = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "key string, ordinal int")
    found = {r["key"]: r["distance"] for r in preflight.closest_match(spark.createDataFrame([(k,) for k in keys], "key string"), known).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for key in keys:
        near = [distance(key, name) for name in names if abs(len(key) - len(name)) <= 2]
        assert found[key] == (min(near) if near and min(near) <= 2 else None), key


def lister():
    """Catalogs of three pages; some fail on the second, never end, or can't be reached at once."""
    lost = []

    def ask(provider, token):
        n = int(token or 0)
        if provider == "fails" and n == 1:
            raise RuntimeError("API error (503)")
        if provider == "lost" and not lost:
            lost.append(provider)
            raise TransportError("reset")
        if provider == "silent":
            raise ValueError
        following = str(n + 1) if n < 2 else None
        return {"page": n}, "1" if provider == "loops" else following

    return ask


def test_catalogs_are_listed_page_by_page_and_fail_by_provider(spark):
    names = ["whole", "fails", "loops", "silent", "lost", "whole", None]
    df = spark.createDataFrame([(n,) for n in names], "provider string")
    listed = catalogs.list_catalogs(df, lister, max_retries=1, max_backoff_s=0)
    assert listed.rdd.getNumPartitions() == 5
    found = {}
    for r in rows(listed, "provider", "page"):
        found.setdefault(r["provider"], []).append((r["page"], r["error"] or json.loads(r["raw"])["page"]))
    assert found["whole"] == found["lost"] == [(0, 0), (1, 1), (2, 2)]
    assert found["fails"] == [(0, 0), (1, "API error (503)")] and found["silent"] == [(0, "ValueError")]
    assert sorted(found["loops"], key=str)[:1] == [(0, 0)] and ("the catalog repeats its page 1" in str(found["loops"]))
    assert catalogs.list_catalogs(df.where("false"), lister).count() == 0


def test_only_deletions_that_the_lengths_leave_possible_are_made():
    assert preflight._depths([20, 14], [18], 2) == ({2: [20]}, {0: [18]})
    assert preflight._depths([17], [18], 1) == ({0: [17]}, {1: [18]})
    assert preflight._depths([18], [18, 19], 2) == ({0: [18], 1: [18], 2: [18]}, {0: [18], 1: [18, 19], 2: [18, 19]})
    assert preflight._depths([3], [9], 2) == ({}, {})
    assert preflight._depths([], [9], 2) == ({}, {})

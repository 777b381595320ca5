"""The report: sessions, score join, quantiles, ordering, ties."""

import datetime as dt
import random

import numpy as np
import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from gradeloom import schemas, scratch_path
from gradeloom.functions import identity
from gradeloom.operators import quantiles, report, sinks, spread
from gradeloom.plans.report import session_report
from gradeloom.sources import store

GENS = (
    "observation_id string, session_id string, trace_name string, model string, tags array<string>, "
    "latency double, tokens_in long, tokens_out long, total_cost double, start_time timestamp"
)
SCORES = "observation_id string, name string, value_num double, value_str string"
T0 = dt.datetime(2024, 1, 1)


def gen(id, model="m", session="eval-1", trace=None, tags=("dataset:d", "provider:p"), latency=1.0, minute=0, tokens=(1, 2)):
    return (id, session, trace or f"eval:{model}:i{id}", model, list(tags) if tags is not None else None, latency,
            tokens[0], tokens[1], 0.5, T0 + dt.timedelta(minutes=minute))


@pytest.mark.parametrize(
    "name,expected",
    [
        ("eval:a/b:item", {"model": "a/b", "item_id": "item"}),
        ("eval:vendor/x:free:item", {"model": "vendor/x:free", "item_id": "item"}),
        ("eval:m:", {"model": "m", "item_id": ""}),
        ("eval:only", None),
        ("other:m:i", None),
        ("eval:m\n:i\n", {"model": "m\n", "item_id": "i\n"}),
        (None, None),
    ],
)
def test_parse_trace_name(spark, name, expected):
    df = spark.createDataFrame([(name,)], "n string")
    assert one(df.select(identity.parse_trace_name(F.col("n")).alias("p")))["p"] == expected


def test_model_and_item_fall_back(spark):
    gens = spark.createDataFrame(
        [gen("1", model=None, trace="eval:q:free:i"), gen("2", model="", trace="x"), gen("3", model="k", trace="x")], GENS
    )
    found = rows(report.named_generations(gens).select("model", "item_id"), "model")
    assert found == [
        {"model": "(unknown)", "item_id": "(unknown)"}, {"model": "k", "item_id": "(unknown)"},
        {"model": "q:free", "item_id": "i"},
    ]


def test_model_report(spark):
    gens = spark.createDataFrame(
        [
            gen("1", "a", latency=1.0, minute=5, tags=("provider:late",)),
            gen("2", "a", latency=2.0, minute=1, tags=None),
            gen("3", "a", latency=10.0, minute=2, tags=("x", "provider:early:eu")),
            gen("4", "a", latency=None, minute=9, tokens=(None, None)),
            gen("5", "b", tags=()),
        ],
        GENS,
    )
    scores = spark.createDataFrame(
        [
            ("1", "llm-judge-score", 4.0, None), ("1", "json-schema-valid", 1.0, None), ("1", "response-truncated", 0.0, None),
            ("2", "llm-judge-score", 5.0, None), ("2", "json-schema-valid", 0.0, None),
            ("3", "llm-judge-error", None, "unscored"), ("3", "response-truncated", 1.0, None),
            ("4", "something-else", 3.0, None), (None, "llm-judge-score", 1.0, None), ("9", "llm-judge-score", 1.0, None),
        ],
        SCORES,
    )
    a, b = rows(report.model_report(gens, scores), "model")
    assert a["provider"] == "early:eu" and a["n"] == 4
    assert (a["judge_avg"], a["judge_min"], a["judge_max"], a["judge_n"], a["unscored"]) == (4.5, 4.0, 5.0, 2, 1)
    assert (a["schema_pass"], a["schema_total"], a["truncated"]) == (1, 2, 1)
    assert a["latency_mean_ms"] == pytest.approx(13000 / 3)
    assert a["latency_p50_ms"] == 2000 and a["latency_p95_ms"] == pytest.approx(9200)
    assert (a["tokens_in"], a["tokens_out"], a["cost"]) == (3, 6, 2.0)
    assert b["judge_avg"] is None and b["judge_n"] == 0 and b["provider"] is None and b["latency_p50_ms"] == 1000


def test_report_by_provider_keeps_untagged_apart(spark):
    gens = spark.createDataFrame([gen("1"), gen("2", tags=None), gen("3", tags=("provider:q",))], GENS)
    scores = spark.createDataFrame([("2", "llm-judge-score", 2.0, None)], SCORES)
    found = rows(report.model_report(gens, scores, by=("model", "provider")), "provider")
    assert [(r["provider"], r["n"], r["judge_avg"], r["latency_p50_ms"]) for r in found] == [
        (None, 1, 2.0, 1000.0), ("p", 1, None, 1000.0), ("q", 1, None, 1000.0),
    ]


def test_repeated_observations_count_each_time(spark):
    gens = spark.createDataFrame([gen("1")] * 3 + [gen("2")], GENS)
    scores = spark.createDataFrame([("1", "llm-judge-score", 4.0, None), ("2", "llm-judge-score", 1.0, None)], SCORES)
    found = one(report.model_report(gens, scores))
    assert (found["n"], found["judge_n"], found["judge_avg"]) == (4, 4, 13 / 4)


def test_join_unique_splits_hot_keys(spark):
    data = [("hot", i) for i in range(400)] + [(None, i) for i in range(300)] + [(f"k{i}", i) for i in range(300)]
    large = spark.createDataFrame(data, "k string, i long").repartition(8)
    unique = spark.createDataFrame([("hot", 1)] + [(f"k{i}", 2) for i in range(0, 300, 2)], "k string, v long")
    assert set(spread.hot_keys(large, "k", 0.1)) == {"hot", None}
    for how in ("left", "inner", "left_semi"):
        plain = large.join(unique, "k", how)
        split = spread.join_unique(large, unique, "k", how, 0.1)
        assert sorted(map(str, rows(split))) == sorted(map(str, rows(plain)))
        assert split.columns == plain.columns


def test_salted_join_equals_plain_join(spark):
    large = spark.createDataFrame([(i % 3, i) for i in range(100)], "k long, i long")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(map(str, rows(large.join(small, ["k"], how))))
        assert sorted(map(str, rows(spread.salted_join(large, small, ["k"], how, ["i"])))) == plain


def brute(values, q):
    return float(np.quantile(np.array(values), q)) if values else None


@pytest.mark.parametrize("buckets", [2, 3, 16, 256])
def test_exact_quantiles_against_brute_force(spark, buckets):
    rng = random.Random(buckets)
    groups = {
        "ties": [1.0] * 500 + [2.0] * 3,
        "wide": [rng.uniform(-1e6, 1e6) for _ in range(700)],
        "one": [3.5],
        "two": [1.0, 2.0],
        "ten": [1.0, 2.0, 10.0],
        None: [rng.gauss(0, 1) for _ in range(50)],
        "zeros": [0.0, -0.0, 0.0],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("void", None), ("ten", None), ("ten", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = {r["g"]: r for r in rows(quantiles.exact_quantiles(df, ["g"], "v", wanted, buckets))}
    assert set(found) == set(groups)
    for g, values in groups.items():
        for name, q in wanted.items():
            assert found[g][name] == pytest.approx(brute(values, q), rel=1e-12, abs=1e-12), (g, name)


def test_exact_quantiles_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "GROUP_BYTES", 1 << 40)
    df = spark.range(1000).selectExpr("id % 7 as g", "cast(id * id % 101 as double) as v")
    found = rows(quantiles.exact_quantiles(df, ["g"], "v", {"m": 0.5}), "g")
    expected = [brute([float(i * i % 101) for i in range(1000) if i % 7 == g], 0.5) for g in range(7)]
    assert [r["m"] for r in found] == expected


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert rows(quantiles.exact_quantiles(df, ["g"], "v", {"m": 0.5})) == []


def test_approx_quantiles(spark):
    df = spark.range(1001).selectExpr("1 as g", "cast(id as double) as v")
    assert one(quantiles.approx_quantiles(df, ["g"], "v", {"m": 0.5}))["m"] == pytest.approx(500, abs=2)


def test_row_index(spark):
    keys = [f"key-{i * 37 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(6)
    found = rows(spread.with_row_index(df, "k", "at"), "k")
    assert [r["at"] for r in found] == list(range(1000))


def test_sessions(spark):
    made = [(f"eval-{i}", T0 + dt.timedelta(days=i), "dev" if i % 2 else "prod") for i in range(9)]
    df = spark.createDataFrame(made + [("chat-1", T0 + dt.timedelta(days=99), "dev")],
                               "session_id string, created_at timestamp, environment string")

    def ids(**options):
        return [r["session_id"] for r in report.latest_sessions(df, **options).collect()]

    assert ids() == [f"eval-{i}" for i in (8, 7, 6, 5, 4)]
    assert ids(last=2) == ["eval-8", "eval-7"]
    assert ids(last=0) == ids(last=-1) == ids(last=float("nan")) == ids()
    assert len(ids(all=True)) == 9
    assert sorted(ids(session_ids=["x", "y"])) == ["x", "y"]
    now = T0 + dt.timedelta(days=10)
    recent = store.recent_sessions(df, 3, "dev", now)
    assert sorted(r["session_id"] for r in recent.collect()) == ["chat-1", "eval-7"]
    assert store.recent_sessions(df, -1, None, now).count() == 10


def test_session_report_end_to_end(spark):
    gens = spark.createDataFrame(
        [gen("1", "a", "eval-1"), gen("2", "b", "eval-2"), gen("3", "b", "eval-2", tags=("dataset:e",)), gen("4", "c", "eval-0")], GENS
    )
    scores = spark.createDataFrame([(str(i), "llm-judge-score", float(i), None) for i in range(1, 5)], SCORES)
    sessions = spark.createDataFrame([(f"eval-{i}", T0 + dt.timedelta(days=i), "d") for i in range(3)],
                                     "session_id string, created_at timestamp, environment string")
    found = session_report(gens, scores, sessions, last=2, dataset_id="d").collect()
    assert [(r["model"], r["n"], r["judge_avg"]) for r in found] == [("b", 1, 2.0), ("a", 1, 1.0)]
    found = session_report(gens, scores, sessions, session_ids=["eval-0"]).collect()
    assert [r["model"] for r in found] == ["c"]


REPORT = "model string, n long, judge_avg double, judge_n long, latency_p50_ms double, unscored long"


def test_order_ties_and_fastest(spark):
    made = spark.createDataFrame(
        [
            ("a", 3, 4.0, 3, 200.0, 1), ("b", 9, 4.004, 9, 100.0, 0), ("c", 9, None, 0, 100.0, 2),
            ("d", 9, 3.0, 1, None, 0), ("e", 20, None, 0, 300.0, 0),
        ],
        REPORT,
    )
    assert [r["model"] for r in report.order_report(made).collect()] == ["b", "a", "d", "e", "c"]
    best = rows(report.best_models(made), "model")
    assert [(r["model"], r["tie"]) for r in best] == [("a", True), ("b", True)]
    assert one(report.fastest_model(made))["model"] == "b"
    assert one(report.unscored_total(made))["unscored"] == 3


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], REPORT)
    assert rows(report.best_models(empty)) == [] and rows(report.fastest_model(empty)) == []
    gens = spark.createDataFrame([], GENS)
    assert rows(report.model_report(gens, spark.createDataFrame([], SCORES))) == []


def test_tags_and_dataset_filter(spark):
    gens = spark.createDataFrame([gen("1"), gen("2", tags=None), gen("3", tags=("dataset:dd",))], GENS)
    assert [r["observation_id"] for r in report.filter_dataset(gens, "d").collect()] == ["1"]
    assert rows(report.filter_dataset(gens, "zz")) == []


def test_report_plan_folds_before_the_big_shuffles(spark):
    gens = spark.createDataFrame([gen("1")], GENS)
    scores = spark.createDataFrame([("1", "llm-judge-score", 4.0, None)], SCORES)
    plan = report.model_report(gens, scores)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # The big passes keep numbers only; a sort-based aggregate may follow on a few rows per model.
    assert plan.count("partial_sum(latency_ms") == plan.count("partial_min(start_time") > 0


@pytest.mark.parametrize(
    "url,where",
    [
        ("http://localhost:11434", "local"), ("http://LOCALHOST", "local"), ("http://box.localhost/x", "local"),
        ("http://127.0.0.1:11434", "local"), ("http://127.9.8.7", "local"), ("http://[::1]:11434", "local"),
        ("http://0.0.0.0:1", "local"), ("http://[::]:1", "local"), ("http://[0:0:0:0:0:0:0:1]/", "local"),
        ("http://192.168.1.5:11434", "remote"), ("https://example.com", "remote"), ("http://localhost.example.com", "remote"),
        ("http://128.0.0.1", "remote"), ("not a url", "remote"), ("", "remote"), (None, "remote"),
    ],
)
def test_endpoint_locality(spark, url, where):
    df = spark.createDataFrame([(url,)], "u string")
    assert one(df.select(identity.endpoint_locality(F.col("u")).alias("w")))["w"] == where


def test_provider_tag(spark):
    df = spark.createDataFrame([("ollama", "http://10.0.0.9:1"), ("groq", "http://localhost")], "p string, u string")
    tagged = df.select(
        identity.provider_tag(F.col("p"), F.col("u")).alias("given"), identity.provider_tag(F.col("p")).alias("default")
    )
    assert rows(tagged) == [{"given": "ollama/remote", "default": "ollama/local"}, {"given": "groq", "default": "groq"}]


def test_other_sessions_scores_are_not_read(spark):
    path = scratch_path(spark, "scores")
    made = [(f"eval-{i}", f"o{i}", "llm-judge-score", 1.0, None, "NUMERIC", None) for i in range(6)]
    sinks.write_scores(spark.createDataFrame(made, f"session_id string, {schemas.SCORES}"), path)
    kept = store.read_scores(spark, path, session_ids=["eval-1", "eval-4"])
    assert "PartitionFilters: [session_id" in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["observation_id"] for r in kept.collect()) == ["o1", "o4"]
    chosen = spark.createDataFrame([("eval-2",)], "session_id string")
    assert [r["observation_id"] for r in store.read_scores(spark, path, session_ids=chosen).collect()] == ["o2"]


def test_the_report_runs_no_job_for_hot_ids(spark):
    gens = spark.createDataFrame([gen("1"), gen("2")], GENS)
    scores = spark.createDataFrame([("1", "llm-judge-score", 4.0, None)], SCORES)
    plan = report.model_report(gens, scores, exact=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "approx_top_k" not in plan and plan.count("LogicalRDD") <= 4


def test_broadcast_limit_is_read_from_the_session(spark):
    df = spark.range(1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for text, size in (("256k", 256 << 10), ("10MB", 10 << 20), ("-1", 0), ("77", 77), ("77b", 77)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
            assert spread.broadcast_bytes(df) == size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

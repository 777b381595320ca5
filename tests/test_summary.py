"""Run summaries, timing, progress."""

from conftest import one, rows
from pyspark.sql import functions as F

from gradeloom.operators import observations, summary

RESULTS = (
    "session_id string, position long, model string, provider string, item_id string, elapsed_ms long, "
    "started_ms long, tokens_in long, tokens_out long, score double, reasoning string, schema_value int, "
    "schema_comment string, truncated boolean, error string"
)


def result(model="m", provider="p", position=1, elapsed=1000, tokens=(10, 5), score=4.0, schema=None, truncated=None,
           error=None, session="s", started=0):
    return (session, position, model, provider, f"i{position}", elapsed, started, tokens[0], tokens[1], score, "because",
            schema, "comment" if schema is not None else None, truncated, error)


def frame(spark, *made):
    return spark.createDataFrame(list(made), RESULTS)


def test_timing(spark):
    df = frame(
        spark,
        result("a", "ollama/local", elapsed=1000, tokens=(10, 5)),
        result("a", "ollama/local", elapsed=3000, tokens=(10, 7)),
        result("b", "ollama/local", elapsed=2000, tokens=(None, None)),
        result("c", "ollama/local", elapsed=None),
        result("a", "groq", elapsed=500, error="failed"),
    )
    found = {(r["model"], r["provider"]): r for r in rows(summary.timing_by_model(df))}
    assert set(found) == {("a", "ollama/local"), ("b", "ollama/local"), ("a", "groq")}
    a = found["a", "ollama/local"]
    assert (a["total_ms"], a["slowest_ms"], a["n"], a["tokens_in"], a["tokens_out"]) == (4000, 3000, 2, 20, 12)
    assert found["b", "ollama/local"]["tokens_out"] == 0
    ends = one(summary.slowest_fastest(summary.timing_by_model(df)))
    assert (ends["slowest_model"], ends["slowest_provider"], ends["fastest_provider"]) == ("a", "ollama/local", "groq")
    assert rows(summary.slowest_fastest(summary.timing_by_model(df.where("model = 'b'")))) == []


def test_timing_total_is_wall_time(spark):
    df = frame(
        spark,
        result("a", elapsed=1000, started=0), result("b", elapsed=2000, started=500), result("b", elapsed=None, started=2600),
    )
    found = {r["model"]: r for r in rows(summary.timing_with_total(df))}
    total = found.pop("ALL")
    assert (total["total_ms"], total["n"], total["tokens_out"], total["provider"]) == (2600, 3, 10, None)
    assert found["b"]["n"] == 1 and found["a"]["total_ms"] == 1000


def test_timing_of_untimed_results(spark):
    df = frame(spark, result(elapsed=None))
    assert rows(summary.timing_by_model(df)) == []


def test_scores_and_status(spark):
    df = frame(
        spark,
        result(score=4.0), result(score=5.0), result(score=None), result(score=float("nan")),
        result(score=None, error="boom"), result(provider="q", score=1.0),
    )
    found = {r["provider"]: (r["avg_score"], r["n"]) for r in rows(summary.avg_score_by_model(df))}
    assert found == {"p": (4.5, 2), "q": (1.0, 1)}
    assert one(summary.unscored_count(df))["unscored"] == 2
    statuses = [r["status"] for r in rows(summary.result_status(df))]
    assert sorted(statuses) == ["ERROR", "SCORED", "SCORED", "SCORED", "UNSCORED", "UNSCORED"]
    texts = {r["summary"] for r in rows(summary.result_status(df))}
    assert {"ERROR - boom", "UNSCORED - because", "score=4/5 - because"} <= texts


def test_schema_validity(spark):
    df = frame(spark, result(schema=1), result(schema=0), result(schema=None), result(schema=0, error="x"))
    assert rows(summary.schema_validity_by_model(df)) == [{"model": "m", "provider": "p", "passed": 1, "total": 2}]
    assert summary.schema_failures(df).count() == 1


def test_truncated(spark):
    df = frame(spark, result(truncated=True), result(truncated=False), result(truncated=None), result(truncated=True, error="x"))
    assert summary.truncated_results(df).count() == 1


def test_errors_are_fatal_for_credentials_only(spark):
    df = spark.createDataFrame(
        [("Groq API error (401 on model)",), ("x (403)",), ("(4031)",), ("(500 on",), ("401",), (None,)], "message string"
    )
    assert [r["fatal"] for r in summary.classify_errors(df).collect()] == [True, True, False, False, False, False]


def test_progress(spark):
    elapsed = [100, None, 300, 50, 75]
    df = frame(spark, *[result(position=i + 1, elapsed=e) for i, e in enumerate(elapsed)],
               result(session="t", position=1, elapsed=7))
    for chunk in (1, 2, 3, 100):
        found = [r for r in rows(summary.progress(df, chunk=chunk), "session_id", "position")]
        running, total = 0, 0
        for i, row in enumerate(found[:5]):
            total += elapsed[i] or 0
            assert (row["completed"], row["total"], row["remaining"]) == (i + 1, 5, 4 - i)
            assert row["mean_ms"] == total / (i + 1)
            assert row["eta_ms"] == (total / (i + 1) * (4 - i) if i < 4 else None)
        assert found[5]["eta_ms"] is None and found[5]["mean_ms"] == 7


def test_progress_with_planned_total(spark):
    df = frame(spark, result(position=1, elapsed=1000)).withColumn("total", F.lit(6))
    found = one(summary.progress(df))
    assert (found["remaining"], found["eta_ms"]) == (5, 5000)


def test_traffic(spark):
    df = spark.createDataFrame(
        [("/api/public/otel/v1/traces", b"12345"), ("/api/public/otel/v1/traces", b"1"), ("/api/public/ingestion", b"abc"),
         ("/api/public/media/x", b""), ("/health", b"ok")],
        "path string, body binary",
    )
    found = {r["kind"]: (r["requests"], r["bytes"]) for r in rows(observations.sink_traffic_summary(df))}
    assert found == {"spans (OTLP)": (2, 6), "score writes": (1, 3), "media uploads": (1, 0), "/health": (1, 2)}
    assert rows(observations.sink_traffic_summary(df.where("path = 'none'"))) == []

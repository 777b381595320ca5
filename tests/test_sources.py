"""Readers, captured requests, images, media, sinks."""

import base64
import json

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from gradeloom import scratch_path
from gradeloom.functions import identity
from gradeloom.operators import media, report, sinks
from gradeloom.sources import datasets, store

CAPTURED = {
    "model": "local:2b",
    "think": False,
    "stream": False,
    "format": {"type": "object", "properties": {"summary": {"type": "string"}}},
    "options": {"temperature": 0.8, "num_predict": 8192, "repeat_penalty": 1.15},
    "messages": [
        {"role": "system", "content": "ignored"},
        {"role": "user", "content": "Return one object.",
         "images": ["${[ fs.readFile(path=b64'" + base64.b64encode(b"C:\\in\\frame 1.jpg").decode() + "', encoding='base64') ]}",
                    "data:image/png;base64,AAAA"]},
        {"role": "user", "content": "second"},
    ],
}


def captured(spark, *texts):
    df = spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(texts)], "i int, value string")
    return rows(datasets.parse_captured_requests(df), "i")


def test_captured_request(spark):
    found = captured(spark, CAPTURED)[0]
    assert found["prompt"] == "Return one object." and found["error"] is None
    assert json.loads(found["score_schema"]) == CAPTURED["format"]
    assert found["options"] == {"temperature": "0.8", "max_completion_tokens": "8192", "repeat_penalty": "1.15", "think": "false"}
    assert len(found["warnings"]) == 1 and "repeat_penalty=1.15" in found["warnings"][0]
    assert found["referenced_images"] == ["C:\\in\\frame 1.jpg", "(inline data URL)"]


def test_captured_variants(spark):
    user = {"messages": [{"role": "user", "content": "x"}]}
    plain, wrapped, thinking, no_user, broken, null_format = captured(
        spark, user, {**user, "format": {"json_schema": {"type": "array"}}}, {**user, "think": True},
        {"messages": [{"role": "system", "content": "x"}]}, '{"messages": [', {**user, "format": None},
    )
    assert plain["options"] == {} and plain["score_schema"] is None and plain["warnings"] == [] and plain["referenced_images"] == []
    assert json.loads(wrapped["score_schema"]) == {"type": "array"}
    assert "reasoning pass" in thinking["warnings"][0]
    assert no_user["error"] == "no message with role user" and no_user["prompt"] is None
    assert broken["error"] == "not valid JSON"
    assert null_format["score_schema"] is None and null_format["error"] is None


def test_load_captured_requests(spark, tmp_path):
    (tmp_path / "a.md").write_text(json.dumps(CAPTURED, indent=2))
    (tmp_path / "b.md").write_text("# not json")
    found = rows(datasets.load_captured_requests(spark, str(tmp_path)), "path")
    assert [r["error"] for r in found] == [None, "not valid JSON"]


@pytest.mark.parametrize(
    "path,mime",
    [("a.jpg", "image/jpeg"), ("a.JPEG", "image/jpeg"), ("x/y.b.png", "image/png"), ("a.webp", "image/webp"),
     ("a.txt", "application/octet-stream"), ("dir.png/file", "application/octet-stream")],
)
def test_mime(spark, path, mime):
    df = spark.createDataFrame([(path,)], "p string")
    assert one(df.select(identity.mime_type(F.col("p")).alias("m")))["m"] == mime


def test_load_images(spark, tmp_path):
    data = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A, 0x00, 0xFF]) * 20
    (tmp_path / "t.PNG").write_bytes(data)
    (tmp_path / "big.jpg").write_bytes(bytes(4096))
    small, = rows(datasets.load_images(spark, str(tmp_path), 1024).where("error is null"))
    assert small["data_url"] == "data:image/png;base64," + base64.b64encode(data).decode()
    refused, = rows(datasets.load_images(spark, str(tmp_path), 1024).where("error is not null"))
    assert "over the" in refused["error"] and refused["data_url"] is None and refused["length"] == 4096
    assert datasets.load_images(spark, str(tmp_path)).where("data_url is not null").count() == 2
    plan = datasets.load_images(spark, str(tmp_path), 1024)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1024)" in plan


def test_data_url_info(spark):
    df = spark.createDataFrame([("data:image/png;base64," + "A" * 4096,), ("/tmp/x.png",), ("data:text/plain,hi",)], "u string")
    url, path, plain = [r["i"] for r in rows(df.select(identity.data_url_info(F.col("u")).alias("i")))]
    assert url == {"is_data_url": True, "mime": "image/png", "payload": "A" * 4096, "bytes": 3072, "size_label": "3 KB"}
    assert path["is_data_url"] is False and path["payload"] is None
    assert plain["is_data_url"] is True and plain["mime"] is None and plain["payload"] is None


def test_offload_media(spark):
    image = "data:image/png;base64," + base64.b64encode(b"pixels").decode()
    df = spark.createDataFrame([(1, f"see {image} and {image}!"), (2, image), (3, "none"), (4, None)], "i int, body string")
    refs, stored = media.offload_media(df, "body")
    found = {r["i"]: r["body"] for r in rows(refs)}
    row = one(stored)
    assert (row["mime"], bytes(row["content"])) == ("image/png", b"pixels") and stored.count() == 1
    link = f"media://{row['media_id']}"
    assert found == {1: f"see {link} and {link}!", 2: link, 3: "none", 4: None}


def test_items(spark, tmp_path):
    lines = [
        {"dataset_id": "text", "item_id": "capital", "input": "What?", "criteria": "Paris"},
        {"dataset_id": "text", "item_id": "bad", "input": "What?"},
        {"dataset_id": "image", "item_id": "pic", "input": "See", "criteria": "c", "image": "data:,", "options": {"temperature": "0"}},
    ]
    (tmp_path / "items.json").write_text("\n".join(map(json.dumps, lines)))
    found = {r["item_id"]: r for r in rows(datasets.load_items(spark, str(tmp_path)))}
    assert found["capital"]["error"] is None and found["bad"]["error"] == "missing: criteria"
    assert found["pic"]["options"] == {"temperature": "0"}
    assert datasets.load_items(spark, str(tmp_path), "image").count() == 1


def test_load_models(spark, tmp_path):
    (tmp_path / "models.jsonl").write_text('"a"\n\n{"id":"b","provider":"nvidia"}\n')
    assert [(r["model"], r["provider"]) for r in rows(datasets.load_models(spark, str(tmp_path)), "model")] == [
        ("a", "groq"), ("b", "nvidia"),
    ]


def test_scores_append_and_read(spark):
    path = scratch_path(spark, "scores")
    df = spark.createDataFrame([("s1", "o1", "n", 1.0), ("s2", None, "n", 2.0)], "session_id string, observation_id string, name string, value_num double")
    full = df.withColumns({c: F.lit(None).cast("string") for c in ("value_str", "data_type", "comment")})
    sinks.write_scores(full, path)
    sinks.write_scores(full, path)
    assert store.read_scores(spark, path).count() == 2
    ids = spark.createDataFrame([("o1",), ("o1",)], "observation_id string")
    assert store.read_scores(spark, path, ids).count() == 2
    assert spark.read.parquet(path).where("session_id = 's2'").count() == 2


def test_sessions_are_pruned_by_list(spark):
    path = scratch_path(spark, "gens")
    spark.range(30).selectExpr("cast(id as string) observation_id", "concat('eval-', id % 3) session_id").write.partitionBy("session_id").parquet(path)
    kept = store.read_generations(spark, path, ["eval-1"])
    assert kept.count() == 10
    assert "PartitionFilters: [isnotnull(session_id" in kept._jdf.queryExecution().executedPlan().toString()
    table = spark.createDataFrame([("eval-1",), ("eval-1",), ("eval-9",)], "session_id string")
    assert store.read_generations(spark, path, table).count() == 10


def test_fan_out(spark):
    path = scratch_path(spark, "fan")
    df = spark.range(3)
    sinks.fan_out(df, None, path)
    sinks.fan_out(df, spark.createDataFrame([("b",), ("c",), ("b",)], "project string"), path)
    found = {(r["project"], r["n"]) for r in rows(spark.read.parquet(path).groupBy("project").agg(F.count("*").alias("n")))}
    assert found == {("default", 3), ("b", 3), ("c", 3)}
    many = sinks.with_projects(df, spark.range(1500).selectExpr("cast(id as string) project"))
    assert many.count() == 4500 and many.select("project").distinct().count() == 1500
    none = sinks.with_projects(df, spark.createDataFrame([(None,)], "project string"))
    assert {r["project"] for r in none.collect()} == {"default"}


def test_report_json(spark):
    path = scratch_path(spark, "report")
    gens = spark.createDataFrame([("1", "eval:m:i", None, 2.0)], "observation_id string, trace_name string, model string, latency double")
    made = gens.withColumn("tags", F.array().cast("array<string>"))
    sinks.write_report_json(gens.select("model"), report.report_items(made), spark.createDataFrame([("eval-1",)], "session_id string"), path)
    assert one(spark.read.json(f"{path}/items")) == {"item_id": "i", "latency_ms": 2000.0, "model": "m"}
    assert one(spark.read.json(f"{path}/sessions")) == {"session_id": "eval-1"}


def test_scratch_path_needs_a_shared_folder(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

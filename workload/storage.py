"""Queries that write to the shared scratch folder and read back, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom import scratch_path
from gradeloom.operators import report, scoring, sinks
from gradeloom.sources import datasets, store
from gradeloom.streaming import jobs, live
from workload import registry as r
from workload import run
from workload import tables as t
from workload.registry import query


def _stored_scores(spark, d):
    """Score rows of the document results, with their session."""
    rows = scoring.all_scores(t.results_documents(spark, d), keys=("session_id", "observation_id"))
    return rows.withColumn("observation_id", F.col("observation_id").cast("string"))


STORED = f"""stored AS (SELECT session_id, CAST(observation_id AS VARCHAR) AS observation_id,
    CASE WHEN score IS NULL THEN 'llm-judge-error' ELSE 'llm-judge-score' END AS name, score AS value_num,
    CASE WHEN score IS NULL THEN 'unscored' END AS value_str FROM results WHERE error IS NULL
  UNION ALL SELECT session_id, CAST(observation_id AS VARCHAR), 'response-truncated', CASE WHEN truncated THEN 1.0 ELSE 0.0 END::DOUBLE, NULL
  FROM results WHERE error IS NULL AND truncated IS NOT NULL)"""


@query("write_scores", f"WITH {r.RESULTS}, {STORED} SELECT session_id, observation_id, name, value_num, value_str FROM stored")
def write_scores(spark, d):
    """Writes twice, once per half of the sessions, and reads all back."""
    path = scratch_path(spark, "scores")
    rows = _stored_scores(spark, d)
    sinks.write_scores(rows.where(F.col("session_id") < "eval-2"), path)
    sinks.write_scores(rows.where(F.col("session_id") >= "eval-2"), path)
    return spark.read.parquet(path).select("session_id", "observation_id", "name", "value_num", "value_str")


@query(
    "read_scores",
    f"""WITH {r.RESULTS}, {STORED} SELECT observation_id, name, value_num FROM stored
      WHERE observation_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'de')""",
)
def read_scores(spark, d):
    path = scratch_path(spark, "scores")
    _stored_scores(spark, d).drop("session_id").write.parquet(path)
    wanted = t.table(spark, d, "documents").where("lang = 'de'")
    ids = wanted.select(F.col("doc_id").cast("string").alias("observation_id"))
    return store.read_scores(spark, path, ids).select("observation_id", "name", "value_num")


def _stored_generations(spark, d):
    path = scratch_path(spark, "generations")
    gens = t.gens_events(spark, d).withColumn("observation_id", F.col("observation_id").cast("string"))
    gens = gens.withColumn("start_time", F.col("start_time").cast("timestamp"))
    gens.hint("rebalance", "session_id").write.partitionBy("session_id").parquet(path)
    return path


@query(
    "read_generations",
    f"WITH {r.GENS} SELECT observation_id::VARCHAR AS observation_id, session_id, model, tokens_out, round(latency, 6) AS latency FROM gens WHERE session_id IN ('eval-2024-01-05', 'eval-2024-01-20')",
)
def read_generations(spark, d):
    """By a list of sessions, which prunes partitions."""
    gens = store.read_generations(spark, _stored_generations(spark, d), ["eval-2024-01-05", "eval-2024-01-20"])
    return gens.select("observation_id", "session_id", "model", "tokens_out", "latency")


@query(
    "read_generations_by_table",
    f"""WITH {r.GENS}, latest AS (SELECT 'eval-' || strftime(ts, '%Y-%m-%d') AS session_id, min(ts) AS created_at FROM events
        WHERE day(ts) % 3 <> 0 GROUP BY 1 ORDER BY created_at DESC, session_id LIMIT 5)
      SELECT observation_id::VARCHAR AS observation_id, session_id, trace_name FROM gens WHERE session_id IN (SELECT session_id FROM latest)""",
)
def read_generations_by_table(spark, d):
    """By a table of sessions, in a salted semi-join."""
    latest = report.latest_sessions(t.sessions_events(spark, d))
    gens = store.read_generations(spark, _stored_generations(spark, d), latest)
    return gens.select("observation_id", "session_id", "trace_name")


@query(
    "fan_out",
    """SELECT project, page_id, sha256(html) AS html_hash FROM pages, (SELECT unnest(['default', 'shared']) AS project)""",
)
def fan_out(spark, d):
    path = scratch_path(spark, "fan-out")
    sinks.fan_out(t.table(spark, d, "pages"), ["default", "shared", "default"], path)
    return spark.read.parquet(path).select("project", "page_id", F.sha2("html", 256).alias("html_hash"))


@query(
    "write_report_json",
    f"""{r.REPORT} SELECT model, n, round(judge_avg, 6) AS judge_avg, round(latency_p95_ms, 6) AS latency_p95_ms,
      (SELECT count(*) FROM named x WHERE x.model = report.model) AS items FROM report""",
)
def write_report_json(spark, d):
    path = scratch_path(spark, "report")
    gens = t.gens_events(spark, d)
    made = report.model_report(gens, t.scores_events(spark, d))
    sinks.write_report_json(made, report.report_items(gens), t.sessions_events(spark, d), path)
    models = spark.read.schema("model string, n long, judge_avg double, latency_p95_ms double").json(f"{path}/models")
    items = spark.read.schema("model string, item_id string").json(f"{path}/items")
    return models.join(items.groupBy("model").agg(F.count("*").alias("items")), "model", "left")


@query(
    "load_items",
    """SELECT lang AS dataset_id, CAST(doc_id AS VARCHAR) AS item_id, CASE WHEN doc_id % 9 <> 0 THEN text END AS input,
      CASE WHEN doc_id % 9 = 0 THEN 'missing: input' || CASE WHEN doc_id % 2 = 0 THEN ', criteria' ELSE '' END
        WHEN doc_id % 2 = 0 THEN 'missing: criteria' END AS error FROM documents WHERE lang = 'en'""",
)
def load_items(spark, d):
    path = scratch_path(spark, "items")
    t.table(spark, d, "documents").select(
        F.col("lang").alias("dataset_id"),
        F.col("doc_id").cast("string").alias("item_id"),
        F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("input"),
        F.when(F.col("doc_id") % 2 != 0, "good").otherwise("").alias("criteria"),
        F.create_map(F.lit("temperature"), F.lit("0.2")).alias("options"),
    ).write.partitionBy("dataset_id").json(path)
    return datasets.load_items(spark, path, "en").select("dataset_id", "item_id", "input", "error")


@query(
    "load_models",
    """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'org/' || c_name ELSE c_name END AS model,
      CASE WHEN c_custkey % 3 = 1 THEN 'nvidia' ELSE 'groq' END AS provider,
      CASE WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) END AS seed FROM customer""",
)
def load_models(spark, d):
    path = scratch_path(spark, "models")
    run._model_entries(spark, d).select(F.col("entry").alias("value")).write.text(path)
    return datasets.load_models(spark, path).select(
        "model", "provider", F.try_element_at("params", F.lit("seed")).alias("seed")
    )


@query(
    "load_captured_requests",
    """SELECT sha256(text) AS prompt_hash, item_id % 2 = 0 AS thinks, CAST(NULL AS VARCHAR) AS error FROM benchmark""",
)
def load_captured_requests(spark, d):
    """One file per benchmark item."""
    path = scratch_path(spark, "captured")
    body = F.to_json(
        F.struct(
            (F.col("item_id") % 2 == 0).alias("think"),
            F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"),
        )
    )
    items = t.table(spark, d, "benchmark").select("item_id", body.alias("value"))
    items.repartition("item_id").write.partitionBy("item_id").text(path)
    loaded = datasets.load_captured_requests(spark, f"{path}/item_id=*")
    return loaded.select(
        F.sha2("prompt", 256).alias("prompt_hash"), (F.col("options")["think"] == "true").alias("thinks"), "error"
    )


@query(
    "load_images",
    """WITH files AS (SELECT page_id // 10 AS f, string_agg(url || chr(10), '' ORDER BY page_id) AS body FROM pages GROUP BY 1)
      SELECT CAST(f AS VARCHAR) AS file, CAST(strlen(body) AS BIGINT) AS length, 'application/octet-stream' AS mime,
        CASE WHEN strlen(body) <= 420 THEN 'data:application/octet-stream;base64,' || base64(encode(body)) END AS data_url,
        strlen(body) > 420 AS refused FROM files""",
)
def load_images(spark, d):
    """Ten page addresses per file as the bytes; files over the limit are refused unread."""
    path = scratch_path(spark, "images")
    pages = t.table(spark, d, "pages").select(F.floor(F.col("page_id") / 10).alias("f"), "page_id", "url")
    pages.repartition("f").sortWithinPartitions("f", "page_id").select("f", "url").write.partitionBy("f").text(path)
    images = datasets.load_images(spark, f"{path}/f=*", max_bytes=420)
    return images.select(
        F.regexp_extract("path", r"f=(\d+)", 1).alias("file"),
        "length",
        "mime",
        "data_url",
        F.col("error").isNotNull().alias("refused"),
    )


# --- streams ------------------------------------------------------------------


def _stream(spark, d, name):
    """One of the given tables as a stream of files."""
    schema = t.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query(
    "stream_scores",
    f"""WITH {r.OUTPUTS} SELECT project, observation_id, name, value_num FROM (
        SELECT observation_id, 'json-schema-valid' AS name, CAST(schema_value AS DOUBLE) AS value_num FROM schema_scores
        UNION ALL SELECT event_id, 'llm-judge-error', NULL FROM events WHERE event_id % 7 = 0
        UNION ALL SELECT event_id, 'llm-judge-score', 1 + user_id % 5 FROM events WHERE event_id % 7 <> 0
        UNION ALL SELECT event_id, 'response-truncated', CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END FROM events WHERE event_id % 4 < 3
      ), (SELECT unnest(['default', 'shared']) AS project)""",
)
def stream_scores(spark, d):
    path = scratch_path(spark, "stream-scores")
    events = _stream(spark, d, "events")
    case = F.col("observation_id") % 4
    user = F.substr("item_id", F.lit(2)).cast("long")
    responses = t.outputs_json(spark, d, events).withColumns(
        {
            "score": F.when(F.col("observation_id") % 7 != 0, 1 + user % 5).cast("double"),
            "reasoning": F.when(F.col("observation_id") % 7 != 0, "read"),
            "truncated": F.when(case < 3, case == 0),
            "done_reason": F.when(case == 0, "length"),
        }
    )
    jobs.stream_scores(
        responses, f"{path}/out", f"{path}/checkpoint", ["default", "shared"], t.SCHEMA, keys=("observation_id",)
    ).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("project", "observation_id", "name", "value_num")


@query(
    "stream_leaderboard",
    """SELECT 'eval-' || strftime(ts, '%Y-%m-%d') AS session_id, event_type AS model,
      count(*) FILTER (WHERE event_type <> 'error' AND event_id % 11 <> 0) AS n,
      round(avg(value) FILTER (WHERE event_type <> 'error' AND event_id % 11 <> 0), 6) AS mean_score,
      count(*) FILTER (WHERE event_type <> 'error' AND event_id % 11 = 0) AS unscored FROM events GROUP BY ALL""",
)
def stream_leaderboard(spark, d):
    path = scratch_path(spark, "stream-leaderboard")
    results = _stream(spark, d, "events").select(
        F.concat(F.lit("eval-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        F.col("event_type").alias("model"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("score"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
    )
    jobs.stream_leaderboard(results, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return jobs.read_leaderboard(spark, f"{path}/out")


@query(
    "stream_leaderboard_windowed",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS model, count(*) AS n, round(avg(value), 6) AS mean_score
      FROM events GROUP BY ALL""",
)
def stream_leaderboard_windowed(spark, d):
    """Per day, with a watermark that bounds the state."""
    path = scratch_path(spark, "stream-leaderboard")
    results = _stream(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("model"),
        F.col("value").alias("score"),
        F.lit(None).cast("string").alias("error"),
    )
    jobs.stream_leaderboard(
        results, f"{path}/out", f"{path}/checkpoint", by=("model",), window="1 day", watermark="1 hour"
    ).awaitTermination()
    board = jobs.read_leaderboard(spark, f"{path}/out", by=("model", "window"))
    return board.select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "model", "n", "mean_score"
    )


def _in_parts(spark, name, tables, run):
    """Lands the parts of each table one after another and runs the stream to its end after each."""
    path = scratch_path(spark, name)
    for part in range(2):
        for i, (df, belongs) in enumerate(tables):
            df.where(belongs == part).write.mode("append").parquet(f"{path}/in{i}")
        sources = [spark.readStream.schema(df.schema).parquet(f"{path}/in{i}") for i, (df, _) in enumerate(tables)]
        run(*sources, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return f"{path}/out"


@query(
    "stream_verdicts",
    """WITH v AS (SELECT event_id, ts, value, event_id % 7 <> 0 AS is_judged, ts + to_days(CAST(event_id % 5 AS INT)) AS judged_at FROM events),
      w AS (SELECT least(max(ts), max(judged_at) FILTER (is_judged)) - INTERVAL 1 DAY AS passed FROM v),
      k AS (SELECT event_id, value, CASE WHEN is_judged AND event_id % 5 <= 3 THEN 'verdict'
          WHEN is_judged AND judged_at < passed THEN 'correction'
          WHEN ts + INTERVAL 3 DAY < passed THEN 'expired' END AS kind FROM v, w)
      SELECT event_id AS observation_id, CASE WHEN kind <> 'expired' THEN value END AS score, kind FROM k WHERE kind IS NOT NULL""",
)
def stream_verdicts(spark, d):
    """Verdicts land up to four days after their reply, every other one before it in the stream."""
    events = t.table(spark, d, "events").withColumn("replied_at", F.col("ts").cast("timestamp"))
    id_, half = F.col("observation_id"), (F.dayofmonth("replied_at") > 15).cast("int")
    replies = events.select(F.col("event_id").alias("observation_id"), "replied_at")
    judged = F.col("replied_at") + F.make_interval(days=(F.col("event_id") % 5).cast("int"))
    verdicts = events.where("event_id % 7 <> 0").select(
        F.col("event_id").alias("observation_id"), "replied_at", judged.alias("judged_at"), F.col("value").alias("score")
    )
    out = _in_parts(
        spark,
        "stream-verdicts",
        [(replies, half), (verdicts, F.when(id_ % 2 == 0, 0).otherwise(half))],
        lambda a, b, path, checkpoint: live.stream_verdicts(a, b, path, checkpoint, watermark="1 day", patience="3 days"),
    )
    live.compact(spark, out, live.latest_verdict())
    return live.read_verdicts(spark, out)


@query(
    "stream_closed_sessions",
    """WITH e AS (SELECT 'eval-' || strftime(ts, '%Y-%m-%d') AS session_id, event_type AS model, ts, value,
          event_type <> 'error' AND event_id % 11 <> 0 AS scored, event_type <> 'error' AND event_id % 11 = 0 AS unscored FROM events),
      g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, FALSE) AS starts FROM e
        WINDOW w AS (PARTITION BY session_id, model ORDER BY ts)),
      i AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY session_id, model ORDER BY ts) AS island FROM g),
      c AS (SELECT session_id, model, max(ts) + INTERVAL 6 HOUR AS ended, count(*) FILTER (scored) AS n,
        sum(value) FILTER (scored) AS total, count(*) FILTER (unscored) AS unscored FROM i GROUP BY session_id, model, island)
      SELECT session_id, model, CAST(sum(n) AS BIGINT) AS n, CAST(sum(unscored) AS BIGINT) AS unscored,
        CASE WHEN sum(n) > 0 THEN round(sum(total) / sum(n), 6) END AS mean_score
      FROM c WHERE ended < (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY session_id, model""",
)
def stream_closed_sessions(spark, d):
    """Sessions are written once, when they have been idle for six hours."""
    results = t.table(spark, d, "events").select(
        F.concat(F.lit("eval-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        F.col("event_type").alias("model"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("score"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
    )
    out = _in_parts(
        spark,
        "stream-closed",
        [(results, (F.dayofmonth("ts") > 15).cast("int"))],
        lambda rows, path, checkpoint: live.stream_closed_sessions(rows, path, checkpoint, idle="6 hours", watermark="1 hour"),
    )
    return live.read_closed_sessions(spark, out).drop("first_at", "closed_at")


@query(
    "stream_progress",
    """WITH r AS (SELECT 'eval-' || strftime(ts, '%Y-%m-%d') AS session_id, coalesce(CASE WHEN event_id % 9 <> 0
          THEN CAST(round(value * 10) AS BIGINT) END, 0) AS ms FROM events)
      SELECT session_id, count(*) AS completed, count(*) + 10 AS total, CAST(10 AS BIGINT) AS remaining,
        round(avg(ms), 6) AS mean_ms, round(avg(ms) * 10, 6) AS eta_ms FROM r GROUP BY session_id""",
)
def stream_progress(spark, d):
    """Live progress of sessions that have ten replies to come."""
    results = t.table(spark, d, "events").select(
        F.concat(F.lit("eval-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        F.col("event_id"),
        F.when(F.col("event_id") % 9 != 0, F.round(F.col("value") * 10).cast("long")).alias("elapsed_ms"),
    )
    planned = results.groupBy("session_id").agg((F.count("*") + 10).alias("total"))
    out = _in_parts(
        spark,
        "stream-progress",
        [(results, F.col("event_id") % 2)],
        lambda rows, path, checkpoint: live.stream_progress(rows.join(planned, "session_id", "left"), path, checkpoint),
    )
    live.compact(spark, out, live.newest(("session_id",)))
    return live.read_progress(spark, out)

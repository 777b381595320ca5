"""Queries over stored generations and scores, and over run results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gradeloom import scratch_path
from gradeloom.functions import identity
from gradeloom.operators import matrix, quantiles, report, rollup, sinks, spread, summary
from gradeloom.plans.report import add_late_scores, rolled_report, session_report
from gradeloom.sources import bucketed, store
from workload import registry as r
from workload import tables as t
from workload.registry import query


@query("model_report", f"{r.REPORT} SELECT {r.REPORT_COLUMNS} FROM report")
def model_report(spark, d):
    return report.model_report(t.gens_events(spark, d), t.scores_events(spark, d))


@query(
    "model_report_by_provider",
    f"WITH {r.GENS}, {r.NAMED}, {r.SCORES}, {r.SCORE_TOTALS}, {r.report_cte(True)} SELECT {r.REPORT_COLUMNS} FROM report",
)
def model_report_by_provider(spark, d):
    return report.model_report(t.gens_events(spark, d), t.scores_events(spark, d), by=("model", "provider"))


LATEST = """latest AS (
  SELECT 'eval-' || strftime(ts, '%Y-%m-%d') AS session_id, min(ts) AS created_at FROM events
  WHERE day(ts) % 3 <> 0 GROUP BY 1 ORDER BY created_at DESC, session_id LIMIT 5)"""


@query(
    "session_report",
    f"""WITH {r.GENS}, {LATEST}, kept AS (SELECT * FROM gens WHERE session_id IN (SELECT session_id FROM latest)
      AND list_contains(tags, 'dataset:view')), {r.NAMED.replace("FROM gens", "FROM kept")},
      {r.SCORES}, {r.SCORE_TOTALS}, {r.report_cte()} SELECT {r.REPORT_COLUMNS} FROM report""",
)
def latest_session_report(spark, d):
    return session_report(
        t.gens_events(spark, d), t.scores_events(spark, d), t.sessions_events(spark, d), dataset_id="view"
    )


def _kept(spark, d, late):
    """Events as a store with kept totals; scores for which `late` is not false come in two parts, one of them twice."""
    base = scratch_path(spark, "kept")
    gens = t.gens_events(spark, d).withColumn("observation_id", F.col("observation_id").cast("string"))
    sinks.write_generations(gens, f"{base}/generations", "first")
    sinks.write_sessions(t.sessions_events(spark, d), f"{base}/sessions", "first")
    scores = t.scores_events(spark, d).withColumn("observation_id", F.col("observation_id").cast("string"))
    scores = scores.join(gens.select("observation_id", "session_id"), "observation_id")
    sinks.write_scores(scores.where(late == 0), f"{base}/scores", "first", gens)
    stored = store.read_generations(spark, f"{base}/generations")
    first = store.read_scores(spark, f"{base}/scores")
    for half in (F.col("session_id") < "eval-2024-01-16", F.col("session_id") >= "eval-2024-01-16"):
        rollup.write_rollup(stored.where(half), first, f"{base}/rollup", "first")
    for part in (1, 2, 2):
        add_late_scores(spark, base, scores.where(late == part), f"late-{part}")
    return base


def _late():
    return F.pmod(F.xxhash64("observation_id", "name"), F.lit(3))


@query("report_rollup", f"{r.REPORT} SELECT {r.REPORT_COLUMNS} FROM report")
def report_rollup(spark, d):
    """The report over all sessions from kept totals, to which two thirds of the scores came late."""
    return rollup.rollup_report(rollup.read_rollup(spark, f"{_kept(spark, d, _late())}/rollup"))


@query(
    "report_rollup_latest",
    f"""WITH {r.GENS}, {LATEST}, kept AS (SELECT * FROM gens WHERE session_id IN (SELECT session_id FROM latest)
      AND list_contains(tags, 'dataset:view')), {r.NAMED.replace("FROM gens", "FROM kept")},
      {r.SCORES}, {r.SCORE_TOTALS}, {r.report_cte(True)} SELECT {r.REPORT_COLUMNS} FROM report""",
)
def report_rollup_latest(spark, d):
    """Latest sessions and one dataset by model and provider, after the kept totals were compacted."""
    base = _kept(spark, d, _late())
    rollup.compact_rollup(spark, f"{base}/rollup")
    return rolled_report(spark, base, since_days=30_000, dataset_id="view", by=("model", "provider"))


SCORES_LINEITEM = """scores AS (SELECT l_orderkey AS observation_id,
    CASE l_returnflag WHEN 'A' THEN 'llm-judge-score' WHEN 'R' THEN 'llm-judge-error' ELSE 'json-schema-valid' END AS name,
    CAST(CASE l_returnflag WHEN 'A' THEN l_linenumber WHEN 'R' THEN NULL
      ELSE CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END END AS DOUBLE) AS value_num FROM lineitem)"""

ORDERS_REPORT = f"""WITH named AS (
  SELECT o_orderkey AS observation_id, o_orderpriority AS model, o_orderstatus AS provider, o_orderdate AS start_time,
    o_totalprice / 1000 * 1000 AS latency_ms, o_custkey AS tokens_in, o_orderkey AS tokens_out,
    o_totalprice / 1000000 AS total_cost FROM orders),
{SCORES_LINEITEM}, {r.SCORE_TOTALS}, {r.report_cte()} SELECT {r.REPORT_COLUMNS} FROM report"""


@query("model_report_orders", ORDERS_REPORT)
def model_report_orders(spark, d):
    return report.model_report(t.gens_orders(spark, d), t.scores_lineitem(spark, d))


@query("report_items", f"WITH {r.GENS}, {r.NAMED} SELECT model, item_id, round(latency_ms, 6) AS latency_ms FROM named")
def report_items(spark, d):
    return report.report_items(t.gens_events(spark, d))


@query(
    "parse_trace_name",
    f"""WITH {r.GENS} SELECT observation_id,
      CASE WHEN regexp_matches(trace_name, '^eval:(.*):([^:]*)$') THEN regexp_extract(trace_name, '^eval:(.*):([^:]*)$', 1) END AS model,
      CASE WHEN regexp_matches(trace_name, '^eval:(.*):([^:]*)$') THEN regexp_extract(trace_name, '^eval:(.*):([^:]*)$', 2) END AS item_id
      FROM gens""",
)
def parse_trace_name(spark, d):
    parsed = t.gens_events(spark, d).withColumn("p", identity.parse_trace_name(F.col("trace_name")))
    return parsed.select("observation_id", F.col("p.model").alias("model"), F.col("p.item_id").alias("item_id"))


@query("resolve_model_name", f"WITH {r.GENS}, {r.NAMED} SELECT observation_id, model, item_id FROM named")
def resolve_model_name(spark, d):
    return report.named_generations(t.gens_events(spark, d)).select("observation_id", "model", "item_id")


@query("latest_sessions", f"WITH {LATEST} SELECT session_id FROM latest")
def latest_sessions(spark, d):
    return report.latest_sessions(t.sessions_events(spark, d)).select("session_id")


@query(
    "read_sessions",
    """SELECT CASE WHEN day(ts) % 3 = 0 THEN 'chat-' ELSE 'eval-' END || strftime(ts, '%Y-%m-%d') AS session_id
    FROM events WHERE day(ts) % 2 = 0 GROUP BY 1 HAVING min(ts) >= TIMESTAMP '2024-01-16 00:00:00'""",
)
def read_sessions(spark, d):
    path = scratch_path(spark, "sessions")
    sinks.write_sessions(t.sessions_events(spark, d), path)
    now = dt.datetime(2024, 1, 31)
    return store.read_sessions(spark, path, 15, "production", now).select("session_id")


@query("filter_dataset", f"WITH {r.GENS} SELECT observation_id, model, tokens_out FROM gens WHERE list_contains(tags, 'dataset:purchase')")
def filter_dataset(spark, d):
    return report.filter_dataset(t.gens_events(spark, d), "purchase").select("observation_id", "model", "tokens_out")


@query("provider_from_tags", f"WITH {r.GENS}, {r.NAMED} SELECT observation_id, provider FROM named")
def provider_from_tags(spark, d):
    return t.gens_events(spark, d).select(
        "observation_id", identity.provider_from_tags(F.col("tags")).alias("provider")
    )


JOINED = """observation_id, round(judge_sum, 6) AS judge_sum, coalesce(judge_n, 0) AS judge_n,
  round(judge_min, 6) AS judge_min, round(judge_max, 6) AS judge_max, coalesce(unscored, 0) AS unscored,
  coalesce(schema_pass, 0) AS schema_pass, coalesce(schema_total, 0) AS schema_total, coalesce(truncated, 0) AS truncated"""


@query(
    "join_scores",
    f"""WITH scores AS (SELECT doc_id AS observation_id, 'llm-judge-score' AS name, CAST(1 + 4 * quality AS DOUBLE) AS value_num FROM labels
      UNION ALL SELECT doc_id, 'response-truncated', toxic FROM labels), {r.SCORE_TOTALS}
      SELECT {JOINED}, n_chars FROM (SELECT doc_id AS observation_id, n_chars FROM documents) LEFT JOIN totals USING (observation_id)""",
)
def join_scores(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("observation_id"), "n_chars")
    return report.join_scores(docs, t.scores_labels(spark, d))


@query(
    "join_scores_orders",
    f"""WITH {SCORES_LINEITEM}, {r.SCORE_TOTALS} SELECT {JOINED}, tokens_in
      FROM (SELECT o_orderkey AS observation_id, o_custkey AS tokens_in FROM orders) LEFT JOIN totals USING (observation_id)""",
)
def join_scores_orders(spark, d):
    gens = t.gens_orders(spark, d).select("observation_id", "tokens_in")
    return report.join_scores(gens, t.scores_lineitem(spark, d))


@query(
    "join_scores_bucketed",
    f"""WITH {SCORES_LINEITEM}, {r.SCORE_TOTALS} SELECT {JOINED}, tokens_in
      FROM (SELECT o_orderkey AS observation_id, o_custkey AS tokens_in FROM orders) LEFT JOIN totals USING (observation_id)""",
)
def join_scores_bucketed(spark, d):
    """Generations and folded scores are written in buckets once; joins of them shuffle nothing."""
    paths = [scratch_path(spark, name) for name in ("generations", "totals")]
    tables = [t.gens_orders(spark, d).select("observation_id", "tokens_in"), report.scores_by_observation(t.scores_lineitem(spark, d))]
    for rows, path in zip(tables, paths, strict=True):
        bucketed.write(rows, path, "observation_id")
    return report.join_score_totals(*[bucketed.read(spark, path) for path in paths])


def _report(spark, d):
    return report.model_report(t.gens_events(spark, d), t.scores_events(spark, d))


@query(
    "order_report",
    f"""{r.REPORT} SELECT model, n, round(judge_avg, 6) AS judge_avg,
      row_number() OVER (ORDER BY coalesce(judge_avg, -1) DESC, n DESC, model) AS place FROM report""",
)
def order_report(spark, d):
    # The operator's own order, made visible to a comparison of sets: ids grow from row to row.
    ordered = report.order_report(_report(spark, d)).withColumn("id", F.monotonically_increasing_id())
    placed = F.array_position(ordered.agg(F.sort_array(F.collect_list("id"))).scalar(), F.col("id"))
    return ordered.select("model", "n", "judge_avg", placed.alias("place"))


@query(
    "best_models",
    f"""{r.REPORT}, best AS (SELECT * FROM report WHERE abs(judge_avg - (SELECT max(judge_avg) FROM report)) < 0.005)
      SELECT model, round(judge_avg, 6) AS judge_avg, judge_n, (SELECT count(*) FROM best) > 1 AS tie FROM best""",
)
def best_models(spark, d):
    return report.best_models(_report(spark, d))


@query(
    "fastest_model",
    f"""{r.REPORT} SELECT model, round(latency_p50_ms, 6) AS latency_p50_ms FROM report WHERE latency_p50_ms IS NOT NULL
      ORDER BY latency_p50_ms, coalesce(judge_avg, -1) DESC, n DESC, model LIMIT 1""",
)
def fastest_model(spark, d):
    return report.fastest_model(_report(spark, d))


@query("unscored_total", f"{r.REPORT} SELECT CAST(sum(unscored) AS BIGINT) AS unscored FROM report")
def unscored_total(spark, d):
    return report.unscored_total(_report(spark, d))


@query(
    "quantile",
    """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10,
      round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95,
      round(quantile_cont(l_extendedprice, 1), 6) AS p100 FROM lineitem GROUP BY ALL""",
)
def quantile(spark, d):
    line = t.table(spark, d, "lineitem")
    wanted = {"p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    return quantiles.exact_quantiles(line, ["l_returnflag", "l_linestatus"], "l_extendedprice", wanted)


# --- run summaries ------------------------------------------------------------


@query(
    "avg_score_by_model",
    f"WITH {r.RESULTS} SELECT model, provider, round(avg(score), 6) AS avg_score, count(*) AS n FROM results WHERE error IS NULL AND score IS NOT NULL GROUP BY ALL",
)
def avg_score_by_model(spark, d):
    return summary.avg_score_by_model(t.results_documents(spark, d))


@query("unscored_count", f"WITH {r.RESULTS} SELECT count(*) AS unscored FROM results WHERE error IS NULL AND score IS NULL")
def unscored_count(spark, d):
    return summary.unscored_count(t.results_documents(spark, d))


TIMED = """timing AS (SELECT model, provider, CAST(sum(elapsed_ms) AS BIGINT) AS total_ms, max(elapsed_ms) AS slowest_ms,
  CAST(sum(coalesce(tokens_in, 0)) AS BIGINT) AS tokens_in, CAST(sum(coalesce(tokens_out, 0)) AS BIGINT) AS tokens_out,
  count(*) AS n FROM results WHERE elapsed_ms IS NOT NULL GROUP BY model, provider)"""


@query("timing_by_model", f"WITH {r.RESULTS}, {TIMED} SELECT * FROM timing")
def timing_by_model(spark, d):
    return summary.timing_by_model(t.results_documents(spark, d))


@query(
    "timing_with_total",
    f"""WITH {r.RESULTS}, {TIMED} SELECT * FROM timing UNION ALL
      SELECT 'ALL', NULL, max(started_ms + coalesce(elapsed_ms, 0)) - min(started_ms), max(elapsed_ms),
        CAST(sum(coalesce(tokens_in, 0)) FILTER (WHERE elapsed_ms IS NOT NULL) AS BIGINT),
        CAST(sum(coalesce(tokens_out, 0)) FILTER (WHERE elapsed_ms IS NOT NULL) AS BIGINT), count(*) FROM results""",
)
def timing_with_total(spark, d):
    return summary.timing_with_total(t.results_documents(spark, d))


@query(
    "slowest_fastest",
    f"""WITH {r.RESULTS}, {TIMED} SELECT
      first(model ORDER BY total_ms DESC, model, provider) AS slowest_model,
      first(provider ORDER BY total_ms DESC, model, provider) AS slowest_provider, max(total_ms) AS slowest_ms,
      first(model ORDER BY total_ms, model, provider) AS fastest_model,
      first(provider ORDER BY total_ms, model, provider) AS fastest_provider, min(total_ms) AS fastest_ms
      FROM timing HAVING count(*) > 1""",
)
def slowest_fastest(spark, d):
    return summary.slowest_fastest(summary.timing_by_model(t.results_documents(spark, d)))


@query(
    "result_status",
    f"""WITH {r.RESULTS} SELECT observation_id,
      CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN score IS NULL THEN 'UNSCORED' ELSE 'SCORED' END AS status,
      CASE WHEN error IS NOT NULL THEN 'ERROR - ' || error WHEN score IS NULL THEN 'UNSCORED - ' || reasoning
        ELSE 'score=' || CAST(score AS BIGINT) || '/5 - ' || reasoning END AS summary FROM results""",
)
def result_status(spark, d):
    return summary.result_status(t.results_documents(spark, d)).select("observation_id", "status", "summary")


@query(
    "classify_errors",
    f"WITH {r.RESULTS} SELECT observation_id, error AS message, regexp_matches(error, '\\((401|403)\\b') AS fatal FROM results WHERE error IS NOT NULL",
)
def classify_errors(spark, d):
    failures = t.results_documents(spark, d).where("error IS NOT NULL")
    return summary.classify_errors(failures.select("observation_id", F.col("error").alias("message")))


@query("truncated_results", f"WITH {r.RESULTS} SELECT model, provider, item_id FROM results WHERE error IS NULL AND truncated")
def truncated_results(spark, d):
    return summary.truncated_results(t.results_documents(spark, d)).select("model", "provider", "item_id")


@query(
    "progress",
    """WITH r AS (SELECT *, 'eval-' || strftime(ts, '%Y-%m-%d') AS session_id,
        CASE WHEN event_id % 9 <> 0 THEN CAST(round(value * 10) AS BIGINT) END AS elapsed_ms FROM events),
      p AS (SELECT session_id, event_id + 1 AS position, elapsed_ms,
        count(*) OVER w AS completed, count(*) OVER (PARTITION BY session_id) AS total,
        avg(coalesce(elapsed_ms, 0)) OVER w AS mean_ms
        FROM r WINDOW w AS (PARTITION BY session_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
      SELECT session_id, position, elapsed_ms, completed, total, total - completed AS remaining,
        round(mean_ms, 6) AS mean_ms, CASE WHEN total > completed THEN round(mean_ms * (total - completed), 6) END AS eta_ms FROM p""",
)
def progress(spark, d):
    e = t.table(spark, d, "events")
    results = e.select(
        F.concat(F.lit("eval-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        (F.col("event_id") + 1).alias("position"),
        F.when(F.col("event_id") % 9 != 0, F.round(F.col("value") * 10).cast("long")).alias("elapsed_ms"),
    )
    return summary.progress(results, chunk=64)


@query(
    "with_row_index",
    "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_index FROM orders",
)
def with_row_index(spark, d):
    return spread.with_row_index(t.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "row_index").select(
        "o_orderkey", F.col("row_index").cast("long").alias("row_index")
    )


@query(
    "combine_models",
    """WITH listed AS (SELECT s_name AS model, 'ollama' AS provider, 0 AS list_rank FROM supplier
      UNION ALL SELECT c_mktsegment, 'groq', 1 FROM customer) SELECT * FROM listed""",
)
def combine_models(spark, d):
    local = t.table(spark, d, "supplier").select(F.col("s_name").alias("model"), F.lit("ollama").alias("provider"))
    hosted = t.table(spark, d, "customer").select(F.col("c_mktsegment").alias("model"), F.lit("groq").alias("provider"))
    return matrix.combine_models(local, hosted)

"""Registry of queries with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; doubles are rounded, as float sums differ in the last digit."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(f"`{f.name}`", 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def lit(text: str) -> str:
    """A text as SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# --- the SQL side of workload/tables.py ---------------------------------------

GENS = """gens AS (
  SELECT event_id AS observation_id, 'eval-' || strftime(ts, '%Y-%m-%d') AS session_id,
    CASE WHEN event_id % 50 = 0 THEN 'other'
         ELSE 'eval:m:' || (user_id % 7) || ':' || event_type END AS trace_name,
    CASE WHEN user_id % 5 = 0 THEN '' WHEN user_id % 5 = 1 THEN NULL
         ELSE 'm:' || (user_id % 7) END AS model,
    CASE WHEN event_id % 40 = 7 THEN NULL
         ELSE ['dataset:' || event_type, 'provider:p:' || (user_id % 3)] END AS tags,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE value / 100 END AS latency,
    user_id AS tokens_in, event_id % 100 AS tokens_out, value / 1000 AS total_cost,
    ts AS start_time, props AS output
  FROM events)"""

NAMED = """named AS (
  SELECT * REPLACE (coalesce(nullif(model, ''),
      nullif(regexp_extract(trace_name, '^eval:(.*):([^:]*)$', 1), ''), '(unknown)') AS model),
    CASE WHEN regexp_matches(trace_name, '^eval:(.*):([^:]*)$')
         THEN regexp_extract(trace_name, '^eval:(.*):([^:]*)$', 2) ELSE '(unknown)' END AS item_id,
    substr(list_filter(tags, lambda t: starts_with(t, 'provider:'))[1], 10) AS provider,
    latency * 1000 AS latency_ms
  FROM gens)"""

SCORES = """scores AS (
  SELECT event_id AS observation_id,
    CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN 'llm-judge-error' ELSE 'llm-judge-score' END AS name,
    CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN NULL
         ELSE CAST(1 + event_id % 5 AS DOUBLE) END AS value_num
  FROM events
  UNION ALL SELECT event_id, 'json-schema-valid', CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END
  FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT event_id, 'response-truncated', CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END
  FROM events WHERE event_type IN ('view', 'click')
  UNION ALL SELECT NULL, 'llm-judge-score', 5 FROM events WHERE event_id % 101 = 0)"""

SCORE_TOTALS = """totals AS (
  SELECT observation_id,
    sum(value_num) FILTER (WHERE name = 'llm-judge-score') AS judge_sum,
    count(value_num) FILTER (WHERE name = 'llm-judge-score') AS judge_n,
    min(value_num) FILTER (WHERE name = 'llm-judge-score') AS judge_min,
    max(value_num) FILTER (WHERE name = 'llm-judge-score') AS judge_max,
    count(*) FILTER (WHERE name = 'llm-judge-error') AS unscored,
    count(*) FILTER (WHERE name = 'json-schema-valid' AND value_num = 1) AS schema_pass,
    count(*) FILTER (WHERE name = 'json-schema-valid') AS schema_total,
    count(*) FILTER (WHERE name = 'response-truncated' AND value_num = 1) AS truncated
  FROM scores WHERE observation_id IS NOT NULL GROUP BY observation_id)"""


def report_cte(by_provider: bool = False, source: str = "named") -> str:
    keys = "model, provider" if by_provider else "model"
    provider = (
        ""
        if by_provider
        else "first(provider ORDER BY start_time, provider) FILTER (WHERE provider IS NOT NULL) AS provider,"
    )
    return f"""report AS (
  SELECT {keys}, {provider} count(*) AS n,
    sum(judge_sum) / nullif(sum(judge_n), 0) AS judge_avg,
    min(judge_min) AS judge_min, max(judge_max) AS judge_max,
    CAST(coalesce(sum(judge_n), 0) AS BIGINT) AS judge_n,
    CAST(coalesce(sum(unscored), 0) AS BIGINT) AS unscored,
    CAST(coalesce(sum(schema_pass), 0) AS BIGINT) AS schema_pass,
    CAST(coalesce(sum(schema_total), 0) AS BIGINT) AS schema_total,
    CAST(coalesce(sum(truncated), 0) AS BIGINT) AS truncated,
    avg(latency_ms) AS latency_mean_ms,
    quantile_cont(latency_ms, 0.5) AS latency_p50_ms,
    quantile_cont(latency_ms, 0.95) AS latency_p95_ms,
    CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in,
    CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out,
    coalesce(sum(total_cost), 0) AS cost
  FROM {source} LEFT JOIN totals USING (observation_id) GROUP BY {keys})"""


REPORT_COLUMNS = """model, provider, n, round(judge_avg, 6) AS judge_avg, round(judge_min, 6) AS judge_min,
  round(judge_max, 6) AS judge_max, judge_n, unscored, schema_pass, schema_total, truncated,
  round(latency_mean_ms, 6) AS latency_mean_ms, round(latency_p50_ms, 6) AS latency_p50_ms,
  round(latency_p95_ms, 6) AS latency_p95_ms, tokens_in, tokens_out, round(cost, 6) AS cost"""

REPORT = f"WITH {GENS}, {NAMED}, {SCORES}, {SCORE_TOTALS}, {report_cte()}"

RESULTS = """results AS (
  SELECT d.doc_id AS observation_id, 'eval-' || (d.doc_id % 4) AS session_id, source AS model, lang AS provider,
    'item-' || d.doc_id AS item_id, 'Write a text.' AS input, 'It must read well.' AS criteria,
    CASE WHEN d.doc_id % 23 <> 0 THEN text END AS output,
    CASE WHEN d.doc_id % 23 = 0 THEN 'API error (' || CASE WHEN d.doc_id % 2 = 0 THEN '401' ELSE '500' END
      || ' on model "' || source || '"): refused' END AS error,
    CASE WHEN d.doc_id % 23 <> 0 THEN CAST(1 + 4 * quality AS DOUBLE) END AS score,
    CASE WHEN d.doc_id % 23 <> 0 THEN CASE WHEN quality IS NULL THEN 'no verdict' ELSE 'label' END END AS reasoning,
    CASE WHEN d.doc_id % 23 <> 0 THEN toxic = 1 END AS truncated,
    CASE WHEN toxic = 1 THEN 'length' END AS done_reason,
    d.doc_id % 23 <> 0 AND d.doc_id % 29 = 0 AS judge_failed,
    CASE WHEN d.doc_id % 17 <> 0 THEN n_chars % 5000 END AS elapsed_ms,
    d.doc_id * 10 AS started_ms,
    CASE WHEN d.doc_id % 5 <> 0 THEN d.doc_id % 300 END AS tokens_in,
    CASE WHEN d.doc_id % 5 <> 0 THEN n_chars END AS tokens_out,
    CASE WHEN d.doc_id % 5 <> 0 THEN d.doc_id % 300 + n_chars END AS tokens_total
  FROM documents d LEFT JOIN labels USING (doc_id))"""

PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS input, a.text AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

PAIR_MATRIX = f"""{PAIRS}, matrix AS (
  SELECT 'org/model:' || (conv_id % 2) AS model,
    ['groq', 'nvidia', 'gemini', 'ollama'][conv_id % 4 + 1] AS provider,
    'c-' || conv_id || '-' || turn AS item_id,
    CASE WHEN turn % 2 = 0 THEN 'text' ELSE 'image' END AS dataset_id, conv_id, turn, input,
    'It must answer the question.' AS criteria, output,
    CASE WHEN conv_id % 3 = 0 THEN 'data:image/png;base64,' || base64(encode(input)) END AS image
  FROM pairs)"""

OUTPUTS = """bodies AS (
  SELECT event_id, event_type, user_id, event_id % 12 AS c,
    '{"event":"' || event_type || '","amount":' ||
    CASE WHEN event_id % 12 = 5 THEN '"' || (event_id % 100) || '"' ELSE (event_id % 100) || '.5' END ||
    ',"codes":[' ||
    CASE WHEN event_id % 12 = 7 THEN '"a",' || (event_id % 100) || ',null' ELSE '"p' || (event_id % 100) || '"' END || ']' ||
    CASE event_id % 12 WHEN 6 THEN ''
      WHEN 8 THEN ',"origin":{"page":"s","rank":1.5,"extra":' || props || '}'
      ELSE ',"origin":{"page":"s","rank":' || (event_id % 100) || '}' END || '}' AS body
  FROM events),
outputs AS (
  SELECT event_id AS observation_id, event_type AS model, 'p' || (user_id % 3) AS provider,
    'i' || user_id AS item_id, c,
    CASE c WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
      WHEN 2 THEN 'Here you go: ' || body || ' Hope that helps.'
      WHEN 3 THEN body || chr(10) || chr(10) || 'That is all.'
      WHEN 4 THEN left(body, length(body) - 2) || ' '
      WHEN 9 THEN '  ' || chr(10) || ' '
      WHEN 10 THEN 'Result:' || chr(10) || '```' || chr(10) || body || chr(10) || '```' || chr(10) || 'Done.'
      WHEN 11 THEN 'I cannot do that.' ELSE body END AS output
  FROM bodies),
candidates AS (
  SELECT *, trim(output, ' ' || chr(10)) AS whole,
    trim(regexp_extract(output, '(?is)```(?:json)?\\s*(.*?)```', 1), ' ' || chr(10)) AS fenced,
    CASE WHEN strpos(output, '{') > 0 AND strpos(reverse(output), '}') > 0
         THEN substr(output, strpos(output, '{'),
                length(output) - strpos(reverse(output), '}') + 2 - strpos(output, '{')) ELSE '' END AS span
  FROM outputs),
parsed AS (
  SELECT *, CASE WHEN json_valid(whole) THEN whole WHEN json_valid(fenced) THEN fenced
                 WHEN json_valid(span) THEN span END AS doc
  FROM candidates),
checks AS (
  SELECT *, json_type(doc, '$.amount') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AS amount_ok,
    json_extract_string(doc, '$.event') IN ('view', 'click', 'purchase', 'signup') AS event_ok,
    json_type(doc, '$.origin') IS NOT NULL AS has_origin,
    coalesce(json_extract_string(doc, '$.origin.rank') NOT LIKE '%.5', true) AS rank_ok,
    json_type(doc, '$.origin.extra') IS NOT NULL AS has_extra,
    CAST(json_array_length(doc, '$.codes') AS BIGINT) AS codes,
    len(list_filter(json_extract(doc, '$.codes[*]'), lambda x: json_type(x) <> 'VARCHAR')) AS bad_codes
  FROM parsed),
problems AS (
  SELECT observation_id, 1 AS ord, 0 AS i, '$.origin' AS path, 'required property is missing' AS problem, true AS counted
  FROM checks WHERE doc IS NOT NULL AND NOT has_origin
  UNION ALL SELECT observation_id, 2, 0, '$.event',
    '"' || json_extract_string(doc, '$.event') || '" is not one of ["view","click","purchase","signup"]', true
  FROM checks WHERE doc IS NOT NULL AND NOT event_ok
  UNION ALL SELECT observation_id, 3, 0, '$.amount', 'expected number, got string', true
  FROM checks WHERE doc IS NOT NULL AND NOT amount_ok
  UNION ALL SELECT observation_id, 4, u.i, '$.codes[' || u.i || ']', 'expected string, got ' ||
    CASE json_type(doc, '$.codes[' || u.i || ']') WHEN 'NULL' THEN 'null' ELSE 'number' END, true
  FROM checks, range(3) u(i)
  WHERE doc IS NOT NULL AND u.i < codes AND json_type(doc, '$.codes[' || u.i || ']') <> 'VARCHAR'
  UNION ALL SELECT observation_id, 5, 0, '$.origin.extra', 'unexpected property', false
  FROM checks WHERE doc IS NOT NULL AND has_extra
  UNION ALL SELECT observation_id, 6, 0, '$.origin.rank', 'expected integer, got number', true
  FROM checks WHERE doc IS NOT NULL AND has_origin AND NOT rank_ok),
folded AS (
  SELECT observation_id, count(*) AS n_errors, count(*) FILTER (WHERE counted) AS n_counted,
    string_agg(path || ': ' || problem, '; ' ORDER BY ord, i) AS errors
  FROM problems GROUP BY observation_id),
judged AS (
  SELECT p.*, coalesce(f.n_errors, 0) AS n_errors, coalesce(f.errors, '') AS errors,
    CASE WHEN doc IS NOT NULL THEN 5 + 2 + 1 + 1 + codes + CASE WHEN has_origin THEN 1 + 1 + 2 ELSE 0 END END AS checked,
    CASE WHEN doc IS NOT NULL THEN 5 + 2 + 1 + 1 + codes + CASE WHEN has_origin THEN 1 + 1 + 2 ELSE 0 END
      - coalesce(f.n_counted, 0) END AS passed
  FROM checks p LEFT JOIN folded f USING (observation_id)),
schema_scores AS (
  SELECT *, CASE WHEN doc IS NOT NULL AND n_errors = 0 THEN 1 ELSE 0 END AS schema_value,
    CASE WHEN doc IS NULL THEN 'Not parseable as JSON: ' ||
           CASE WHEN whole = '' THEN 'empty response' ELSE 'output is not parseable JSON' END ||
           '. First 200 chars: ' || left(output, 200)
         WHEN n_errors = 0 THEN 'Valid JSON matching the schema (' || passed || '/' || checked || ' constraints checked).'
         ELSE 'Valid JSON but does not match the schema (' || n_errors || ' problem(s), ' || passed || '/' || checked
           || ' constraints passed): ' || errors END AS schema_comment
  FROM judged)"""

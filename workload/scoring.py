"""Queries that score responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import json_text
from gradeloom.operators import judging, scoring, summary
from workload import registry as r
from workload import tables as t
from workload.registry import query

FIELDS = {"event": "$.event", "amount": "$.amount", "code": "$.codes[0]", "rank": "$.origin.rank"}


@query(
    "extract_json_loose",
    f"""WITH {r.OUTPUTS} SELECT observation_id, doc IS NOT NULL AS parsed,
      {", ".join(f"json_extract_string(doc, '{p}') AS {n}" for n, p in FIELDS.items())} FROM parsed""",
)
def extract_json_loose(spark, d):
    parsed = t.outputs_json(spark, d).withColumn("doc", json_text.extract_json_loose(F.col("output")))
    return parsed.select(
        "observation_id",
        F.col("doc").isNotNull().alias("parsed"),
        *[F.try_variant_get("doc", p, "string").alias(n) for n, p in FIELDS.items()],
    )


@query(
    "validate_json",
    f"""WITH {r.OUTPUTS} SELECT observation_id, n_errors = 0 AS valid, CAST(checked AS INTEGER) AS checked,
      CAST(passed AS INTEGER) AS passed, errors FROM judged WHERE doc IS NOT NULL""",
)
def validate_json(spark, d):
    parsed = t.outputs_json(spark, d).withColumn("doc", json_text.extract_json_loose(F.col("output")))
    checked = scoring.validate_json(parsed.where("doc IS NOT NULL"), "doc", t.SCHEMA)
    return checked.select(
        "observation_id", "valid", "checked", "passed", F.array_join("errors", "; ").alias("errors")
    )


@query(
    "score_json_schema",
    f"""WITH {r.OUTPUTS} SELECT observation_id, 'json-schema-valid' AS name, CAST(schema_value AS DOUBLE) AS value_num,
      CAST(NULL AS VARCHAR) AS value_str, 'NUMERIC' AS data_type, schema_comment AS comment FROM schema_scores""",
)
def score_json_schema(spark, d):
    return scoring.score_json_schema(t.outputs_json(spark, d), t.SCHEMA)


@query(
    "score_json_schema_by_id",
    f"""WITH {r.OUTPUTS} SELECT observation_id, CAST(CASE model WHEN 'view' THEN schema_value
        ELSE CASE WHEN doc IS NOT NULL THEN 1 ELSE 0 END END AS DOUBLE) AS value_num
      FROM schema_scores WHERE model IN ('view', 'click')""",
)
def score_json_schema_by_id(spark, d):
    """Two schemas by id; rows with another id get no score."""
    outputs = t.outputs_json(spark, d).withColumn("schema_id", F.col("model"))
    scores = scoring.score_json_schema(outputs, schemas={"view": t.SCHEMA, "click": {"type": "object"}})
    return scores.select("observation_id", "value_num")


@query("schema_violations", f"WITH {r.OUTPUTS} SELECT observation_id, path, problem FROM problems")
def schema_violations(spark, d):
    return scoring.schema_violations(t.outputs_json(spark, d), t.SCHEMA)


def _schema_results(spark, d):
    outputs = t.outputs_json(spark, d)
    score = scoring.schema_score(t.SCHEMA)(outputs)
    return outputs.withColumn("_s", score).withColumns(
        {"schema_value": F.col("_s.value_num"), "schema_comment": F.col("_s.comment")}
    )


@query(
    "schema_validity_by_model",
    f"WITH {r.OUTPUTS} SELECT model, provider, CAST(sum(schema_value) AS BIGINT) AS passed, count(*) AS total FROM schema_scores GROUP BY ALL",
)
def schema_validity_by_model(spark, d):
    return summary.schema_validity_by_model(_schema_results(spark, d))


@query(
    "schema_failures",
    f"WITH {r.OUTPUTS} SELECT model, provider, item_id, schema_comment FROM schema_scores WHERE schema_value = 0",
)
def schema_failures(spark, d):
    return summary.schema_failures(_schema_results(spark, d))


@query(
    "schema_fields",
    """SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'a' || page_id || ',url' END AS fields FROM pages""",
)
def schema_fields(spark, d):
    """Schema texts made from page ids; one in three does not describe an object."""
    pages = t.table(spark, d, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "array").otherwise("object")
    schema = F.concat(
        F.lit('{"type":"'), kind, F.lit('","properties":{"a'), F.col("page_id").cast("string"),
        F.lit('":{"type":"string"},"url":{}}}'),
    )
    return pages.select("page_id", F.array_join(json_text.schema_fields(schema), ",").alias("fields"))


VERDICTS = """verdicts AS (
  SELECT event_id AS observation_id, event_id % 12 AS c, 1 + user_id % 5 AS s, event_type,
    '{"score": ' || (1 + user_id % 5) || ', "reasoning": "' || event_type || '."}' AS body FROM events),
texts AS (SELECT *, CASE c WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
    WHEN 2 THEN '  ```' || chr(10) || body || chr(10) || '```  ' WHEN 3 THEN 'I think it is good.'
    WHEN 4 THEN '{"score": "excellent", "reasoning": "x"}' WHEN 5 THEN '{"score": "' || s || '.5"}'
    WHEN 6 THEN '{"score": null, "reasoning": "none"}' WHEN 7 THEN body || ' trailing'
    WHEN 8 THEN '{"score": 9, "reasoning": null}' WHEN 9 THEN '{"score": true}'
    WHEN 10 THEN left(body, 12) ELSE body END AS content FROM verdicts),
read AS (SELECT observation_id, CAST(CASE WHEN c IN (0, 1, 2, 11) THEN s WHEN c = 5 THEN s + 0.5 WHEN c = 8 THEN 9 END AS DOUBLE) AS score,
    CASE WHEN c IN (0, 1, 2, 11) THEN event_type || '.' WHEN c IN (5, 8) THEN ''
      WHEN c = 10 THEN 'Judge response was truncated at 512 tokens, so no verdict could be read. Raw: ' || content
      WHEN c IN (3, 7) THEN 'Failed to parse judge output (not valid JSON). Raw: ' || content
      ELSE 'Failed to parse judge output (score is not a finite number). Raw: ' || content END AS reasoning FROM texts)"""


@query("parse_verdicts", f"WITH {VERDICTS} SELECT observation_id, round(score, 6) AS score, reasoning FROM read")
def parse_verdicts(spark, d):
    return judging.parse_verdicts(t.verdict_texts(spark, d)).select("observation_id", "score", "reasoning")


@query(
    "build_judge_scores",
    f"""WITH {VERDICTS} SELECT observation_id, CASE WHEN score IS NULL THEN 'llm-judge-error' ELSE 'llm-judge-score' END AS name,
      score AS value_num, CASE WHEN score IS NULL THEN 'unscored' END AS value_str,
      CASE WHEN score IS NULL THEN 'CATEGORICAL' ELSE 'NUMERIC' END AS data_type, reasoning AS comment FROM read""",
)
def build_judge_scores(spark, d):
    return scoring.build_judge_scores(judging.parse_verdicts(t.verdict_texts(spark, d)))


TRUNCATION = """SELECT observation_id, 'response-truncated' AS name, CASE WHEN truncated THEN 1.0 ELSE 0.0 END::DOUBLE AS value_num,
  CAST(NULL AS VARCHAR) AS value_str, 'NUMERIC' AS data_type,
  CASE WHEN truncated THEN 'Provider stopped generation early (done_reason: length). The output is incomplete.'
    ELSE 'Provider finished normally (done_reason: stop).' END AS comment
  FROM results WHERE error IS NULL AND truncated IS NOT NULL"""


@query("truncation_scores", f"WITH {r.RESULTS} {TRUNCATION}")
def truncation_scores(spark, d):
    return scoring.truncation_scores(t.results_documents(spark, d))


ALL_SCORES = f"""SELECT observation_id, CASE WHEN score IS NULL THEN 'llm-judge-error' ELSE 'llm-judge-score' END AS name,
  score AS value_num, CASE WHEN score IS NULL THEN 'unscored' END AS value_str,
  CASE WHEN score IS NULL THEN 'CATEGORICAL' ELSE 'NUMERIC' END AS data_type, reasoning AS comment
  FROM results WHERE error IS NULL
  UNION ALL SELECT observation_id, 'json-schema-valid', 0.0, NULL, 'NUMERIC',
    'Not parseable as JSON: output is not parseable JSON. First 200 chars: ' || left(output, 200)
  FROM results WHERE error IS NULL
  UNION ALL {TRUNCATION}"""


@query("all_scores", f"WITH {r.RESULTS} {ALL_SCORES}")
def all_scores(spark, d):
    """Prose answers where JSON was wanted: every schema score is 0, with its cause."""
    return scoring.all_scores(t.results_documents(spark, d), t.SCHEMA)


@query(
    "register_scorer",
    f"""WITH {r.PAIRS} SELECT conv_id, turn, 'exact-match' AS name, CAST(turn % 2 = 0 AS INTEGER)::DOUBLE AS value_num,
      CASE WHEN turn % 2 = 0 THEN 'equal' ELSE 'different' END AS comment FROM pairs
      UNION ALL SELECT conv_id, turn, 'regex-match', CAST(regexp_matches(output, '[0-9]') AS INTEGER)::DOUBLE, 'pattern: [0-9]' FROM pairs
      UNION ALL SELECT conv_id, turn, 'reply-length', length(output)::DOUBLE, NULL FROM pairs""",
)
def register_scorer(spark, d):
    """The two built-in scorers and one registered by name."""
    expected = F.when(F.col("turn") % 2 == 0, F.col("output")).otherwise(F.concat("output", F.lit("?")))
    answers = t.pairs(spark, d).withColumn("expected", expected)
    scoring.register_scorer(
        "reply-length",
        lambda df: scoring.numeric_score("reply-length", F.length("output"), F.lit(None)),
    )
    scorers = [scoring.score_exact(), scoring.score_regex("[0-9]"), "reply-length"]
    rows = scoring.score_rows(answers, scorers, keys=("conv_id", "turn"))
    return rows.select("conv_id", "turn", "name", "value_num", "comment")

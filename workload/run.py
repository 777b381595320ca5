"""Queries of a run: matrix, preflight, requests, replies, verdicts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gradeloom import fixed, schemas, scratch_path
from gradeloom.functions import identity
from gradeloom.operators import inference, judging, matrix, media, observations, preflight, requests, responses, spread, summary
from gradeloom.plans import evaluation
from gradeloom.plans import preflight as preflight_plan
from gradeloom.plans.report import stored_report
from gradeloom.sources import commits, datasets
from workload import clients
from workload import registry as r
from workload import tables as t
from workload.registry import lit, query


def _text(column):
    return column.cast("string")


# --- matrix and preflight -----------------------------------------------------


@query(
    "eval_matrix",
    """WITH models AS (SELECT source AS model, row_number() OVER (ORDER BY source) - 1 AS model_index FROM (SELECT DISTINCT source FROM documents)),
      items AS (SELECT doc_id AS item_id, row_number() OVER (ORDER BY doc_id) - 1 AS item_index FROM documents)
      SELECT model, item_id, model_index * (SELECT count(*) FROM items) + item_index + 1 AS position FROM models, items""",
)
def eval_matrix(spark, d):
    docs = t.table(spark, d, "documents")
    models = spread.with_row_index(docs.select(F.col("source").alias("model")).distinct(), "model", "model_index")
    items = spread.with_row_index(docs.select(F.col("doc_id").alias("item_id")), "item_id", "item_index")
    return matrix.eval_matrix(models, items).select("model", "item_id", "position")


def _model_entries(spark, d):
    c = t.table(spark, d, "customer")
    key = _text(F.col("c_custkey"))
    entry = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"org/'), F.col("c_name"), F.lit('"')))
        .when(
            F.col("c_custkey") % 3 == 1,
            F.concat(F.lit('{"id":"'), F.col("c_name"), F.lit('","provider":"nvidia","reasoning_effort":"max","seed":'), key, F.lit("}")),
        )
        .otherwise(F.concat(F.lit('{"id":"'), F.col("c_name"), F.lit('"}')))
    )
    return c.select("c_custkey", entry.alias("entry"))


@query(
    "normalize_models",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'org/' || c_name ELSE c_name END AS model,
      CASE WHEN c_custkey % 3 = 1 THEN 'nvidia' ELSE 'groq' END AS provider,
      CASE WHEN c_custkey % 3 = 1 THEN 'max' END AS effort, CASE WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) END AS seed,
      c_custkey % 3 <> 1 AS plain FROM customer""",
)
def normalize_models(spark, d):
    models = matrix.normalize_models(_model_entries(spark, d))
    return models.select(
        "c_custkey",
        "model",
        "provider",
        F.try_element_at("params", F.lit("reasoning_effort")).alias("effort"),
        F.try_element_at("params", F.lit("seed")).alias("seed"),
        F.col("params").isNull().alias("plain"),
    )


MODELS = """models AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment ELSE c_name END AS model,
  ['groq', 'nvidia', 'gemini', 'ollama'][c_nationkey % 4 + 1] AS provider FROM customer)"""


@query("filter_enabled", f"WITH {MODELS} SELECT * FROM models WHERE provider IN ('groq', 'ollama')")
def filter_enabled(spark, d):
    return matrix.filter_enabled(t.model_list(spark, d), " groq, ,ollama")


@query("skipped_providers", f"WITH {MODELS} SELECT DISTINCT provider FROM models WHERE provider NOT IN ('groq', 'ollama')")
def skipped_providers(spark, d):
    return matrix.skipped_providers(t.model_list(spark, d), ["groq", "ollama"])


CATALOG = """catalog AS (SELECT DISTINCT c_name AS model, ['groq', 'nvidia', 'gemini', 'ollama'][c_nationkey % 4 + 1] AS provider,
  c_acctbal > 5000 AS vision FROM customer WHERE c_nationkey < 20)"""


def _catalog(spark, d):
    c = t.table(spark, d, "customer").where("c_nationkey < 20")
    provider = F.element_at(F.array(*[F.lit(p) for p in fixed.PROVIDERS]), F.col("c_nationkey") % 4 + 1)
    capabilities = F.when(F.col("c_acctbal") > 5000, F.array(F.lit("completion"), F.lit("vision"))).otherwise(
        F.array(F.lit("completion"))
    )
    return c.select(F.col("c_name").alias("model"), provider.alias("provider"), capabilities.alias("capabilities"))


@query(
    "missing_models",
    f"WITH {MODELS}, {CATALOG} SELECT DISTINCT provider, model FROM models ANTI JOIN catalog USING (provider, model)",
)
def missing_models(spark, d):
    return preflight.missing_models(t.model_list(spark, d), _catalog(spark, d))


@query(
    "not_vision_capable",
    f"WITH {MODELS}, {CATALOG} SELECT DISTINCT provider, model FROM models JOIN catalog USING (provider, model) WHERE NOT vision",
)
def not_vision_capable(spark, d):
    return preflight.not_vision_capable(t.model_list(spark, d), _catalog(spark, d))


@query(
    "preflight",
    f"""WITH {MODELS}, {CATALOG}, asked AS (SELECT provider, model FROM models UNION SELECT 'groq', 'openai/gpt-oss-20b')
      SELECT 'missing' AS "check", provider, model AS name, CAST(NULL AS VARCHAR) AS message, true AS fatal FROM asked ANTI JOIN catalog USING (provider, model)
      UNION ALL SELECT 'probe', provider, min(model), CASE provider WHEN 'nvidia' THEN 'API error (403)' ELSE 'API error (500)' END, provider = 'nvidia'
        FROM asked WHERE provider IN ('nvidia', 'gemini') GROUP BY provider
      UNION ALL SELECT DISTINCT 'vision', provider, model, NULL, false FROM models JOIN catalog USING (provider, model) WHERE NOT vision""",
)
def preflight_findings(spark, d):
    """Models of a run and its judge; one provider refuses the key, one is out of order."""
    listed = _catalog(spark, d)
    return preflight_plan.preflight(
        t.model_list(spark, d), listed, clients.probed_client, details=listed, max_concurrency=2, max_retries=0
    )


@query(
    "preflight_live",
    f"""WITH {MODELS}, asked AS (SELECT provider, model FROM models UNION SELECT 'groq', 'openai/gpt-oss-20b'),
      listed AS (SELECT 'Customer#' || lpad(CAST(n AS VARCHAR), 9, '0') AS model, n FROM range(1000) AS r(n) WHERE n % 4 <> 0)
      SELECT 'missing' AS "check", provider, model AS name, CAST(NULL AS VARCHAR) AS message, true AS fatal
        FROM asked WHERE provider <> 'nvidia' AND model NOT IN (SELECT model FROM listed)
      UNION ALL SELECT 'listing', 'nvidia', NULL, 'API error (503)', true FROM (SELECT 1 FROM asked WHERE provider = 'nvidia' LIMIT 1)
      UNION ALL SELECT 'probe', provider, min(model), CASE provider WHEN 'nvidia' THEN 'API error (403)' ELSE 'API error (500)' END, provider = 'nvidia'
        FROM asked WHERE provider IN ('nvidia', 'gemini') GROUP BY provider
      UNION ALL SELECT DISTINCT 'vision', provider, model, NULL, false FROM models JOIN listed USING (model) WHERE provider = 'ollama' AND n % 2 = 0""",
)
def preflight_live(spark, d):
    """The same models against catalogs that providers list page by page; one provider's listing breaks off."""
    return preflight_plan.live_preflight(
        t.model_list(spark, d), clients.customer_lister, clients.probed_client, vision=True, max_concurrency=2, max_retries=1
    )


def _catalog_replies(spark, d):
    """One catalog reply per supplier, in the shape of its provider."""
    s = t.table(spark, d, "supplier")
    key = _text(F.col("s_suppkey"))
    provider = F.element_at(F.array(*[F.lit(p) for p in fixed.PROVIDERS]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    raw = (
        F.when(provider == "ollama", F.concat(
            F.lit('{"models":[{"name":"a:'), key, F.lit('","model":"a:'), key,
            F.lit('","capabilities":["vision"]},{"name":"b:'), key, F.lit('"}]}')))
        .when(provider == "gemini", F.concat(
            F.lit('{"models":[{"name":"models/g-'), key,
            F.lit('","supportedGenerationMethods":["embedContent","generateContent"]},{"name":"models/e-'), key,
            F.lit('","supportedGenerationMethods":["embedContent"]},{"name":"models/n-'), key, F.lit('"}]}')))
        .otherwise(F.concat(
            F.lit('{"data":[{"id":"'), F.col("s_name"), F.lit('"},{"id":"shared"},{"object":"model"}]}')))
    )
    return s.select(provider.alias("provider"), raw.alias("raw"))


@query(
    "catalog_ids",
    """WITH s AS (SELECT s_suppkey AS k, s_name, ['groq', 'nvidia', 'gemini', 'ollama'][s_suppkey % 4 + 1] AS provider FROM supplier)
      SELECT DISTINCT provider, model FROM (
        SELECT provider, unnest([s_name, 'shared']) AS model FROM s WHERE provider IN ('groq', 'nvidia')
        UNION ALL SELECT provider, unnest(['a:' || k, 'b:' || k]) FROM s WHERE provider = 'ollama'
        UNION ALL SELECT provider, 'g-' || k FROM s WHERE provider = 'gemini')""",
)
def catalog_ids(spark, d):
    return preflight.catalog_ids(_catalog_replies(spark, d))


@query(
    "catalog_details",
    """SELECT model, vision FROM (SELECT unnest(['a:' || s_suppkey, 'b:' || s_suppkey]) AS model, unnest([true, false]) AS vision
      FROM supplier WHERE s_suppkey % 4 = 3)""",
)
def catalog_details(spark, d):
    details = preflight.catalog_details(_catalog_replies(spark, d))
    return details.select("model", F.array_contains("capabilities", "vision").alias("vision"))


def _with_params(spark, d):
    """Pair matrix with model params, item options and sometimes a response format."""
    none = F.lit(None).cast("map<string,string>")
    schema = F.concat(F.lit('{"type":"object","title":"'), F.col("item_id"), F.lit('"}'))
    return t.pair_matrix(spark, d).withColumns(
        {
            "params": F.when(
                F.col("conv_id") % 2 == 0,
                F.create_map(
                    F.lit("temperature"), F.concat(F.lit("0."), _text(F.col("conv_id") % 10 + 1)),
                    F.lit("reasoning_effort"), F.lit("max"),
                ),
            ).otherwise(none),
            "options": F.when(
                F.col("turn") % 4 < 2,
                F.create_map(
                    F.lit("temperature"), F.lit("0.25"),
                    F.lit("max_completion_tokens"), _text(F.col("conv_id") + 100),
                    F.lit("repeat_penalty"), F.lit("1.15"),
                    F.lit("think"), F.lit("false"),
                    F.lit("keep_alive"), F.lit("10m"),
                    F.lit("seed"), F.lit(None).cast("string"),
                ),
            ).otherwise(none),
            "response_format": F.when(
                F.col("conv_id") % 5 == 0, requests.to_response_format(schema)
            ),
        }
    )


EFFECTIVE = f"""{r.PAIR_MATRIX}, names(param) AS (VALUES ('temperature'), ('reasoning_effort'), ('max_completion_tokens'),
    ('repeat_penalty'), ('think'), ('keep_alive'), ('response_format'), ('top_p')),
  layered AS (SELECT m.*, param,
    CASE WHEN param = 'response_format' THEN CASE WHEN conv_id % 5 = 0 THEN
        '{{"type":"json_schema","json_schema":{{"name":"eval_response","strict":true,"schema":{{"type":"object","title":"' || item_id || '"}}}}}}' END
      ELSE coalesce(
        CASE WHEN turn % 4 < 2 THEN CASE param WHEN 'temperature' THEN '0.25' WHEN 'max_completion_tokens' THEN CAST(conv_id + 100 AS VARCHAR)
          WHEN 'repeat_penalty' THEN '1.15' WHEN 'think' THEN 'false' WHEN 'keep_alive' THEN '10m' END END,
        CASE WHEN conv_id % 2 = 0 THEN CASE param WHEN 'temperature' THEN '0.' || (conv_id % 10 + 1) WHEN 'reasoning_effort' THEN 'max' END END,
        CASE WHEN provider IN ('groq', 'nvidia') THEN CASE param WHEN 'temperature' THEN '0.6' WHEN 'max_completion_tokens' THEN '2048'
          WHEN 'top_p' THEN '0.95' END END) END AS value
    FROM matrix m, names),
  effective AS (SELECT * FROM layered WHERE value IS NOT NULL AND (param NOT IN ('repeat_penalty', 'think', 'keep_alive', 'reasoning_effort')
    OR (provider = 'ollama' AND param <> 'reasoning_effort') OR (provider = 'nvidia' AND param = 'reasoning_effort')))"""


@query("effective_params", f"WITH {EFFECTIVE} SELECT item_id, provider, param, value FROM effective")
def effective_params(spark, d):
    filled = matrix.effective_params(_with_params(spark, d))
    return filled.select("item_id", "provider", F.explode("effective").alias("param", "value"))


@query(
    "unsupported_params",
    f"""WITH {r.PAIR_MATRIX} SELECT DISTINCT provider, param FROM (
      SELECT provider, unnest(['temperature', 'reasoning_effort']) AS param FROM matrix WHERE conv_id % 2 = 0
      UNION ALL SELECT provider, unnest(['temperature', 'max_completion_tokens', 'repeat_penalty', 'think', 'keep_alive']) FROM matrix WHERE turn % 4 < 2)
      WHERE (param = 'reasoning_effort' AND provider <> 'nvidia') OR (param IN ('repeat_penalty', 'think', 'keep_alive') AND provider <> 'ollama')""",
)
def unsupported_params(spark, d):
    return preflight.unsupported_params(_with_params(spark, d), matrix.supported_params(spark))


@query(
    "closest_match",
    """WITH keys AS (SELECT DISTINCT CASE c_custkey % 4
          WHEN 0 THEN left(c_name, CAST(c_custkey % 18 AS INT)) || substr(c_name, CAST(c_custkey % 18 AS INT) + 2)
          WHEN 1 THEN 'x' || left(c_name, 16) || 'y' || substr(c_name, 17) WHEN 2 THEN c_name ELSE substr(c_name, 5) END AS key FROM customer),
      unknown AS (SELECT key FROM keys ANTI JOIN (SELECT c_name AS key FROM customer) USING (key)),
      near AS (SELECT key, c_name, c_custkey, levenshtein(key, c_name) AS distance FROM unknown, customer WHERE levenshtein(key, c_name) <= 2)
      SELECT key, first(c_name ORDER BY distance, c_custkey) AS suggestion, CAST(min(distance) AS INTEGER) AS distance
      FROM unknown LEFT JOIN near USING (key) GROUP BY key""",
)
def closest_match(spark, d):
    """Customer names with one letter lost, two added, or the front cut off."""
    c = t.table(spark, d, "customer")
    place = (F.col("c_custkey") % 18).cast("int")
    case = F.col("c_custkey") % 4
    name = F.col("c_name")
    typo = (
        F.when(case == 0, F.concat(F.left(name, place), F.substr(name, place + 2)))
        .when(case == 1, F.concat(F.lit("x"), F.left(name, F.lit(16)), F.lit("y"), F.substr(name, F.lit(17))))
        .when(case == 2, name)
        .otherwise(F.substr(name, F.lit(5)))
    )
    keys = c.select(typo.alias("key"))
    known = c.select(name.alias("key"), F.col("c_custkey").alias("ordinal"))
    return preflight.closest_match(keys, known)


# --- requests -----------------------------------------------------------------


@query(
    "build_user_content",
    f"""WITH {r.PAIR_MATRIX} SELECT item_id, 0 AS pos, 'text' AS type, input AS text, CAST(NULL AS VARCHAR) AS url FROM matrix
      UNION ALL SELECT item_id, 1, 'image_url', NULL, image FROM matrix WHERE image IS NOT NULL""",
)
def build_user_content(spark, d):
    parts = requests.build_user_content(F.col("input"), F.col("image"))
    return t.pair_matrix(spark, d).select("item_id", F.posexplode(parts).alias("pos", "p")).select(
        "item_id", "pos", "p.type", "p.text", "p.url"
    )


@query(
    "trace_identity",
    f"""WITH {r.PAIR_MATRIX} SELECT item_id, 'eval:' || model || ':' || item_id AS trace_name,
      'dataset:' || dataset_id || '|provider:' || provider || CASE WHEN provider = 'ollama' THEN '/local' ELSE '' END AS tags,
      provider || CASE WHEN provider = 'ollama' THEN '/local' ELSE '' END AS provider_tag,
      CASE WHEN image IS NULL THEN 'false' ELSE 'true' END AS has_image FROM matrix""",
)
def trace_identity(spark, d):
    named = requests.trace_identity(t.pair_matrix(spark, d), F.lit("http://localhost:11434"))
    return named.select(
        "item_id",
        "trace_name",
        F.array_join("tags", "|").alias("tags"),
        F.col("metadata")["providerTag"].alias("provider_tag"),
        F.col("metadata")["hasImage"].alias("has_image"),
    )


PROMPT = (
    f"{lit(fixed.JUDGE_PROMPT_BEFORE_INPUT)} || input || {lit(fixed.JUDGE_PROMPT_BEFORE_OUTPUT)} || output || "
    f"{lit(fixed.JUDGE_PROMPT_BEFORE_CRITERIA)} || criteria || {lit(fixed.JUDGE_PROMPT_AFTER_CRITERIA)}"
)


@query("build_judge_prompts", f"WITH {r.PAIR_MATRIX} SELECT item_id, {PROMPT} AS judge_prompt FROM matrix")
def build_judge_prompts(spark, d):
    return judging.build_judge_prompts(t.pair_matrix(spark, d)).select("item_id", "judge_prompt")


@query(
    "build_provider_requests",
    f"""WITH {EFFECTIVE}, e AS (SELECT item_id, max(value) FILTER (WHERE param = 'temperature') AS temperature,
        max(value) FILTER (WHERE param = 'max_completion_tokens') AS budget, max(value) FILTER (WHERE param = 'top_p') AS top_p,
        max(value) FILTER (WHERE param = 'reasoning_effort') AS effort, max(value) FILTER (WHERE param = 'think') AS think,
        max(value) FILTER (WHERE param = 'keep_alive') AS keep_alive, max(value) FILTER (WHERE param = 'repeat_penalty') AS penalty,
        max(value) FILTER (WHERE param = 'response_format') AS format FROM effective GROUP BY item_id)
      SELECT item_id, provider, CASE provider WHEN 'gemini' THEN NULL ELSE model END AS model, input AS prompt,
        substr(image, 23) AS image_payload, temperature, budget, top_p, effort, think, keep_alive, penalty,
        CASE WHEN format IS NOT NULL THEN CASE provider WHEN 'gemini' THEN 'application/json' ELSE item_id END END AS format,
        CASE provider WHEN 'gemini' THEN 'contents,generationConfig'
          WHEN 'ollama' THEN 'model,messages,stream' || CASE WHEN coalesce(temperature, budget) IS NOT NULL THEN ',options' ELSE '' END
            || CASE WHEN format IS NOT NULL THEN ',format' ELSE '' END || CASE WHEN think IS NOT NULL THEN ',think,keep_alive' ELSE '' END
          ELSE 'model,messages,temperature,' || CASE provider WHEN 'nvidia' THEN 'max_tokens' ELSE 'max_completion_tokens' END || ',top_p,stream'
            || CASE WHEN format IS NOT NULL THEN ',response_format' ELSE '' END
            || CASE WHEN effort IS NOT NULL THEN ',reasoning_effort' ELSE '' END END AS fields
      FROM matrix LEFT JOIN e USING (item_id)""",
)
def build_provider_requests(spark, d):
    ready = matrix.effective_params(_with_params(spark, d)).withColumn(
        "messages", requests.build_messages(F.col("input"), F.col("image"))
    )
    built = requests.build_provider_requests(ready)

    def field(*paths):
        return F.coalesce(*[F.get_json_object("request", p) for p in paths])

    return built.select(
        "item_id",
        "provider",
        field("$.model").alias("model"),
        F.when(F.col("provider") == "gemini", field("$.contents[0].parts[0].text"))
        .when((F.col("provider") == "ollama") | F.col("image").isNull(), field("$.messages[0].content"))
        .otherwise(field("$.messages[0].content[0].text"))
        .alias("prompt"),
        F.coalesce(
            field("$.contents[0].parts[1].inlineData.data", "$.messages[0].images[0]"),
            F.substr(field("$.messages[0].content[1].image_url.url"), F.lit(23)),
        ).alias("image_payload"),
        field("$.temperature", "$.options.temperature", "$.generationConfig.temperature").alias("temperature"),
        field(
            "$.max_completion_tokens", "$.max_tokens", "$.options.num_predict", "$.generationConfig.maxOutputTokens"
        ).alias("budget"),
        field("$.top_p", "$.options.top_p", "$.generationConfig.topP").alias("top_p"),
        field("$.reasoning_effort").alias("effort"),
        field("$.think").alias("think"),
        field("$.keep_alive").alias("keep_alive"),
        field("$.options.repeat_penalty").alias("penalty"),
        field(
            "$.response_format.json_schema.schema.title", "$.format.title", "$.generationConfig.responseMimeType"
        ).alias("format"),
        F.array_join(F.json_object_keys("request"), ",").alias("fields"),
    )


# --- replies ------------------------------------------------------------------


def _replies(spark, d):
    """Raw replies for the pairs, in three shapes and with the odd contents each can have."""
    p = t.pair_matrix(spark, d)
    text = F.col("output")
    odd = F.col("turn") % 8
    tokens = F.length("input").cast("long")
    null = F.lit(None).cast("string")

    def variant(column):
        return F.try_parse_json(F.to_json(column))

    message = (
        F.when(odd == 2, variant(F.struct(null.alias("content"), text.alias("reasoning_content"))))
        .when(odd == 4, variant(F.struct(F.array(
            F.struct(F.lit("text").alias("type"), text.alias("text")),
            F.struct(F.lit("image_url").alias("type"), null.alias("text")),
            F.struct(F.lit("text").alias("type"), F.lit(" tail ").alias("text"))).alias("content"))))
        .when(odd == 6, variant(F.struct(F.lit(" ").alias("content"))))
        .otherwise(variant(F.struct(text.alias("content"))))
    )
    usage = F.struct(tokens.alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), (tokens + F.col("turn")).alias("total_tokens"))
    openai = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices"), F.when(odd != 1, usage).alias("usage")))
    native = F.to_json(F.struct(
        message.alias("message"),
        F.when(odd == 0, "length").when(odd == 1, "stop").alias("done_reason"),
        tokens.alias("prompt_eval_count"),
        F.col("turn").alias("eval_count"),
        (tokens * 1234567).alias("load_duration"),
    ))
    candidates = F.to_json(F.struct(
        F.array(F.struct(
            F.struct(F.array(F.struct(text.alias("text")), F.struct(F.lit("!").alias("text"))).alias("parts")).alias("content"),
            F.when(odd == 0, "MAX_TOKENS").otherwise("STOP").alias("finishReason"),
        )).alias("candidates"),
        F.struct(tokens.alias("promptTokenCount"), tokens.alias("totalTokenCount")).alias("usageMetadata"),
    ))
    raw = (
        F.when(F.col("conv_id") % 17 == 0, F.concat(F.lit("<html>"), text))
        .when(F.col("provider") == "ollama", native)
        .when(F.col("provider") == "gemini", candidates)
        .otherwise(openai)
    )
    return p.select("item_id", "provider", raw.alias("raw"))


@query(
    "normalize_responses",
    f"""WITH {r.PAIR_MATRIX}, x AS (SELECT *, turn % 8 AS odd, CAST(length(input) AS BIGINT) AS tokens, conv_id % 17 = 0 AS broken FROM matrix)
      SELECT item_id, CASE WHEN broken THEN NULL WHEN provider = 'gemini' THEN output || '!'
          WHEN odd = 4 THEN trim(output || ' tail ') WHEN odd = 6 THEN ' ' ELSE output END AS content,
        CASE WHEN broken THEN NULL WHEN provider IN ('ollama', 'gemini') THEN odd = 0 END AS truncated,
        CASE WHEN broken THEN NULL WHEN provider = 'ollama' THEN CASE odd WHEN 0 THEN 'length' WHEN 1 THEN 'stop' END
          WHEN provider = 'gemini' THEN CASE odd WHEN 0 THEN 'MAX_TOKENS' ELSE 'STOP' END END AS done_reason,
        CASE WHEN broken THEN NULL WHEN provider IN ('groq', 'nvidia') AND odd = 1 THEN 0 ELSE tokens END AS tokens_in,
        CASE WHEN broken THEN NULL WHEN provider = 'gemini' OR (provider <> 'ollama' AND odd = 1) THEN 0 ELSE turn END AS tokens_out,
        CASE WHEN broken THEN NULL WHEN provider = 'gemini' THEN tokens WHEN provider <> 'ollama' AND odd = 1 THEN 0 ELSE tokens + turn END AS tokens_total,
        CASE WHEN NOT broken AND provider = 'ollama' THEN CAST(round(tokens * 1234567 / 1e6) AS BIGINT) END AS load_ms,
        CASE WHEN broken THEN 'provider reply is not valid JSON' END AS error FROM x""",
)
def normalize_responses(spark, d):
    return responses.normalize_responses(_replies(spark, d)).select(
        "item_id", "content", "truncated", "done_reason", "tokens_in", "tokens_out", "tokens_total", "load_ms", "error"
    )


@query(
    "replay_responses",
    f"""WITH {r.PAIR_MATRIX}, users AS (SELECT 'c-' || conv_id || '-' || turn AS item_id FROM conversations WHERE role = 'user')
      SELECT item_id, matrix.output, CASE WHEN output IS NULL THEN 'no recorded response' END AS error
      FROM users LEFT JOIN matrix USING (item_id)""",
)
def replay_responses(spark, d):
    """All user turns against the recorded answers; each answer is recorded twice."""
    c = t.table(spark, d, "conversations").where("role = 'user'")
    provider = F.element_at(F.array(*[F.lit(p) for p in fixed.PROVIDERS]), (F.col("conv_id") % 4 + 1).cast("int"))
    asked = c.select(
        F.concat(F.lit("org/model:"), _text(F.col("conv_id") % 2)).alias("model"),
        provider.alias("provider"),
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("item_id"),
    )
    once = t.pair_matrix(spark, d).select("model", "provider", "item_id", "output")
    recorded = once.withColumn("recorded_at", F.lit(1)).unionByName(
        once.withColumn("output", F.lit("a later answer")).withColumn("recorded_at", F.lit(2))
    )
    return inference.replay_responses(asked, recorded).select("item_id", "output", "error")


def _requests(spark, d):
    ready = matrix.effective_params(_with_params(spark, d)).withColumn(
        "messages", requests.build_messages(F.col("input"), F.lit(None).cast("string"))
    )
    return requests.build_provider_requests(ready).select(
        "model", "provider", "item_id", "input", "criteria", "request"
    )


@query(
    "infer",
    f"""WITH {r.PAIR_MATRIX}, x AS (SELECT *, length(input) AS n FROM matrix)
      SELECT item_id, CASE WHEN n % 11 <> 0 THEN input || '!' END AS content,
        CASE WHEN n % 11 = 0 THEN 'API error (403 on model "' || model || '")' END AS error,
        CAST(CASE WHEN n % 11 = 0 THEN 1 WHEN n % 5 = 0 OR n % 7 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM x""",
)
def infer(spark, d):
    """Live calls against an in-memory client that limits, drops and refuses some."""
    replies = inference.infer(
        _requests(spark, d), clients.echo_client, max_concurrency=8, max_backoff_s=0.01
    )
    return responses.normalize_responses(replies).select("item_id", "content", "error", "attempts")


JUDGED = f"""{r.PAIR_MATRIX}, x AS (SELECT *, length({PROMPT}) AS n FROM matrix),
  verdicts AS (SELECT *, n % 13 = 0 AS judge_failed, CASE WHEN n % 13 <> 0 AND n % 5 <> 4 THEN CAST(n % 5 + 1 AS DOUBLE) END AS score,
    CASE WHEN n % 13 = 0 THEN 'Judge call failed: API error (500)'
      WHEN n % 5 = 4 THEN 'Failed to parse judge output (not valid JSON). Raw: This answer is fine.'
      ELSE 'length ' || n END AS reasoning FROM x)"""


@query("judge", f"WITH {JUDGED} SELECT item_id, provider, score, reasoning, judge_failed FROM verdicts")
def judge(spark, d):
    """Live verdicts from an in-memory judge that sometimes fails or talks."""
    return judging.judge(t.pair_matrix(spark, d), clients.verdict_client).select(
        "item_id", "provider", "score", "reasoning", "judge_failed"
    )


# --- a whole evaluation -------------------------------------------------------

EVALUATION = """WITH models AS (SELECT lang AS model, CASE lang WHEN 'de' THEN 'ollama' WHEN 'en' THEN 'groq' WHEN 'es' THEN 'gemini' ELSE 'nvidia' END AS provider,
    row_number() OVER (ORDER BY lang) - 1 AS model_index FROM (SELECT DISTINCT lang FROM documents)),
  items AS (SELECT conv_id, turn, 'c-' || conv_id || '-' || turn AS item_id, text AS input,
    row_number() OVER (ORDER BY 'c-' || conv_id || '-' || turn) - 1 AS item_index FROM conversations WHERE role = 'user'),
  answers AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'),
  runs AS (SELECT *, model_index * (SELECT count(*) FROM items) + item_index + 1 AS position,
    CASE WHEN model = 'fr' AND conv_id % 2 = 0 THEN '{"answer":' || conv_id || '}' ELSE answer END AS output
    FROM models, items LEFT JOIN answers USING (conv_id, turn)),
  scored AS (SELECT * REPLACE (CASE WHEN answer IS NOT NULL THEN output END AS output), answer IS NOT NULL AS ok,
    'eval-run/' || provider || '/' || model || '/' || item_id AS observation_id,
    CASE WHEN answer IS NOT NULL AND (conv_id + turn) % 6 <> 5 THEN (conv_id + turn) % 6 + model_index % 2 END AS score,
    CASE WHEN answer IS NULL OR conv_id % 3 = 2 THEN NULL WHEN conv_id % 3 = 0 AND model = 'fr' AND conv_id % 2 = 0 THEN 1 ELSE 0 END AS schema_value,
    CASE WHEN answer IS NOT NULL THEN conv_id * 1000 + turn END AS started_ms FROM runs)"""


@query(
    "evaluation_results",
    EVALUATION
    + """ SELECT model, provider, item_id, position, output, CAST(score AS DOUBLE) AS score, schema_value,
      CASE WHEN NOT ok THEN 'no recorded response' END AS error FROM scored""",
)
def evaluation_results(spark, d):
    return _evaluation(spark, d).results.select(
        "model", "provider", "item_id", "position", "output", "score", "schema_value", "error"
    )


@query(
    "evaluation_scores",
    EVALUATION
    + """ SELECT observation_id, CASE WHEN score IS NULL THEN 'llm-judge-error' ELSE 'llm-judge-score' END AS name, CAST(score AS DOUBLE) AS value_num
      FROM scored WHERE ok
      UNION ALL SELECT observation_id, 'json-schema-valid', schema_value FROM scored WHERE schema_value IS NOT NULL
      UNION ALL SELECT observation_id, 'response-truncated', CAST(0 AS DOUBLE) FROM scored WHERE ok AND provider IN ('ollama', 'gemini')""",
)
def evaluation_scores(spark, d):
    return _evaluation(spark, d).scores.select("observation_id", "name", "value_num")


@query(
    "evaluation_observations",
    EVALUATION
    + """ SELECT observation_id || '-root' AS id, CAST(NULL AS VARCHAR) AS parent_id, 'SPAN' AS type, 'eval:' || model || ':' || item_id AS name,
        CASE WHEN NOT ok THEN 'ERROR' END AS level, 'dataset:chat' AS tag, started_ms, coalesce(output, 'no recorded response') AS said FROM scored
      UNION ALL SELECT observation_id, observation_id || '-root', 'GENERATION', provider || '-completion', NULL, 'dataset:chat', started_ms,
        coalesce(output, 'no recorded response') FROM scored""",
)
def evaluation_observations(spark, d):
    return _evaluation(spark, d).observations.select(
        "id", "parent_id", "type", "name", "level", F.get("tags", F.lit(0)).alias("tag"),
        F.unix_millis("start_time").alias("started_ms"),
        F.coalesce(F.get_json_object("output", "$.content"), F.get_json_object("output", "$.error")).alias("said"),
    )


@query(
    "evaluation_timing",
    EVALUATION
    + """ SELECT model, provider, CAST(sum(100) AS BIGINT) AS total_ms, CAST(100 AS BIGINT) AS slowest_ms, CAST(0 AS BIGINT) AS tokens_in,
        CAST(0 AS BIGINT) AS tokens_out, count(*) AS n FROM scored WHERE ok GROUP BY ALL
      UNION ALL SELECT 'ALL', NULL, CAST(max(started_ms) + 100 - min(started_ms) AS BIGINT), 100, 0, 0, count(*) FROM scored""",
)
def evaluation_timing(spark, d):
    return summary.timing_with_total(_evaluation(spark, d).results)


@query(
    "evaluation_schema_validity",
    EVALUATION
    + """ SELECT model, provider, CAST(sum(schema_value) AS BIGINT) AS passed, count(schema_value) AS total FROM scored
      WHERE ok GROUP BY ALL HAVING count(schema_value) > 0""",
)
def evaluation_schema_validity(spark, d):
    return summary.schema_validity_by_model(_evaluation(spark, d).results)


REPORTED = (
    EVALUATION
    + """ SELECT model, provider || CASE provider WHEN 'ollama' THEN '/local' ELSE '' END AS provider, count(*) AS n,
        round(avg(score), 6) AS judge_avg, CAST(min(score) AS DOUBLE) AS judge_min, CAST(max(score) AS DOUBLE) AS judge_max, count(score) AS judge_n,
        count(*) FILTER (ok AND score IS NULL) AS unscored, count(*) FILTER (schema_value = 1) AS schema_pass,
        count(schema_value) AS schema_total, CAST(0 AS BIGINT) AS truncated, CAST(100 AS DOUBLE) AS latency_mean_ms,
        CAST(100 AS DOUBLE) AS latency_p50_ms, CAST(100 AS DOUBLE) AS latency_p95_ms FROM scored GROUP BY model, provider"""
)


@query("evaluation_report", REPORTED)
def evaluation_report(spark, d):
    """A run, written to the store and reported from there."""
    base = scratch_path(spark, "run")
    evaluation.store(_evaluation(spark, d, scratch_path(spark, "results")), base, "production")
    found = stored_report(spark, base, 30, "production", dt.datetime(1970, 1, 2), dataset_id="chat")
    return found.drop("tokens_in", "tokens_out", "cost")


@query("store_rerun", REPORTED)
def store_rerun(spark, d):
    """A run whose first attempt lost half of its rows is stored twice more; the report is that of one."""
    base = scratch_path(spark, "rerun")
    whole = _evaluation(spark, d, scratch_path(spark, "results"))
    half = F.pmod(F.xxhash64("observation_id"), F.lit(2)) == 0
    lost = evaluation.Evaluation(whole.results.where(half), whole.scores.where(half), whole.observations)
    for made in (lost, whole, whole):
        evaluation.store(made, base, "production")
    commits.compact(spark, f"{base}/sessions", schemas.SESSIONS, by_session=False)
    found = stored_report(spark, base, 30, "production", dt.datetime(1970, 1, 2), dataset_id="chat")
    return found.drop("tokens_in", "tokens_out", "cost")


@query(
    "infer_resume",
    f"""WITH {r.PAIR_MATRIX}, x AS (SELECT item_id, input, length(input) % 3 = 0 AS refused FROM matrix)
      SELECT session_id, item_id, input || '!' AS content, CAST(NULL AS VARCHAR) AS error, CAST(CASE WHEN refused AND session_id = 'a' THEN 2 ELSE 1 END AS BIGINT) AS rows_kept
      FROM x, (SELECT unnest(['a', 'b']) AS session_id)""",
)
def infer_resume(spark, d):
    """Two sessions on one path; a third of the first one's calls fail at first and are asked again."""
    path = scratch_path(spark, "responses")
    asked = _requests(spark, d)
    one, two = (asked.withColumn("session_id", F.lit(s)) for s in "ab")
    inference.infer_to(one, path, clients.refusing_client)
    tables = [inference.infer_to(one, path, clients.plain_client), inference.infer_to(two, path, clients.plain_client)]
    kept = spark.read.parquet(path).groupBy("session_id", "item_id").agg(F.count("*").alias("rows_kept"))
    replies = responses.normalize_responses(tables[0].unionByName(tables[1]))
    return replies.select("session_id", "item_id", "content", "error").join(kept, ["session_id", "item_id"])


def _evaluation(spark, d, results_path=None):
    """Languages as models over all user turns, replayed from the recorded turns; kept at a path if read more than once.

    Some items ask for an object, some for a list; some answers of one model are objects.
    """
    langs = t.table(spark, d, "documents").select(F.col("lang").alias("model")).distinct()
    provider = F.when(F.col("model") == "de", "ollama").when(F.col("model") == "en", "groq").when(F.col("model") == "es", "gemini").otherwise("nvidia")
    models = spread.with_row_index(
        langs.withColumn("provider", provider).withColumn("params", F.lit(None).cast("map<string,string>")),
        "model",
        "model_index",
    )
    c = t.table(spark, d, "conversations")
    item_id = F.concat_ws("-", F.lit("c"), "conv_id", "turn")
    form = F.when(F.col("conv_id") % 3 == 0, '{"type":"object","required":["answer"]}').when(F.col("conv_id") % 3 == 1, '{"type":"array"}')
    items = spread.with_row_index(
        c.where("role = 'user'").select(
            F.lit("chat").alias("dataset_id"),
            item_id.alias("item_id"),
            F.col("text").alias("input"),
            F.lit("It must answer.").alias("criteria"),
            F.lit(None).cast("string").alias("image"),
            F.lit(None).cast("map<string,string>").alias("options"),
            F.lit(None).cast("string").alias("response_format"),
            form.alias("score_schema"),
        ),
        "item_id",
        "item_index",
    )
    plan = evaluation.plan_requests(models, items, "eval-run")

    # Recordings: the same answer from every model, in the shape of its provider.
    answers = c.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    each = answers.withColumn("model", F.explode(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])))
    answered = F.when(
        (F.col("model") == "fr") & (F.col("conv_id") % 2 == 0), F.concat(F.lit('{"answer":'), _text(F.col("conv_id")), F.lit("}"))
    ).otherwise(F.col("answer"))
    content = F.struct(answered.alias("content"))
    raw = (
        F.when(F.col("model") == "de", F.to_json(F.struct(content.alias("message"), F.lit("stop").alias("done_reason"))))
        .when(F.col("model") == "es", F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("answer").alias("text"))).alias("parts")).alias("content"))).alias("candidates"))))
        .otherwise(F.to_json(F.struct(F.array(F.struct(content.alias("message"))).alias("choices"))))
    )
    recorded = each.withColumn("provider", provider).select(
        "model", "provider", item_id.alias("item_id"), raw.alias("raw"), F.lit(100).cast("long").alias("elapsed_ms"),
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("started_ms"),
    )
    place = (F.col("conv_id") + F.col("turn")) % 6
    verdict = F.when(place == 5, "no verdict").otherwise(
        F.concat(F.lit('{"score":'), _text(place + F.when(F.col("model").isin("en", "fr"), 1).otherwise(0)), F.lit("}"))
    )
    reply = F.to_json(F.struct(F.array(F.struct(F.struct(verdict.alias("content")).alias("message"))).alias("choices")))
    verdicts = each.withColumn("provider", provider).select(
        "model", "provider", item_id.alias("item_id"), reply.alias("raw")
    )
    return evaluation.evaluate(plan, recorded, judge_recorded=verdicts, results_path=results_path)


# --- observations, media, endpoints -------------------------------------------


@query(
    "build_observations",
    f"""WITH {r.RESULTS}, x AS (SELECT *, 'eval:' || model || ':' || item_id AS trace_name, error IS NOT NULL AS failed FROM results)
      SELECT observation_id || '-root' AS id, CAST(NULL AS VARCHAR) AS parent_id, trace_name AS name, 'SPAN' AS type, CAST(NULL AS VARCHAR) AS model,
        CASE WHEN failed THEN 'ERROR' WHEN judge_failed OR truncated THEN 'WARNING' END AS level,
        CAST(NULL AS BIGINT) AS tokens_in, CAST(NULL AS BIGINT) AS tokens_out, input || criteria AS asked, coalesce(output, error) AS answered FROM x
      UNION ALL SELECT CAST(observation_id AS VARCHAR), observation_id || '-root', provider || '-completion', 'GENERATION', model, NULL,
        CASE WHEN NOT failed THEN coalesce(tokens_in, 0) END, CASE WHEN NOT failed THEN coalesce(tokens_out, 0) END, input, coalesce(output, error) FROM x""",
)
def build_observations(spark, d):
    results = t.results_documents(spark, d).withColumn(
        "trace_name", F.concat(F.lit("eval:"), "model", F.lit(":"), "item_id")
    )
    made = observations.build_observations(results)

    def field(column, path):
        return F.get_json_object(column, path)

    return made.select(
        "id", "parent_id", "name", "type", "model", "level", "tokens_in", "tokens_out",
        F.coalesce(
            F.concat(field("input", "$.prompt"), field("input", "$.criteria")), field("input", "$[0].content")
        ).alias("asked"),
        F.coalesce(field("output", "$.content"), field("output", "$.error")).alias("answered"),
    )


TRAFFIC_PATHS = """CASE page_id % 4 WHEN 0 THEN '/api/public/otel/v1/traces' WHEN 1 THEN '/api/public/ingestion'
  WHEN 2 THEN '/api/public/media' ELSE '/' || split_part(url, '/', 4) END"""


@query(
    "sink_traffic_summary",
    f"""WITH p AS (SELECT {TRAFFIC_PATHS} AS path, html FROM pages)
      SELECT CASE WHEN contains(path, '/otel/') THEN 'spans (OTLP)' WHEN contains(path, '/ingestion') THEN 'score writes'
        WHEN contains(path, '/media') THEN 'media uploads' ELSE path END AS kind, count(*) AS requests,
        CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM p GROUP BY 1""",
)
def sink_traffic_summary(spark, d):
    pages = t.table(spark, d, "pages")
    case = F.col("page_id") % 4
    path = (
        F.when(case == 0, "/api/public/otel/v1/traces")
        .when(case == 1, "/api/public/ingestion")
        .when(case == 2, "/api/public/media")
        .otherwise(F.concat(F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4))))
    )
    return observations.sink_traffic_summary(pages.select(path.alias("path"), F.encode("html", "UTF-8").alias("body")))


def _media_rows(spark, d):
    """Pages whose text carries up to three inline images; many pages share one."""
    pages = t.table(spark, d, "pages")

    def image(text):
        return F.concat(
            F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")
        )

    text = F.concat(
        F.lit("<"), image(F.col("html")), F.lit("> and "),
        F.when(F.col("page_id") % 3 == 0, image(F.lit("shared image"))).otherwise(""),
        F.lit(" end "),
        F.when(F.col("page_id") % 2 == 0, image(F.col("url"))).otherwise("none"),
    )
    return pages.select("page_id", F.when(F.col("page_id") % 7 == 0, "plain text").otherwise(text).alias("body"))


def _sql_image(text: str) -> str:
    return f"'data:image/jpeg;base64,' || base64(encode({text}))"


@query(
    "offload_media",
    f"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'plain text' ELSE '<media://' || sha256({_sql_image('html')}) || '> and ' ||
      CASE WHEN page_id % 3 = 0 THEN 'media://' || sha256({_sql_image("'shared image'")}) ELSE '' END || ' end ' ||
      CASE WHEN page_id % 2 = 0 THEN 'media://' || sha256({_sql_image('url')}) ELSE 'none' END END AS body FROM pages""",
)
def offload_media(spark, d):
    return media.offload_media(_media_rows(spark, d), "body")[0]


@query(
    "offload_media_table",
    f"""SELECT DISTINCT sha256({_sql_image('t')}) AS media_id, 'image/jpeg' AS mime, CAST(strlen(t) AS INTEGER) AS bytes, sha256(t) AS content_hash
      FROM (SELECT html AS t FROM pages WHERE page_id % 7 <> 0 UNION ALL SELECT 'shared image' FROM pages WHERE page_id % 7 <> 0 AND page_id % 3 = 0
        UNION ALL SELECT url FROM pages WHERE page_id % 7 <> 0 AND page_id % 2 = 0)""",
)
def offload_media_table(spark, d):
    stored = media.offload_media(_media_rows(spark, d), "body")[1]
    return stored.select(
        "media_id", "mime", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("content_hash")
    )


@query(
    "data_url_info",
    """WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 3 THEN url ELSE 'data:image/png;base64,' || base64(encode(html)) END AS u FROM pages),
      x AS (SELECT *, CAST(floor((length(u) - strpos(u, ',')) * 3 / 4) AS BIGINT) AS bytes FROM u)
      SELECT page_id, page_id % 4 <> 3 AS is_data_url, CASE WHEN page_id % 4 <> 3 THEN 'image/png' END AS mime,
        CASE WHEN page_id % 4 <> 3 THEN sha256(substr(u, 23)) END AS payload_hash, bytes, CAST(round(bytes / 1024) AS BIGINT) || ' KB' AS size_label FROM x""",
)
def data_url_info(spark, d):
    pages = t.table(spark, d, "pages")
    payload = F.regexp_replace(F.base64(F.encode("html", "UTF-8")), r"[\r\n]", "")
    url = F.when(F.col("page_id") % 4 == 3, F.col("url")).otherwise(F.concat(F.lit("data:image/png;base64,"), payload))
    info = pages.select("page_id", identity.data_url_info(url).alias("i"))
    return info.select(
        "page_id", "i.is_data_url", "i.mime", F.sha2("i.payload", 256).alias("payload_hash"), "i.bytes", "i.size_label"
    )


HOSTS = ["localhost:11434", "127.0.0.1", "[::1]:8080", "0.0.0.0:1", "box.localhost", "10.0.0.7", "[::]", "LOCALHOST"]


@query(
    "endpoint_locality",
    f"""WITH e AS (SELECT page_id, CASE WHEN page_id % 10 < 8 THEN 'http://' || [{", ".join(lit(h) for h in HOSTS)}][page_id % 10 + 1] || '/p/' || page_id
        WHEN page_id % 10 = 8 THEN url ELSE 'no url ' || page_id END AS url FROM pages)
      SELECT page_id, CASE WHEN page_id % 10 IN (0, 1, 2, 3, 4, 6, 7) THEN 'local' ELSE 'remote' END AS locality,
        'ollama/' || CASE WHEN page_id % 10 IN (0, 1, 2, 3, 4, 6, 7) THEN 'local' ELSE 'remote' END AS tag, 'groq' AS hosted_tag FROM e""",
)
def endpoint_locality(spark, d):
    pages = t.table(spark, d, "pages")
    case = (F.col("page_id") % 10).cast("int")
    host = F.get(F.array(*[F.lit(h) for h in HOSTS]), case)
    url = (
        F.when(case < 8, F.concat(F.lit("http://"), host, F.lit("/p/"), _text(F.col("page_id"))))
        .when(case == 8, F.col("url"))
        .otherwise(F.concat(F.lit("no url "), _text(F.col("page_id"))))
    )
    return pages.select(
        "page_id",
        identity.endpoint_locality(url).alias("locality"),
        identity.provider_tag(F.lit("ollama"), url).alias("tag"),
        identity.provider_tag(F.lit("groq"), url).alias("hosted_tag"),
    )


@query(
    "mime_type",
    """SELECT page_id, ['image/jpeg', 'image/jpeg', 'image/png', 'image/gif', 'image/webp', 'image/bmp', 'image/avif',
      'application/octet-stream', 'application/octet-stream'][page_id % 9 + 1] AS mime FROM pages""",
)
def mime_type(spark, d):
    extensions = F.array(*[F.lit(x) for x in (".jpg", ".JPEG", ".png", ".Gif", ".webp", ".bmp", ".avif", ".txt", "")])
    pages = t.table(spark, d, "pages")
    path = F.concat(F.lit("/data/page-"), _text(F.col("page_id")), F.get(extensions, (F.col("page_id") % 9).cast("int")))
    return pages.select("page_id", identity.mime_type(path).alias("mime"))


@query(
    "extract_referenced_paths",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'C:\\frames\\' || source || '.jpg'
      ELSE 'C:\\frames\\' || source || '.jpg|/tmp/é' || doc_id || '.png' END AS paths FROM documents""",
)
def extract_referenced_paths(spark, d):
    docs = t.table(spark, d, "documents")

    def reference(path):
        return F.concat(F.lit("${[ fs.readFile(path=b64'"), F.base64(F.encode(path, "UTF-8")), F.lit("', encoding='base64') ]}"))

    frame = F.concat(F.lit("C:\\frames\\"), "source", F.lit(".jpg"))
    other = F.concat(F.lit("/tmp/é"), _text(F.col("doc_id")), F.lit(".png"))
    text = F.concat(
        "text",
        F.when(F.col("doc_id") % 3 > 0, reference(frame)).otherwise(""),
        F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit(" "), reference(other))).otherwise(""),
    )
    return docs.select("doc_id", F.array_join(identity.extract_referenced_paths(text), "|").alias("paths"))


def captured_texts(spark, d):
    """A captured request per document, whole text as prompt; some are broken."""
    docs = t.table(spark, d, "documents")
    key = F.col("doc_id")
    case = key % 6
    reference = F.concat(
        F.lit("${[ fs.readFile(path=b64'"), F.base64(F.encode(F.concat(F.lit("/in/"), _text(key)), "UTF-8")), F.lit("', encoding='base64') ]}")
    )
    schema = F.struct(F.lit("object").alias("type"), F.col("source").alias("title"))
    wrapped = F.struct(schema.alias("json_schema"))
    request = F.to_json(F.struct(
        F.col("source").alias("model"),
        F.when(case < 4, case % 2 == 1).alias("think"),
        F.when(case == 0, F.to_json(schema)).when(case == 1, F.to_json(wrapped)).alias("_format"),
        F.struct(
            F.when(case < 3, 0.8).alias("temperature"), F.when(case < 2, key).alias("num_predict"),
            F.when(case == 0, 1.15).alias("repeat_penalty"),
        ).alias("options"),
        F.array(
            F.struct(F.lit("system").alias("role"), F.lit("Be brief.").alias("content"), F.lit(None).cast("array<string>").alias("images")),
            F.struct(
                F.when(case == 5, "assistant").otherwise("user").alias("role"),
                F.col("text").alias("content"),
                F.when(case == 0, F.array(reference, F.lit("data:image/png;base64,AAAA"))).alias("images"),
            ),
        ).alias("messages"),
    ))
    # `format` is JSON, not a string: splice it in.
    declared = F.when(case == 0, F.to_json(schema)).when(case == 1, F.to_json(wrapped))
    spliced = F.coalesce(
        F.concat(F.lit('{"format":'), declared, F.lit(","), F.substr(request, F.lit(2))), request
    )
    return docs.select("doc_id", F.when(case == 4, F.concat(request, F.lit(" trailing"))).otherwise(spliced).alias("value"))


CAPTURED = """SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN text END AS prompt,
  CASE WHEN doc_id % 6 < 2 THEN source END AS schema_title,
  CASE WHEN doc_id % 6 < 3 THEN '0.8' END AS temperature, CASE WHEN doc_id % 6 < 2 THEN CAST(doc_id AS VARCHAR) END AS budget,
  CASE WHEN doc_id % 6 = 0 THEN '1.15' END AS penalty, CASE WHEN doc_id % 6 < 4 THEN CASE WHEN doc_id % 2 = 1 THEN 'true' ELSE 'false' END END AS think,
  CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 END AS warnings,
  CASE WHEN doc_id % 6 = 0 THEN '/in/' || doc_id || '|(inline data URL)' WHEN doc_id % 6 < 4 THEN '' END AS images,
  CASE doc_id % 6 WHEN 4 THEN 'not valid JSON' WHEN 5 THEN 'no message with role user' END AS error FROM documents"""


def captured_columns(parsed):
    return parsed.select(
        "doc_id",
        "prompt",
        F.get_json_object("score_schema", "$.title").alias("schema_title"),
        F.try_element_at("options", F.lit("temperature")).alias("temperature"),
        F.try_element_at("options", F.lit("max_completion_tokens")).alias("budget"),
        F.try_element_at("options", F.lit("repeat_penalty")).alias("penalty"),
        F.try_element_at("options", F.lit("think")).alias("think"),
        F.when(F.col("warnings").isNotNull(), F.size("warnings")).alias("warnings"),
        F.array_join("referenced_images", "|").alias("images"),
        "error",
    )


@query("parse_captured_requests", CAPTURED)
def parse_captured_requests(spark, d):
    return captured_columns(datasets.parse_captured_requests(captured_texts(spark, d)))

"""The given tables seen as evaluation data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column) -> object:
    return column.cast("string")


def gens_events(spark, sf_dir) -> DataFrame:
    """Events as generations. Some lack a model, tags, a latency or a proper trace name."""
    e = table(spark, sf_dir, "events")
    model = F.concat(F.lit("m:"), _text(F.col("user_id") % 7))
    return e.select(
        F.col("event_id").alias("observation_id"),
        F.concat(F.lit(fixed.SESSION_PREFIX), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        F.when(F.col("event_id") % 50 == 0, "other")
        .otherwise(F.concat(F.lit(fixed.TRACE_PREFIX), model, F.lit(":"), F.col("event_type")))
        .alias("trace_name"),
        F.when(F.col("user_id") % 5 == 0, "").when(F.col("user_id") % 5 == 1, None).otherwise(model).alias("model"),
        F.when(F.col("event_id") % 40 == 7, None)
        .otherwise(
            F.array(
                F.concat(F.lit(fixed.DATASET_TAG), F.col("event_type")),
                F.concat(F.lit(fixed.PROVIDER_TAG), F.lit("p:"), _text(F.col("user_id") % 3)),
            )
        )
        .alias("tags"),
        F.when(F.col("event_id") % 97 == 0, None).otherwise(F.col("value") / 100).alias("latency"),
        F.col("user_id").alias("tokens_in"),
        (F.col("event_id") % 100).alias("tokens_out"),
        (F.col("value") / 1000).alias("total_cost"),
        F.col("ts").alias("start_time"),
        F.col("props").alias("output"),
    )


def _score(name, value, kind, observation=None):
    return F.struct(
        (F.col("event_id") if observation is None else observation).cast("long").alias("observation_id"),
        F.lit(name).alias("name"),
        value.cast("double").alias("value_num") if kind == fixed.NUMERIC else F.lit(None).cast("double").alias("value_num"),
        F.lit(fixed.UNSCORED if kind == fixed.CATEGORICAL else None).cast("string").alias("value_str"),
        F.lit(kind).alias("data_type"),
        F.lit(None).cast("string").alias("comment"),
    )


def scores_events(spark, sf_dir) -> DataFrame:
    """Up to four score rows per event; a few rows without an observation id."""
    e = table(spark, sf_dir, "events")
    unscored = (F.col("event_type") == "error") | (F.col("event_id") % 11 == 0)
    rows = F.array(
        F.when(unscored, _score(fixed.JUDGE_ERROR, None, fixed.CATEGORICAL)).otherwise(
            _score(fixed.JUDGE_SCORE, 1 + F.col("event_id") % 5, fixed.NUMERIC)
        ),
        F.when(
            F.col("event_id") % 2 == 0,
            _score(fixed.SCHEMA_SCORE, (F.col("event_id") % 3 == 0).cast("int"), fixed.NUMERIC),
        ),
        F.when(
            F.col("event_type").isin("view", "click"),
            _score(fixed.TRUNCATION_SCORE, (F.col("event_id") % 13 == 0).cast("int"), fixed.NUMERIC),
        ),
        F.when(
            F.col("event_id") % 101 == 0,
            _score(fixed.JUDGE_SCORE, F.lit(5), fixed.NUMERIC, F.lit(None)),
        ),
    )
    return e.select(F.explode(F.array_compact(rows)).alias("s")).select("s.*")


def sessions_events(spark, sf_dir) -> DataFrame:
    """One session per day, one in three not of an evaluation."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    prefix = F.when(F.dayofmonth("ts") % 3 == 0, "chat-").otherwise(fixed.SESSION_PREFIX)
    return e.groupBy(
        F.concat(prefix, day).alias("session_id"),
        F.when(F.dayofmonth("ts") % 2 == 0, "production").otherwise("development").alias("environment"),
    ).agg(F.min("ts").alias("created_at"))


def results_documents(spark, sf_dir) -> DataFrame:
    """Documents as run results, with verdicts from the labels.

    A document without a label has no score and does not say whether it was cut.
    """
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    failed = F.col("doc_id") % 23 == 0
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("observation_id"),
        F.concat(F.lit("eval-"), _text(F.col("doc_id") % 4)).alias("session_id"),
        F.col("source").alias("model"),
        F.col("lang").alias("provider"),
        F.concat(F.lit("item-"), _text(F.col("doc_id"))).alias("item_id"),
        F.lit("Write a text.").alias("input"),
        F.lit("It must read well.").alias("criteria"),
        F.when(~failed, F.col("text")).alias("output"),
        F.when(
            failed,
            F.concat(
                F.lit("API error ("),
                F.when(F.col("doc_id") % 2 == 0, "401").otherwise("500"),
                F.lit(' on model "'),
                F.col("source"),
                F.lit('"): refused'),
            ),
        ).alias("error"),
        F.when(~failed, 1 + 4 * F.col("quality").cast("double")).alias("score"),
        F.when(~failed, F.when(F.col("quality").isNull(), "no verdict").otherwise("label")).alias("reasoning"),
        F.when(~failed, F.col("toxic") == 1).alias("truncated"),
        F.when(F.col("toxic") == 1, "length").alias("done_reason"),
        (~failed & (F.col("doc_id") % 29 == 0)).alias("judge_failed"),
        F.when(F.col("doc_id") % 17 != 0, F.col("n_chars") % 5000).alias("elapsed_ms"),
        (F.col("doc_id") * 10).alias("started_ms"),
        F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 300).alias("tokens_in"),
        F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("tokens_out"),
        F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 300 + F.col("n_chars")).alias("tokens_total"),
    )


def scores_labels(spark, sf_dir) -> DataFrame:
    """Score rows of the labelled documents."""
    labels = table(spark, sf_dir, "labels")
    rows = F.array(
        F.struct(
            F.lit(fixed.JUDGE_SCORE).alias("name"),
            (1 + 4 * F.col("quality")).cast("double").alias("value_num"),
        ),
        F.struct(
            F.lit(fixed.TRUNCATION_SCORE).alias("name"), F.col("toxic").cast("double").alias("value_num")
        ),
    )
    return labels.select(F.col("doc_id").alias("observation_id"), F.explode(rows).alias("s")).select(
        "observation_id", "s.*"
    )


def scores_lineitem(spark, sf_dir) -> DataFrame:
    """Order lines as score rows, many per order."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("observation_id"),
        F.when(F.col("l_returnflag") == "A", fixed.JUDGE_SCORE)
        .when(F.col("l_returnflag") == "R", fixed.JUDGE_ERROR)
        .otherwise(fixed.SCHEMA_SCORE)
        .alias("name"),
        F.when(F.col("l_returnflag") == "A", F.col("l_linenumber"))
        .when(F.col("l_returnflag") == "R", None)
        .otherwise((F.col("l_linestatus") == "O").cast("int"))
        .cast("double")
        .alias("value_num"),
    )


def gens_orders(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("observation_id"),
        F.lit(None).cast("string").alias("trace_name"),
        F.col("o_orderpriority").alias("model"),
        F.array(F.concat(F.lit(fixed.PROVIDER_TAG), F.col("o_orderstatus"))).alias("tags"),
        (F.col("o_totalprice") / 1000).alias("latency"),
        F.col("o_custkey").alias("tokens_in"),
        F.col("o_orderkey").alias("tokens_out"),
        (F.col("o_totalprice") / 1000000).alias("total_cost"),
        F.col("o_orderdate").alias("start_time"),
    )


def pairs(spark, sf_dir) -> DataFrame:
    """User turns with the assistant turn that follows."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    answered = c.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return asked.join(answered, ["conv_id", "turn"])


def pair_matrix(spark, sf_dir) -> DataFrame:
    """Pairs as matrix rows: provider by conversation, two models each, some with an image."""
    by_conv = F.col("conv_id") % 4
    provider = F.element_at(F.array(*[F.lit(p) for p in fixed.PROVIDERS]), (by_conv + 1).cast("int"))
    return pairs(spark, sf_dir).select(
        F.concat(F.lit("org/model:"), _text(F.col("conv_id") % 2)).alias("model"),
        provider.alias("provider"),
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("item_id"),
        F.element_at(F.array(F.lit("text"), F.lit("image")), (F.col("turn") % 2 + 1).cast("int")).alias("dataset_id"),
        "conv_id",
        "turn",
        "input",
        F.lit("It must answer the question.").alias("criteria"),
        "output",
        F.when(
            F.col("conv_id") % 3 == 0,
            F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(F.encode("input", "UTF-8")), r"[\r\n]", "")),
        ).alias("image"),
    )


SCHEMA = {
    "type": "object",
    "properties": {
        "event": {"type": "string", "enum": ["view", "click", "purchase", "signup"]},
        "amount": {"type": "number"},
        "codes": {"type": "array", "items": {"type": "string"}},
        "origin": {
            "type": "object",
            "properties": {"page": {"type": "string"}, "rank": {"type": "integer"}},
            "required": ["page"],
            "additionalProperties": False,
        },
    },
    "required": ["event", "amount", "codes", "origin"],
}


def outputs_json(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    """A model response per event: clean, fenced, wrapped, cut, wrong or no JSON."""
    e = table(spark, sf_dir, "events") if events is None else events
    case = F.col("event_id") % 12
    number = _text(F.col("event_id") % 100)
    body = F.concat(
        F.lit('{"event":"'), F.col("event_type"),
        F.lit('","amount":'),
        F.when(case == 5, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(F.concat(number, F.lit(".5"))),
        F.lit(',"codes":['),
        F.when(case == 7, F.concat(F.lit('"a",'), number, F.lit(",null"))).otherwise(F.concat(F.lit('"p'), number, F.lit('"'))),
        F.lit("]"),
        F.when(case == 6, "")
        .when(case == 8, F.concat(F.lit(',"origin":{"page":"s","rank":1.5,"extra":'), F.col("props"), F.lit("}")))
        .otherwise(F.concat(F.lit(',"origin":{"page":"s","rank":'), number, F.lit("}"))),
        F.lit("}"),
    )
    text = (
        F.when(case == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(case == 2, F.concat(F.lit("Here you go: "), body, F.lit(" Hope that helps.")))
        .when(case == 3, F.concat(body, F.lit("\n\nThat is all.")))
        .when(case == 4, F.concat(F.left(body, F.length(body) - 2), F.lit(" ")))
        .when(case == 9, "  \n ")
        .when(case == 10, F.concat(F.lit("Result:\n```\n"), body, F.lit("\n```\nDone.")))
        .when(case == 11, "I cannot do that.")
        .otherwise(body)
    )
    return e.select(
        F.col("event_id").alias("observation_id"),
        F.col("event_type").alias("model"),
        F.concat(F.lit("p"), _text(F.col("user_id") % 3)).alias("provider"),
        F.concat(F.lit("i"), _text(F.col("user_id"))).alias("item_id"),
        text.alias("output"),
        F.lit(None).cast("string").alias("error"),
    )


def verdict_texts(spark, sf_dir) -> DataFrame:
    """A judge reply per event, in every shape a judge may answer."""
    e = table(spark, sf_dir, "events")
    case = F.col("event_id") % 12
    score = _text(1 + F.col("user_id") % 5)
    body = F.concat(F.lit('{"score": '), score, F.lit(', "reasoning": "'), F.col("event_type"), F.lit('."}'))
    text = (
        F.when(case == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(case == 2, F.concat(F.lit("  ```\n"), body, F.lit("\n```  ")))
        .when(case == 3, "I think it is good.")
        .when(case == 4, '{"score": "excellent", "reasoning": "x"}')
        .when(case == 5, F.concat(F.lit('{"score": "'), score, F.lit('.5"}')))
        .when(case == 6, '{"score": null, "reasoning": "none"}')
        .when(case == 7, F.concat(body, F.lit(" trailing")))
        .when(case == 8, '{"score": 9, "reasoning": null}')
        .when(case == 9, '{"score": true}')
        .when(case == 10, F.left(body, F.lit(12)))
        .otherwise(body)
    )
    return e.select(
        F.col("event_id").alias("observation_id"),
        text.alias("content"),
        F.when(case == 10, True).when(case < 6, False).alias("truncated"),
    )


def model_list(spark, sf_dir) -> DataFrame:
    """Customers as (model, provider) pairs; a tenth of the names repeat on two providers."""
    c = table(spark, sf_dir, "customer")
    provider = F.element_at(F.array(*[F.lit(p) for p in fixed.PROVIDERS]), (F.col("c_nationkey") % 4 + 1))
    return c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 10 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("model"),
        provider.alias("provider"),
    )

"""Raw provider replies to one completion layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.identity import is_finite, ns_to_ms
from gradeloom.functions.json_text import strict_json
from gradeloom.functions.text import is_blank, let, trim_all


def _typed(value: Column, kind: str, cast: str) -> Column:
    """The value where its JSON type starts with `kind`, else null."""
    return F.when(F.schema_of_variant(value).startswith(kind), F.try_variant_get(value, "$", cast))


def _get(body: Column, path: str, cast: str = "variant") -> Column:
    return F.try_variant_get(body, path, cast)


def _present(value: Column) -> Column:
    """Null for a JSON null as for a missing field."""
    return F.when(~F.is_variant_null(value), value)


def message_text(message: Column) -> Column:
    """Assistant text of a message object; empty where there is none.

    A non-blank string content; else its joined text parts; else the first
    reasoning field set; else the blank content itself.
    """
    return let(message, _message_text)


def _message_text(message: Column) -> Column:
    content = _get(message, "$.content")
    plain = _typed(content, "STRING", "string")
    parts = F.coalesce(_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.filter(
        F.transform(
            parts,
            lambda p: F.struct(
                _get(p, "$.type", "string").alias("type"), _typed(_get(p, "$.text"), "STRING", "string").alias("text")
            ),
        ),
        lambda p: (p["type"] == "text") | p["text"].isNotNull(),
    )
    joined = trim_all(F.array_join(F.transform(texts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    reasoning = F.coalesce(
        *[_present(_get(message, f"$.{name}")) for name in ("reasoning_content", "reasoning", "thinking")]
    )
    thought = _typed(reasoning, "STRING", "string")
    return (
        F.when(~is_blank(plain), plain)
        .when(F.coalesce(joined, F.lit("")) != "", joined)
        .when(~is_blank(thought), thought)
        .otherwise(F.coalesce(plain, F.lit("")))
    )


def _count(body: Column, path: str) -> Column:
    return F.coalesce(_get(body, path, "bigint"), F.lit(0).cast("long"))


def _duration_ms(body: Column, path: str) -> Column:
    value = _get(body, path, "double")
    return F.when(is_finite(value), ns_to_ms(value))


def normalize_responses(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the completion columns of each reply; needs `provider` and the raw JSON.

    `truncated` stays null where the provider does not report it. A reply that
    is not JSON gets an `error` unless the row already has one.
    """
    body = F.col("_body")
    native = F.col("provider") == "ollama"
    candidates = F.col("provider") == "gemini"

    message = F.coalesce(_present(_get(body, "$.choices[0].message")), _present(_get(body, "$.message")))
    candidate_parts = F.coalesce(
        _get(body, "$.candidates[0].content.parts", "array<variant>"), F.array().cast("array<variant>")
    )
    candidate_text = F.array_join(
        F.transform(candidate_parts, lambda p: F.coalesce(_get(p, "$.text", "string"), F.lit(""))), ""
    )
    done = F.when(native, _get(body, "$.done_reason", "string")).when(
        candidates, _get(body, "$.candidates[0].finishReason", "string")
    )
    tokens_in = (
        F.when(native, _count(body, "$.prompt_eval_count"))
        .when(candidates, _count(body, "$.usageMetadata.promptTokenCount"))
        .otherwise(_count(body, "$.usage.prompt_tokens"))
    )
    tokens_out = (
        F.when(native, _count(body, "$.eval_count"))
        .when(candidates, _count(body, "$.usageMetadata.candidatesTokenCount"))
        .otherwise(_count(body, "$.usage.completion_tokens"))
    )
    total = (
        F.when(native, tokens_in + tokens_out)
        .when(candidates, _count(body, "$.usageMetadata.totalTokenCount"))
        .otherwise(_count(body, "$.usage.total_tokens"))
    )
    readable = body.isNotNull()
    unreadable = F.when(
        F.col(raw).isNotNull() & ~readable, F.lit("provider reply is not valid JSON")
    )
    known_error = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    return (
        replies.withColumn("_body", strict_json(F.col(raw)))
        .withColumns(
            {
                "content": F.when(
                    readable, F.when(candidates, candidate_text).otherwise(message_text(message))
                ),
                "truncated": F.when(readable & native, F.coalesce(done == "length", F.lit(False))).when(
                    readable & candidates, F.coalesce(done == "MAX_TOKENS", F.lit(False))
                ),
                "done_reason": done,
                "tokens_in": F.when(readable, tokens_in),
                "tokens_out": F.when(readable, tokens_out),
                "tokens_total": F.when(readable, total),
                "load_ms": F.when(native, _duration_ms(body, "$.load_duration")),
                "prompt_eval_ms": F.when(native, _duration_ms(body, "$.prompt_eval_duration")),
                "eval_ms": F.when(native, _duration_ms(body, "$.eval_duration")),
                "error": F.coalesce(known_error, unreadable),
            }
        )
        .drop("_body")
    )

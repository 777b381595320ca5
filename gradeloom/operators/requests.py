"""Messages, trace attributes and provider request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.functions.identity import data_url_info, provider_tag
from gradeloom.functions.json_text import strict_json
from gradeloom.functions.text import not_empty


def _part(kind: str, text: Column, url: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), url.cast("string").alias("url"))


def build_user_content(text: Column, image: Column) -> Column:
    """Content parts of the user message: the text, and the image where there is one."""
    none = F.lit(None)
    only_text = F.array(_part("text", text, none))
    return F.when(not_empty(image).isNull(), only_text).otherwise(
        F.array(_part("text", text, none), _part("image_url", none, image))
    )


def build_messages(text: Column, image: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), build_user_content(text, image).alias("parts")))


def trace_identity(df: DataFrame, endpoint: Column | None = None) -> DataFrame:
    """Adds trace name, tags and the metadata map (text values cut to 200 characters).

    Needs model, provider, item_id, dataset_id and image.
    """
    tag = provider_tag(F.col("provider"), endpoint)
    has_image = not_empty(F.col("image")).isNotNull().cast("string")
    entries = {
        "datasetId": F.col("item_id"),
        "model": F.col("model"),
        "provider": F.col("provider"),
        "providerTag": tag,
        "hasImage": has_image,
    }
    return df.withColumns(
        {
            "trace_name": F.concat(
                F.lit(fixed.TRACE_PREFIX), F.col("model"), F.lit(":"), F.col("item_id")
            ),
            "tags": F.array(
                F.concat(F.lit(fixed.DATASET_TAG), F.col("dataset_id")),
                F.concat(F.lit(fixed.PROVIDER_TAG), tag),
            ),
            "metadata": F.create_map(
                *[x for k, v in entries.items() for x in (F.lit(k), F.left(v, F.lit(fixed.METADATA_LIMIT)))]
            ),
        }
    )


def to_response_format(schema: Column) -> Column:
    """JSON text of the structured-output request for a schema text; null without one."""
    return F.when(
        schema.isNotNull(),
        F.concat(F.lit(fixed.RESPONSE_FORMAT[0]), schema, F.lit(fixed.RESPONSE_FORMAT[1])),
    )


def _json_value(text: Column) -> Column:
    """A parameter value as JSON: numbers, flags and objects as such, else a string."""
    return F.coalesce(strict_json(text), text.cast("variant"))


def _option(name: str) -> Column:
    """A parameter as it was given."""
    return F.try_element_at(F.col("effective"), F.lit(name))


def _typed_option(name: str) -> Column:
    """A parameter as JSON value."""
    return F.try_element_at(F.col("_typed"), F.lit(name))


def _null_if_no_fields(fields: Column, sources: list[Column]) -> Column:
    return F.when(F.coalesce(*sources).isNotNull(), fields)


def _openai_messages() -> Column:
    """A message with text alone has a plain string content, one with an image an array."""

    def part(p):
        image = F.struct(
            F.lit("image_url").alias("type"),
            F.lit(None).cast("string").alias("text"),
            F.struct(p["url"].alias("url")).alias("image_url"),
        )
        text = F.struct(
            F.lit("text").alias("type"),
            p["text"].alias("text"),
            F.lit(None).cast("struct<url:string>").alias("image_url"),
        )
        return F.when(p["type"] == "image_url", image).otherwise(text)

    def message(m):
        only_text = F.size(F.filter(m["parts"], lambda p: p["type"] != "text")) == 0
        plain = F.array_join(F.transform(m["parts"], lambda p: p["text"]), "\n").cast("variant")
        parts = F.try_parse_json(F.to_json(F.transform(m["parts"], part)))
        return F.struct(m["role"].alias("role"), F.when(only_text, plain).otherwise(parts).alias("content"))

    return F.transform(F.col("messages"), message)


def _openai_request(budget_name: str, with_effort: bool) -> Column:
    fields = [
        F.col("model").alias("model"),
        _openai_messages().alias("messages"),
        _typed_option("temperature").alias("temperature"),
        _typed_option("max_completion_tokens").alias(budget_name),
        _typed_option("top_p").alias("top_p"),
        F.lit(False).alias("stream"),
        _typed_option("response_format").alias("response_format"),
    ]
    if with_effort:
        fields.append(_option("reasoning_effort").alias("reasoning_effort"))
    return F.to_json(F.struct(*fields))


def _bare_base64(url: Column) -> Column:
    return F.when(url.startswith("data:"), F.substr(url, F.instr(url, ",") + 1)).otherwise(url)


def _native_request() -> Column:
    def message(m):
        texts = F.transform(F.filter(m["parts"], lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit("")))
        images = F.transform(
            F.filter(m["parts"], lambda p: p["type"] == "image_url"), lambda p: _bare_base64(p["url"])
        )
        return F.struct(
            m["role"].alias("role"),
            F.array_join(texts, "\n").alias("content"),
            F.when(F.size(images) > 0, images).alias("images"),
        )

    option_names = {
        "temperature": "temperature",
        "max_completion_tokens": "num_predict",
        "top_p": "top_p",
        "repeat_penalty": "repeat_penalty",
        "seed": "seed",
    }
    options = F.struct(*[_typed_option(k).alias(v) for k, v in option_names.items()])
    wanted = _option("response_format")
    kind = F.get_json_object(wanted, "$.type")
    output_format = F.when(
        kind == "json_schema", F.try_variant_get(F.try_parse_json(wanted), "$.json_schema.schema", "variant")
    ).when(kind == "json_object", F.lit("json").cast("variant"))
    return F.to_json(
        F.struct(
            F.col("model").alias("model"),
            F.transform(F.col("messages"), message).alias("messages"),
            F.lit(False).alias("stream"),
            _null_if_no_fields(options, [_option(k) for k in option_names]).alias("options"),
            output_format.alias("format"),
            _typed_option("think").alias("think"),
            _typed_option("keep_alive").alias("keep_alive"),
        )
    )


def _contents_request() -> Column:
    inline = "struct<mimeType:string,data:string>"

    def part(p):
        media = data_url_info(p["url"])
        return F.struct(
            not_empty(p["text"]).alias("text"),
            F.when(
                media["payload"].isNotNull(),
                F.struct(media["mime"].alias("mimeType"), media["payload"].alias("data")),
            )
            .cast(inline)
            .alias("inlineData"),
        )

    def content(m):
        kept = F.filter(
            F.transform(m["parts"], part), lambda p: p["text"].isNotNull() | p["inlineData"].isNotNull()
        )
        return F.struct(
            F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), kept.alias("parts")
        )

    wants_json = F.get_json_object(_option("response_format"), "$.type").isin("json_object", "json_schema")
    return F.to_json(
        F.struct(
            F.filter(F.transform(F.col("messages"), content), lambda c: F.size(c["parts"]) > 0).alias("contents"),
            F.struct(
                _typed_option("temperature").alias("temperature"),
                _typed_option("max_completion_tokens").alias("maxOutputTokens"),
                _typed_option("top_p").alias("topP"),
                F.when(wants_json, "application/json").alias("responseMimeType"),
                F.struct(F.lit(0).alias("thinkingBudget")).alias("thinkingConfig"),
            ).alias("generationConfig"),
        )
    )


def build_provider_requests(matrix: DataFrame) -> DataFrame:
    """Adds `request`: the JSON body in the shape of each row's provider.

    Needs model, provider, messages and `effective` (see `effective_params`).
    Unset fields are absent, not null. An unknown provider has a null request.
    """
    provider = F.col("provider")
    typed = F.transform_values("effective", lambda _, value: _json_value(value))
    return matrix.withColumn("_typed", typed).withColumn(
        "request",
        F.when(provider == "groq", _openai_request("max_completion_tokens", with_effort=False))
        .when(provider == "nvidia", _openai_request("max_tokens", with_effort=True))
        .when(provider == "ollama", _native_request())
        .when(provider == "gemini", _contents_request()),
    ).drop("_typed")

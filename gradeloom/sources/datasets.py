"""Evaluation inputs: items, models, captured requests, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom import fixed, schemas
from gradeloom.functions.identity import extract_referenced_paths, is_data_url, mime_type
from gradeloom.functions.json_text import strict_json
from gradeloom.functions.text import not_empty
from gradeloom.operators.matrix import normalize_models

REQUIRED = ["item_id", "input", "criteria"]


def load_items(spark: SparkSession, path: str, dataset_id: str | None = None, format: str = "json") -> DataFrame:
    """Evaluation cases, with `error` naming a missing required field.

    `dataset_id` prunes to one folder where the data is partitioned by it.
    """
    items = spark.read.schema(schemas.ITEMS).format(format).load(path)
    if dataset_id is not None:
        items = items.where(F.col("dataset_id") == dataset_id)
    missing = F.array_compact(F.array(*[F.when(not_empty(F.col(c)).isNull(), F.lit(c)) for c in REQUIRED]))
    return items.withColumn(
        "error",
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
    )


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """Model list from JSON lines; each line a bare string or an object."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "entry")
    return normalize_models(lines)


def _option(body: Column, path: str) -> Column:
    """An option as text; JSON null counts as given, a missing one does not."""
    value = F.try_variant_get(body, path, "variant")
    return F.when(value.isNotNull(), F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("null")))


def parse_captured_requests(df: DataFrame, text: str = "value") -> DataFrame:
    """Captured model requests (JSON text) to item columns; bad ones get an `error`.

    prompt, schema, options, warnings and referenced images of the first user
    message. Options that only one provider implements are kept and warned about.
    """
    body = F.col("_body")
    messages = F.coalesce(
        F.try_variant_get(body, "$.messages", "array<variant>"), F.array().cast("array<variant>")
    )
    user = F.get(
        F.filter(messages, lambda m: F.try_variant_get(m, "$.role", "string") == "user"), F.lit(0)
    )
    declared = F.try_variant_get(body, "$.format", "variant")
    wrapped = F.try_variant_get(declared, "$.json_schema", "variant")
    schema = F.when(
        ~F.is_variant_null(declared),
        F.to_json(F.when(wrapped.isNotNull() & ~F.is_variant_null(wrapped), wrapped).otherwise(declared)),
    )
    mapped = {
        "temperature": _option(body, "$.options.temperature"),
        "max_completion_tokens": _option(body, "$.options.num_predict"),
        "repeat_penalty": _option(body, "$.options.repeat_penalty"),
        "think": _option(body, "$.think"),
    }
    given = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in mapped.items()]),
            lambda e: e["value"].isNotNull(),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(
                mapped["repeat_penalty"].isNotNull(),
                F.concat(
                    F.lit("options.repeat_penalty="),
                    mapped["repeat_penalty"],
                    F.lit(" is ignored by providers that do not support it"),
                ),
            ),
            F.when(mapped["think"] == "true", F.lit('"think": true requests a reasoning pass, which is not scored')),
        )
    )
    images = F.coalesce(
        F.try_variant_get(F.col("_user"), "$.images", "array<string>"), F.array().cast("array<string>")
    )
    referenced = F.flatten(
        F.transform(
            images,
            lambda i: F.when(is_data_url(i), F.array(F.lit(fixed.INLINE_IMAGE_LABEL))).otherwise(
                extract_referenced_paths(i)
            ),
        )
    )
    has_user = F.col("_user").isNotNull()
    return (
        df.withColumn("_body", strict_json(F.col(text)))
        .withColumn("_user", user)
        .withColumns(
            {
                "prompt": F.try_variant_get(F.col("_user"), "$.content", "string"),
                "score_schema": F.when(has_user, schema),
                "options": F.when(has_user, given),
                "warnings": F.when(has_user, warnings),
                "referenced_images": F.when(has_user, referenced),
                "error": F.when(body.isNull(), "not valid JSON").when(
                    ~has_user, "no message with role user"
                ),
            }
        )
        .drop("_body", "_user")
    )


def load_captured_requests(spark: SparkSession, path: str) -> DataFrame:
    """Captured request files, one row per file."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return parse_captured_requests(files, "value").drop("value")


def load_images(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Image files as data URLs: path, mime, length, data_url, error.

    Files over `max_bytes` get an error. The size filter reaches the scan, so
    their content is never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    payload = F.regexp_replace(F.base64("content"), r"[\r\n]", "")
    mime = mime_type(F.col("path"))
    small = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    loaded = small.select(
        "path",
        mime.alias("mime"),
        "length",
        F.concat(F.lit("data:"), mime, F.lit(";base64,"), payload).alias("data_url"),
        F.lit(None).cast("string").alias("error"),
    )
    if max_bytes is None:
        return loaded
    megabytes = F.format_number(F.col("length") / (1024 * 1024), 1)
    refused = files.where(F.col("length") > max_bytes).select(
        "path",
        mime.alias("mime"),
        "length",
        F.lit(None).cast("string").alias("data_url"),
        F.concat(megabytes, F.lit(f" MB is over the {max_bytes / (1024 * 1024):.1f} MB limit")).alias("error"),
    )
    return loaded.unionByName(refused)

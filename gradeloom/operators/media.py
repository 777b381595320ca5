"""Inline images out of wide text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A base64 data URL anywhere in a text.
INLINE_MEDIA = r"data:[A-Za-z0-9.+-]+/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/=]+"


def _inline(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(INLINE_MEDIA), 0)


def media_references(text: Column) -> Column:
    """The text with each inline data URL replaced by `media://<sha256>`."""
    between = F.split(text, INLINE_MEDIA, -1)
    references = F.transform(_inline(text), lambda url: F.concat(F.lit("media://"), F.sha2(url, 256)))
    pieces = F.zip_with(between, references, lambda piece, ref: F.concat(piece, F.coalesce(ref, F.lit(""))))
    return F.when(F.size(references) > 0, F.array_join(pieces, "")).otherwise(text)


def offload_media(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with references, media table with each image once).

    The media table is keyed by the hash of the data URL; copies of one image
    are folded on the map side before their bytes are shuffled.
    """
    refs = df.withColumn(column, media_references(F.col(column)))
    urls = df.select(F.explode(_inline(F.col(column))).alias("_url")).select(
        F.sha2("_url", 256).alias("media_id"), "_url"
    )
    once = urls.groupBy("media_id").agg(F.any_value("_url").alias("_url"))
    media = once.select(
        "media_id",
        F.regexp_extract("_url", "^data:([^;]+);", 1).alias("mime"),
        F.try_to_binary(F.substr(F.col("_url"), F.instr(F.col("_url"), ",") + 1), F.lit("base64")).alias("content"),
    )
    return refs, media

"""Trace names, tags, endpoints and data URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.functions.text import not_empty


def parse_trace_name(trace_name: Column) -> Column:
    """`eval:<model>:<item>` split at its last colon; null for any other name."""
    pattern = "(?s)^" + fixed.TRACE_PREFIX + r"(.*):([^:]*)\z"
    return F.when(
        trace_name.rlike(pattern),
        F.struct(
            F.regexp_extract(trace_name, pattern, 1).alias("model"),
            F.regexp_extract(trace_name, pattern, 2).alias("item_id"),
        ),
    )


def resolve_model_name(model: Column, trace_name: Column) -> Column:
    """The recorded model, else the one in the trace name, else a marker."""
    return F.coalesce(
        not_empty(model), not_empty(parse_trace_name(trace_name)["model"]), F.lit(fixed.UNKNOWN)
    )


def resolve_item_id(trace_name: Column) -> Column:
    return F.coalesce(parse_trace_name(trace_name)["item_id"], F.lit(fixed.UNKNOWN))


def provider_from_tags(tags: Column) -> Column:
    """Rest of the first `provider:` tag; null without one."""
    first = F.get(F.filter(tags, lambda tag: tag.startswith(fixed.PROVIDER_TAG)), F.lit(0))
    return F.substr(first, F.lit(len(fixed.PROVIDER_TAG) + 1))


def endpoint_locality(url: Column) -> Column:
    """`local` for a loopback host, `remote` for anything else or no URL."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^\[|\]\z", "")
    loopback = (
        host.isin("localhost", "::1", "0:0:0:0:0:0:0:1", "0.0.0.0", "::")
        | host.endswith(".localhost")
        | host.rlike(r"^127(\.\d{1,3}){3}\z")
    )
    return F.when(loopback, "local").otherwise("remote")


def provider_tag(provider: Column, url: Column | None = None) -> Column:
    """Provider name; with `/local` or `/remote` where the provider can be either.

    Without a URL that provider is at its default endpoint.
    """
    if url is None:
        url = F.lit(fixed.DEFAULT_LOCAL_ENDPOINT)
    return F.when(
        provider == fixed.LOCAL_CAPABLE_PROVIDER, F.concat(provider, F.lit("/"), endpoint_locality(url))
    ).otherwise(provider)


def is_data_url(value: Column) -> Column:
    return F.coalesce(value.startswith("data:"), F.lit(False))


def data_url_info(url: Column) -> Column:
    """MIME type, payload, decoded byte count (padding ignored) and its `N KB` label."""
    pattern = r"(?s)^data:([^;]+);base64,(.*)\z"
    # The payload starts behind the first comma; without one the whole text counts.
    payload_length = F.length(url) - F.instr(url, ",")
    decoded = F.floor(payload_length * 3 / 4)
    return F.struct(
        is_data_url(url).alias("is_data_url"),
        not_empty(F.regexp_extract(url, pattern, 1)).alias("mime"),
        F.when(url.rlike(pattern), F.regexp_extract(url, pattern, 2)).alias("payload"),
        decoded.alias("bytes"),
        F.concat(F.round(decoded / 1024).cast("long").cast("string"), F.lit(" KB")).alias("size_label"),
    )


def mime_type(path: Column) -> Column:
    """MIME type by lower-cased file extension."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)\z", 1))
    table = F.create_map(*[F.lit(x) for pair in fixed.MIME_BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension), F.lit(fixed.MIME_FALLBACK))


def extract_referenced_paths(text: Column) -> Column:
    """Every file path named by the base64 path template, decoded, in order."""
    encoded = F.regexp_extract_all(text, F.lit(fixed.IMAGE_PATH_TEMPLATE), 1)
    return F.array_compact(
        F.transform(encoded, lambda x: F.try_to_binary(x, F.lit("base64")).cast("string"))
    )


def ns_to_ms(nanoseconds: Column) -> Column:
    return F.round(nanoseconds / 1e6).cast("long")


def sec_to_ms(seconds: Column) -> Column:
    return seconds * 1000


def is_finite(number: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), F.lit(False))

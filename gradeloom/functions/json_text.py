"""Strict and tolerant JSON parsing into VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.text import let, trim_all


def _proof(text: Column) -> Column:
    return F.xxhash64(text)


def _parse_pair(text: Column) -> Column:
    """The text parsed as the first of two array elements, the second being its own hash.

    The built-in parser ignores whatever follows the first value. Here, trailing
    text breaks the array, makes it longer or hides the hash. Texts that do not
    start and end as a JSON value are not parsed, as failing is what costs most.
    """
    bare = F.btrim(text, F.lit(" \t\n\r"))
    plausible = F.left(bare, F.lit(1)).isin(list('{["-0123456789tfn')) & F.right(bare, F.lit(1)).isin(
        list('}]"0123456789el')
    )
    wrapped = F.concat(F.lit("["), text, F.lit(","), _proof(text).cast("string"), F.lit("]"))
    return F.when(plausible, F.try_variant_get(F.try_parse_json(wrapped), "$", "array<variant>"))


def _proven(pair: Column, text: Column) -> Column:
    """The first element, if the pair is the text and its hash and nothing else."""
    hash_seen = F.try_variant_get(F.get(pair, F.lit(1)), "$", "bigint")
    return F.when((F.size(pair) == 2) & (hash_seen == _proof(text)), F.get(pair, F.lit(0)))


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, else null.

    Text and parse are bound once, so the expression stays small wherever the
    optimizer moves it, e.g. into a filter below.
    """
    return let(text, lambda t: let(_parse_pair(t), lambda pair: _proven(pair, t)))


def _first_fenced_block(text: Column) -> Column:
    return trim_all(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1))


def _outermost_span(text: Column) -> Column:
    """From the first opening brace or bracket to the last closer of its kind."""
    first = F.regexp_extract(text, r"[{\[]", 0)
    closer = F.when(first == "{", F.lit("}")).when(first == "[", F.lit("]"))
    start = F.when(first != "", F.instr(text, first))
    end = F.length(text) - F.length(F.call_function("substring_index", text, closer, F.lit(-1)))
    return F.when(end > start, F.substring(text, start, end - start + 1))


def _candidates(text: Column) -> list[Column]:
    """Readings of a trimmed model response, in the order they are tried."""
    return [text, _first_fenced_block(text), _outermost_span(text)]


def extract_json_loose(text: Column) -> Column:
    """First reading of a model response that is strict JSON, as VARIANT, else null.

    Tried in order: the trimmed text, its first fenced block, and the span from
    the first `{` or `[` to the last matching closer.
    """
    trimmed = trim_all(F.coalesce(text, F.lit("")))
    return let(trimmed, lambda t: F.coalesce(*[strict_json(c) for c in _candidates(t)]))


def loose_parse_error(text: Column) -> Column:
    """Why a text that `extract_json_loose` rejected could not be read."""
    blank = trim_all(F.coalesce(text, F.lit(""))) == ""
    return F.when(blank, F.lit("empty response")).otherwise(F.lit("output is not parseable JSON"))


def schema_fields(schema_text: Column) -> Column:
    """Top-level property names of an object schema given as text, else null."""
    is_object = F.get_json_object(schema_text, "$.type") == "object"
    return F.when(is_object, F.json_object_keys(F.get_json_object(schema_text, "$.properties")))

"""Checks before a run: catalogs, capabilities, parameters, misspelt names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.json_text import strict_json
from gradeloom.functions.text import not_empty
from gradeloom.session import scratch_path


def missing_models(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested (provider, model) pairs, each once, that the catalog does not list."""
    return (
        requested.select("provider", "model")
        .distinct()
        .join(catalog.select("provider", "model").distinct(), ["provider", "model"], "left_anti")
    )


def _text(entry: Column, path: str) -> Column:
    return not_empty(F.try_variant_get(entry, path, "string"))


def _entries(body: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(body, path, "array<variant>"), F.array().cast("array<variant>"))


def _strings(entry: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(entry, path, "array<string>"), F.array().cast("array<string>"))


def catalog_ids(catalogs: DataFrame) -> DataFrame:
    """Model ids of catalog replies: (provider, raw JSON) to distinct (provider, model).

    `data[].id` for the two OpenAI-style providers; `models[].model` and
    `models[].name` for the local one; `models[].name` without its `models/`
    prefix for the fourth, only where the model can generate content.
    """
    body = F.col("_body")
    listed = F.transform(_entries(body, "$.data"), lambda e: _text(e, "$.id"))
    local = F.flatten(
        F.transform(_entries(body, "$.models"), lambda e: F.array(_text(e, "$.model"), _text(e, "$.name")))
    )
    generating = F.filter(
        _entries(body, "$.models"),
        lambda e: F.array_contains(_strings(e, "$.supportedGenerationMethods"), "generateContent"),
    )
    named = F.transform(generating, lambda e: not_empty(F.regexp_replace(_text(e, "$.name"), "^models/", "")))
    ids = (
        F.when(F.col("provider") == "ollama", local)
        .when(F.col("provider") == "gemini", named)
        .otherwise(listed)
    )
    return (
        catalogs.withColumn("_body", strict_json(F.col("raw")))
        .select("provider", F.explode(F.array_compact(ids)).alias("model"))
        .distinct()
    )


def catalog_details(catalogs: DataFrame) -> DataFrame:
    """(provider, model, capabilities) of the local provider's catalog replies."""
    return (
        catalogs.where(F.col("provider") == "ollama")
        .withColumn("_entry", F.explode(_entries(strict_json(F.col("raw")), "$.models")))
        .select(
            "provider",
            F.coalesce(_text(F.col("_entry"), "$.model"), _text(F.col("_entry"), "$.name")).alias("model"),
            _strings(F.col("_entry"), "$.capabilities").alias("capabilities"),
        )
    )


def not_vision_capable(models: DataFrame, details: DataFrame) -> DataFrame:
    """Known models without the `vision` capability; unknown models pass."""
    known = details.groupBy("provider", "model").agg(
        F.max(F.array_contains(F.coalesce("capabilities", F.array().cast("array<string>")), "vision")).alias(
            "_vision"
        )
    )
    return (
        models.select("provider", "model")
        .distinct()
        .join(known, ["provider", "model"])
        .where(~F.col("_vision"))
        .drop("_vision")
    )


def unsupported_params(matrix: DataFrame, supported: DataFrame) -> DataFrame:
    """Parameters a provider does not read, once per (provider, parameter).

    Pairs are made distinct before the join, so a hot provider is folded map-side.
    Providers that `supported` does not list are not reported.
    """
    given = F.concat(
        *[
            F.map_keys(F.map_filter(F.coalesce(c, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull()))
            for c in (F.col("params"), F.col("options"))
        ]
    )
    pairs = matrix.select("provider", F.explode(given).alias("param")).distinct()
    listed = supported.select("provider").distinct()
    return pairs.join(listed, "provider", "left_semi").join(supported, ["provider", "param"], "left_anti")


def _without_one(text: Column) -> Column:
    """All texts made by deleting one character."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))
    return F.coalesce(
        F.transform(
            places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substr(text, i + 1))
        ),
        F.array().cast("array<string>"),
    )


def _deletions(text: Column, depths: dict[int, list[int]]) -> Column:
    """Hashes of all texts made by so many deletions; each depth is made for texts of the given lengths alone."""
    none = F.array().cast("array<string>")
    level, found = F.array(text), []
    for depth in range(max(depths, default=-1) + 1):
        if depth:
            level = F.array_distinct(F.flatten(F.transform(level, _without_one)))
        if depths.get(depth):
            found.append(F.when(F.length(text).isin(depths[depth]), level).otherwise(none))
    return F.transform(F.array_distinct(F.concat(none, *found)), lambda x: F.xxhash64(x))


def _depths(keys: list[int], names: list[int], distance: int) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """By number of deletions, the lengths of keys and of names that have to be met so.

    Of two texts whose lengths differ by n, n edits go into the difference. The
    rest, distance - n, may cost a deletion in both; the longer text has n more.
    """
    of_keys: dict[int, set[int]] = {}
    of_names: dict[int, set[int]] = {}
    for k in keys:
        for m in names:
            for both in range(distance - abs(k - m) + 1):
                of_keys.setdefault(both + max(0, k - m), set()).add(k)
                of_names.setdefault(both + max(0, m - k), set()).add(m)
    return tuple({d: sorted(found) for d, found in depths.items()} for depths in (of_keys, of_names))


def _lengths(texts: DataFrame, most: int) -> list[int]:
    n = F.length("key")
    return [r["n"] for r in texts.where(n <= most).select(n.alias("n")).distinct().collect()]


# Texts up to this length meet on deletion variants, which grow with the square of it; longer ones on segments.
SHORT = 32


def _cut(length: Column, i: int, parts: int) -> Column:
    return F.floor(length * i / parts).cast("int")


def _segments(text: Column, distance: int) -> Column:
    """Hashes of the text's distance + 1 segments: two texts within the distance share one, nearly in place."""
    parts, n = distance + 1, F.length(text)
    return F.array(
        *[
            F.xxhash64(n, F.lit(i), F.substr(text, _cut(n, i, parts) + 1, _cut(n, i + 1, parts) - _cut(n, i, parts)))
            for i in range(parts)
        ]
    )


def _segment_probes(text: Column, distance: int) -> Column:
    """Hashes of all that could be a segment of a text within the distance: of any length near, at any place near."""
    parts, steps, found = distance + 1, range(-distance, distance + 1), []
    for longer in steps:
        n = (F.length(text) + longer).cast("int")
        for i in range(parts):
            begin, size = _cut(n, i, parts), _cut(n, i + 1, parts) - _cut(n, i, parts)
            for shift in steps:
                piece = F.substr(text, begin + shift + 1, size)
                found.append(F.when(begin + shift >= 0, F.xxhash64(n, F.lit(i), piece)))
    return F.array_distinct(F.array_compact(F.array(*found)))


def _matches(unknown: DataFrame, names: DataFrame, distance: int) -> DataFrame:
    """Best name within `distance` edits of each key that has one."""
    none, n = F.array().cast("array<bigint>"), F.length("key")
    # Lengths up to SHORT and a little more: a few numbers that say which deletions can meet at all.
    of_keys, of_names = _depths(_lengths(unknown, SHORT), _lengths(names, SHORT + distance), distance)
    segments = F.when(n > SHORT - distance, _segments(F.col("key"), distance)).otherwise(none)
    # A short key looks among deletion variants, a long one among segments; names near the limit are in both.
    variants = F.when(n <= SHORT, _deletions(F.col("key"), of_keys)).otherwise(_segment_probes(F.col("key"), distance))
    probes = unknown.select("key", F.explode(variants).alias("_variant"))
    index = names.select(
        F.col("key").alias("candidate"), "ordinal", F.explode(F.concat(_deletions(F.col("key"), of_names), segments)).alias("_variant")
    )
    # Sizes are estimated without the growth by variants, so neither side may be
    # taken for small enough to broadcast.
    return (
        probes.hint("merge")
        .join(index, "_variant")
        .select("key", "candidate", "ordinal", F.levenshtein("key", "candidate", distance).alias("distance"))
        .where(F.col("distance") >= 0)
        .groupBy("key")
        .agg(
            F.min_by("candidate", F.struct("distance", "ordinal")).alias("suggestion"),
            F.min("distance").alias("distance"),
        )
    )


def closest_match(keys: DataFrame, known: DataFrame, max_distance: int = 2) -> DataFrame:
    """Best known name for each unknown key, if at most `max_distance` edits away.

    Two texts within d edits share a text reachable from each by at most d
    deletions, and one of d + 1 segments, so an equi-join on those finds every
    true pair without comparing all keys with all names. Only the deletions that
    the lengths of keys and names leave possible are made. Distances are tried in
    turn, and only keys without a match go on to the next, wider one; what a
    distance found is written to the shared folder, so that it is found once.
    Smaller distance wins, then the smaller `ordinal`. Known keys are not
    reported; keys without a match have nulls.
    """
    spark = keys.sparkSession
    names = known.groupBy("key").agg(F.min("ordinal").alias("ordinal"))
    left = keys.select("key").distinct().join(names, "key", "left_anti")
    found = None
    for distance in range(1, max_distance + 1):
        path = scratch_path(spark, "unknown-keys")
        left.write.parquet(path)
        left = spark.read.parquet(path)
        path = scratch_path(spark, "matches")
        _matches(left, names, distance).write.parquet(path)
        matched = spark.read.parquet(path)
        found = matched if found is None else found.unionByName(matched)
        left = left.join(matched.select("key"), "key", "left_anti")
    nothing = {"suggestion": F.lit(None).cast("string"), "distance": F.lit(None).cast("int")}
    return found.unionByName(left.withColumns(nothing))

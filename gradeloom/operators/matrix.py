"""Model lists, the model-by-item matrix, and its generation parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.operators.spread import salted_join


def normalize_models(entries: DataFrame) -> DataFrame:
    """Model entries to (model, provider, params).

    `entries` holds one JSON text per row in `entry`: a bare string, or an
    object with `id`, optional `provider` and further keys that become params.
    A missing provider is the default one. Bad entries have a null model.
    """
    text = F.trim(F.col("entry"))
    fields = F.when(text.startswith("{"), F.from_json(text, "map<string,string>"))
    bare = F.when(~text.startswith("{"), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v"))
    rest = F.map_filter(fields, lambda k, _: ~k.isin("id", "provider"))
    return entries.select(
        *[c for c in entries.columns if c != "entry"],
        F.coalesce(bare, F.try_element_at(fields, F.lit("id"))).alias("model"),
        F.coalesce(F.try_element_at(fields, F.lit("provider")), F.lit(fixed.DEFAULT_PROVIDER)).alias("provider"),
        F.when(F.size(rest) > 0, rest).alias("params"),
    )


def combine_models(local: DataFrame, hosted: DataFrame) -> DataFrame:
    """Local models first, then hosted ones; duplicates are kept."""
    return local.withColumn("list_rank", F.lit(0)).unionByName(hosted.withColumn("list_rank", F.lit(1)))


def parse_enabled(enabled: str | list[str] | None) -> list[str]:
    """Provider names of a comma list; blanks dropped, none given means all.

    An unknown name is an error, raised before any job starts.
    """
    if enabled is None:
        return list(fixed.PROVIDERS)
    parts = enabled.split(",") if isinstance(enabled, str) else enabled
    names = [p.strip() for p in parts if p.strip()]
    unknown = [n for n in names if n not in fixed.PROVIDERS]
    if unknown:
        raise ValueError(f"unknown provider {unknown[0]!r}; known: {', '.join(fixed.PROVIDERS)}")
    return names


def filter_enabled(models: DataFrame, enabled: str | list[str] | None = None) -> DataFrame:
    return models.where(F.col("provider").isin(parse_enabled(enabled)))


def skipped_providers(models: DataFrame, enabled: str | list[str] | None = None) -> DataFrame:
    """Providers of listed models that are not enabled."""
    return models.where(~F.col("provider").isin(parse_enabled(enabled))).select("provider").distinct()


def eval_matrix(models: DataFrame, items: DataFrame) -> DataFrame:
    """Every model with every item, and the 1-based model-major position.

    Needs `model_index` and `item_index`, 0-based and without gaps (see
    `with_row_index`). Items are repeated once per model by an index sequence
    and meet the models in an equi-join, so neither side has to fit in memory.
    Keep images out of `items`: carry a media id and join the bytes later, as
    `plan_requests` does.
    """
    sides = models.agg(F.count("*")).scalar()
    n_items = items.agg(F.count("*")).scalar()
    # sequence(0, -1) would count down, hence the guard for an empty model list.
    indexes = F.when(sides > 0, F.sequence(F.lit(0).cast("long"), sides - 1))
    repeated = items.withColumn("model_index", F.explode(indexes))
    keyed = models.withColumn("model_index", F.col("model_index").cast("long"))
    # Every index has its model, so a left join drops nothing; it also rules out a
    # broadcast of the repeated items, whose size is estimated without the repeats.
    return salted_join(repeated, keyed, ["model_index"], "left", ["item_index"]).withColumn(
        "position", F.col("model_index") * n_items + F.col("item_index") + 1
    )


def _merge(first: Column, second: Column) -> Column:
    """Both maps; the second wins where both set a key to something."""
    return F.map_zip_with(first, second, lambda _, a, b: F.coalesce(b, a))


def _or_empty(options: Column) -> Column:
    return F.coalesce(options, F.create_map().cast("map<string,string>"))


def supported_params(spark) -> DataFrame:
    """(provider, param) pairs the provider clients read."""
    pairs = [(provider, param) for provider, names in fixed.SUPPORTED_PARAMS.items() for param in names]
    return spark.createDataFrame(pairs, "provider string, param string")


def effective_params(matrix: DataFrame) -> DataFrame:
    """Adds `effective`: client defaults < model params < item options < response format.

    Parameters the provider does not read are left out; see `unsupported_params`.
    """
    params = [F.col("params"), F.col("options")]
    layers = reduce(_merge, [_or_empty(p) for p in params])
    with_format = _merge(
        layers,
        F.when(
            F.col("response_format").isNotNull(),
            F.create_map(F.lit("response_format"), F.col("response_format")),
        ).otherwise(F.create_map().cast("map<string,string>")),
    )

    defaults = F.create_map().cast("map<string,string>")
    accepted = F.lit(None).cast("array<string>")
    for provider, names in fixed.SUPPORTED_PARAMS.items():
        is_provider = F.col("provider") == provider
        accepted = F.when(is_provider, F.array(*[F.lit(n) for n in names])).otherwise(accepted)
        table = fixed.CLIENT_DEFAULTS.get(provider)
        if table:
            filled = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
            defaults = F.when(is_provider, filled).otherwise(defaults)

    merged = _merge(defaults, with_format)
    kept = F.map_filter(
        merged, lambda k, v: v.isNotNull() & F.coalesce(F.array_contains(accepted, k), F.lit(True))
    )
    return matrix.withColumn("effective", kept)

"""All checks before a run, as one table of findings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.operators import preflight as checks
from gradeloom.operators.catalogs import list_catalogs
from gradeloom.operators.inference import infer
from gradeloom.operators.matrix import supported_params
from gradeloom.operators.requests import build_messages, build_provider_requests
from gradeloom.operators.summary import classify_errors
from gradeloom.session import scratch_path

PROBE_TOKENS = "32"


def probes(requested: DataFrame, judge_model: str, judge_provider: str) -> DataFrame:
    """One tiny request per provider: to the judge where it is the judge's, else to the first model by name."""
    is_judge = (F.col("provider") == judge_provider) & (F.col("model") == judge_model)
    chosen = requested.groupBy("provider").agg(F.min_by("model", F.struct(~is_judge, "model")).alias("model"))
    effective = F.create_map(F.lit("temperature"), F.lit("0"), F.lit("max_completion_tokens"), F.lit(PROBE_TOKENS))
    ready = chosen.withColumns(
        {"item_id": F.lit("probe"), "messages": build_messages(F.lit("ping"), F.lit(None).cast("string")), "effective": effective}
    )
    # A provider that this package has no request shape for gets the plain one.
    plain = json.dumps({"messages": [{"role": "user", "content": "ping"}]})
    return build_provider_requests(ready).withColumn("request", F.coalesce("request", F.lit(plain)))


def preflight(
    models: DataFrame,
    catalog: DataFrame,
    client_factory,
    details: DataFrame | None = None,
    matrix: DataFrame | None = None,
    judge_model: str = fixed.JUDGE_MODEL,
    judge_provider: str = fixed.DEFAULT_PROVIDER,
    **options,
) -> DataFrame:
    """Findings (check, provider, name, message, fatal) for the models of a run and its judge.

    `missing`: the provider's catalog doesn't list the model (fatal). `probe`: a
    tiny call failed; fatal where the credentials are refused. `vision`: given
    `details`, the model can't see, for runs with images. `parameter`: given
    `matrix`, the provider doesn't read it.
    """
    spark = models.sparkSession
    judge = spark.createDataFrame([(judge_provider, judge_model)], "provider string, model string")
    requested = models.select("provider", "model").unionByName(judge).distinct()

    def finding(check: str, df: DataFrame, name: str, message, fatal) -> DataFrame:
        return df.select(F.lit(check).alias("check"), "provider", F.col(name).alias("name"), message.alias("message"), fatal.alias("fatal"))

    nothing, yes, no = F.lit(None).cast("string"), F.lit(True), F.lit(False)
    found = finding("missing", checks.missing_models(requested, catalog), "model", nothing, yes)
    failed = infer(probes(requested, judge_model, judge_provider), client_factory, **options).where("error IS NOT NULL")
    probed = classify_errors(failed, "error")
    found = found.unionByName(finding("probe", probed, "model", F.col("error"), F.col("fatal")))
    if details is not None:
        blind = checks.not_vision_capable(models, details)
        found = found.unionByName(finding("vision", blind, "model", nothing, no))
    if matrix is not None:
        unread = checks.unsupported_params(matrix, supported_params(spark))
        found = found.unionByName(finding("parameter", unread, "param", nothing, no))
    return found


def live_preflight(
    models: DataFrame,
    lister_factory,
    client_factory,
    vision: bool = False,
    matrix: DataFrame | None = None,
    judge_model: str = fixed.JUDGE_MODEL,
    judge_provider: str = fixed.DEFAULT_PROVIDER,
    **options,
) -> DataFrame:
    """`preflight` with catalogs that the providers list themselves, each once.

    A provider whose listing fails is a finding of its own (`listing`, fatal,
    with the error), and its models are not reported as missing. With `vision`
    models that can't see are found for providers that tell what theirs can do.
    """
    spark = models.sparkSession
    judge = spark.createDataFrame([(judge_provider, judge_model)], "provider string, model string")
    requested = models.select("provider", "model").unionByName(judge).distinct()
    path = scratch_path(spark, "catalogs")
    limits = {k: v for k, v in options.items() if k in ("max_retries", "max_backoff_s") and not isinstance(v, dict)}
    list_catalogs(requested, lister_factory, **limits).write.parquet(path)
    pages = spark.read.parquet(path)
    failed = pages.where("error IS NOT NULL").select("provider", "error")
    listed = pages.where("raw IS NOT NULL")
    # What is not listed for lack of a list counts as listed.
    unknown = requested.join(failed.select("provider").distinct(), "provider", "left_semi").select("provider", "model")
    catalog = checks.catalog_ids(listed).unionByName(unknown)
    details = checks.catalog_details(listed) if vision else None
    found = preflight(models, catalog, client_factory, details, matrix, judge_model, judge_provider, **options)
    return found.unionByName(
        failed.select(
            F.lit("listing").alias("check"), "provider", F.lit(None).cast("string").alias("name"),
            F.col("error").alias("message"), F.lit(True).alias("fatal"),
        )
    )

"""Rows that a run leaves in the trace store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom import fixed, schemas


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def build_observations(results: DataFrame) -> DataFrame:
    """A root row and a generation row per result, in one pass.

    Needs observation_id, session_id, trace_name, model, provider, input,
    criteria, output, error, judge_failed, truncated and the token counts. The
    root has the level: ERROR for a failed model call, WARNING for a failed
    judge call or a truncated response, else null. Tags, metadata, start and
    elapsed time and cost go along where the results have them.
    """
    failed = F.col("error").isNotNull()
    output = F.when(failed, _json(error=F.col("error"))).otherwise(_json(content=F.col("output")))
    warning = F.coalesce(F.col("judge_failed"), F.lit(False)) | F.coalesce(F.col("truncated"), F.lit(False))
    level = F.when(failed, "ERROR").when(warning, "WARNING")
    root_id = F.concat(F.col("observation_id").cast("string"), F.lit("-root"))

    def row(kind: str, **columns: Column) -> Column:
        layout = {
            "id": "string", "parent_id": "string", "name": "string", "type": "string", "model": "string",
            "input": "string", "output": "string", "level": "string",
            "tokens_in": "long", "tokens_out": "long", "tokens_total": "long",
            "start_time": "timestamp", "latency": "double", "total_cost": "double",
        }
        values = {"type": F.lit(kind), "output": output, **timing(results), **columns}
        return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in layout.items()])

    def tokens(name: str) -> Column:
        return F.when(~failed, F.coalesce(F.col(name), F.lit(0)))

    root = row(
        "SPAN",
        id=root_id,
        name=F.col("trace_name"),
        input=_json(prompt=F.col("input"), criteria=F.col("criteria")),
        level=level,
    )
    generation = row(
        "GENERATION",
        id=F.col("observation_id"),
        parent_id=root_id,
        name=F.concat(F.col("provider"), F.lit("-completion")),
        model=F.col("model"),
        input=F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("input").alias("content")))),
        tokens_in=tokens("tokens_in"),
        tokens_out=tokens("tokens_out"),
        tokens_total=tokens("tokens_total"),
    )
    shared = ["session_id", "trace_name", *[c for c in ("tags", "metadata") if c in results.columns]]
    return results.select(*shared, F.explode(F.array(root, generation)).alias("_o")).select(*shared, "_o.*")


def timing(results: DataFrame) -> dict[str, Column]:
    """Start, seconds taken and cost of each result, null where it isn't known."""

    def known(name: str) -> Column:
        return F.col(name) if name in results.columns else F.lit(None)

    return {
        "start_time": F.timestamp_millis(known("started_ms").cast("long")),
        "latency": known("elapsed_ms").cast("double") / 1000,
        "total_cost": known("total_cost").cast("double"),
    }


def generations_of(results: DataFrame) -> DataFrame:
    """The results in the layout of stored generations (`schemas.GENERATIONS`)."""
    made = {
        **timing(results),
        "tags": F.col("tags") if "tags" in results.columns else F.lit(None).cast("array<string>"),
        "output": F.coalesce("output", "error"),
    }
    layout = T.StructType.fromDDL(schemas.GENERATIONS)
    return results.select(*[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in layout])


def sessions_of(results: DataFrame, environment: str, created_at: Column | None = None) -> DataFrame:
    """One row per session in the layout of stored sessions; created when its first call began."""
    began = F.min(F.timestamp_millis(F.col("started_ms"))) if created_at is None else F.min(created_at)
    return results.groupBy("session_id").agg(began.alias("created_at")).withColumn("environment", F.lit(environment))


def sink_traffic_summary(requests: DataFrame) -> DataFrame:
    """Requests and bytes per kind of endpoint; an unknown path is its own kind."""
    kind = reduce(
        lambda otherwise, known: F.when(F.contains(F.col("path"), F.lit(known[0])), known[1]).otherwise(otherwise),
        reversed(fixed.TRAFFIC_KINDS),
        F.col("path"),
    )
    return requests.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("requests"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes")
    )

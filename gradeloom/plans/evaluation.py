"""A whole evaluation: matrix, responses, verdicts, observations, scores."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom import schemas as layouts
from gradeloom.functions.text import not_empty
from gradeloom.operators.inference import infer_to, replay_responses
from gradeloom.operators.judging import judge
from gradeloom.operators.matrix import effective_params, eval_matrix, filter_enabled
from gradeloom.operators.observations import build_observations, generations_of
from gradeloom.operators.requests import build_messages, build_provider_requests, to_response_format, trace_identity
from gradeloom.operators.responses import normalize_responses
from gradeloom.operators.rollup import write_rollup
from gradeloom.operators.scoring import (
    found_schema_score,
    judge_score,
    schema_score,
    score_rows,
    truncation_score,
    with_item_schema,
)
from gradeloom.operators.sinks import write_generations, write_scores, write_sessions
from gradeloom.sources import commits


@dataclass
class Evaluation:
    """Lazy tables of one run."""

    results: DataFrame
    scores: DataFrame
    observations: DataFrame


def media_table(items: DataFrame) -> DataFrame:
    """(media_id, image) of the items' images, each once; `plan_requests` carries the id alone."""
    image = not_empty(F.col("image"))
    return items.where(image.isNotNull()).select(F.sha2("image", 256).alias("media_id"), "image").dropDuplicates(["media_id"])


def plan_requests(
    models: DataFrame, items: DataFrame, session_id: str, enabled=None, endpoint: str | None = None
) -> DataFrame:
    """One row per model and item: input, effective parameters, trace attributes.

    Models and items need their index columns (see `eval_matrix`). An item's
    image becomes a media id, so that its bytes don't meet the models. An item's
    schema asks the model for output of that form, unless the item says
    otherwise. Items with an error stay, with it, and are never sent.
    """
    lean = items.withColumn("media_id", F.sha2(not_empty(F.col("image")), 256)).drop("image")
    if "score_schema" in items.columns:
        wanted = F.coalesce("response_format", to_response_format(F.col("score_schema")))
        lean = lean.withColumn("response_format", wanted)
    matrix = effective_params(eval_matrix(filter_enabled(models, enabled), lean))
    matrix = matrix.withColumns(
        {
            "session_id": F.lit(session_id),
            "observation_id": F.concat_ws("/", F.lit(session_id), "provider", "model", "item_id"),
            "image": F.col("media_id"),
        }
    )
    named = trace_identity(matrix, None if endpoint is None else F.lit(endpoint))
    return named.drop("params", "options", "image", "model_index", "item_index")


def with_messages(requests: DataFrame, media: DataFrame | None) -> DataFrame:
    """Adds the messages, and with them the bytes of images, just before the calls."""
    if media is None:
        pictured = requests.withColumn("_image", F.lit(None).cast("string"))
    else:
        pictured = requests.join(media.select("media_id", F.col("image").alias("_image")), "media_id", "left")
    return pictured.withColumn("messages", build_messages(F.col("input"), F.col("_image"))).drop("_image")


def evaluate(
    requests: DataFrame,
    recorded: DataFrame | None = None,
    client_factory=None,
    responses_path: str | None = None,
    judge_recorded: DataFrame | None = None,
    judge_client_factory=None,
    results_path: str | None = None,
    schemas: dict[str, dict] | None = None,
    media: DataFrame | None = None,
    judge_options: dict | None = None,
    **options,
) -> Evaluation:
    """Fills the requests and scores the answers.

    Live calls need a path: replies are written there first, so that scoring
    never repeats a call and an interrupted run goes on where it stopped. The
    verdicts of live judges are kept in the same way, beside `results_path`,
    which also serves replays whose results are read more than once.

    `options` are the limits of `infer_to`; the judge's calls are under the same
    ones unless `judge_options` says otherwise, which also names the judge's
    model, provider, token budget and whether it thinks. Rows whose item has a
    `score_schema` are scored by it; `schemas` are further ones by `schema_id`.
    """
    if client_factory is not None:
        if responses_path is None:
            raise ValueError("live calls need responses_path")
        bodies = build_provider_requests(with_messages(requests, media)).drop("messages", "effective")
        replies = infer_to(bodies, responses_path, client_factory, **options)
    else:
        replies = replay_responses(requests.drop("effective"), recorded)
    answered = normalize_responses(replies).withColumnRenamed("content", "output").drop("request", "raw")
    for name in ("started_ms", "elapsed_ms"):
        if name not in answered.columns:
            answered = answered.withColumn(name, F.lit(None).cast("long"))
    if judge_client_factory is not None and results_path is None:
        raise ValueError("live judge calls need results_path")
    asked = dict(judge_options or {})
    if judge_client_factory is not None:
        asked = {**options, "path": f"{results_path.rstrip('/')}-verdicts", **asked}
    judged = judge(answered, judge_client_factory, judge_recorded, **asked)
    judged = with_schema_results(judged, schemas)
    if results_path is not None:
        judged.write.mode("overwrite").parquet(results_path)
        judged = judged.sparkSession.read.parquet(results_path)
    scores = score_rows(judged, [judge_score(), found_schema_score(), truncation_score()], ("session_id", "observation_id"))
    return Evaluation(results=judged, scores=scores, observations=build_observations(judged))


def with_schema_results(results: DataFrame, schemas: dict[str, dict] | None) -> DataFrame:
    """Adds schema_value and schema_comment: by the item's own schema, else by the one its `schema_id` names."""
    found = results
    if "score_schema" in results.columns:
        found = with_item_schema(results)
    else:
        found = results.withColumns({"schema_value": F.lit(None).cast("int"), "schema_comment": F.lit(None).cast("string")})
    if schemas and "schema_id" in results.columns:
        named = F.when(F.col("error").isNull(), schema_score(schemas=schemas)(results))
        found = found.withColumn("_named", named).withColumns(
            {
                "schema_value": F.coalesce("schema_value", F.col("_named.value_num").cast("int")),
                "schema_comment": F.coalesce("schema_comment", "_named.comment"),
            }
        ).drop("_named")
    return found


def store(made: Evaluation, base: str, environment: str, attempt: str | None = None, rollup: bool = False) -> None:
    """Writes a run to the store that the report reads: generations, scores, sessions.

    Each table is a commit, and the sessions come last, so that a session is
    seen when all of it is. Stored again, a run replaces what its sessions had.
    With a rollup the totals are kept that `rolled_report` reads.
    """
    attempt, spark = attempt or uuid.uuid4().hex, made.results.sparkSession
    write_generations(generations_of(made.results), f"{base}/generations", attempt)
    # Every result is a generation, so the sessions can be read from what was just written.
    written = commits.of_attempt(spark, f"{base}/generations", layouts.GENERATIONS, attempt)
    sessions = written.groupBy("session_id").agg(F.min("start_time").alias("created_at"))
    write_scores(made.scores, f"{base}/scores", attempt, sessions)
    if rollup:
        scores = commits.of_attempt(spark, f"{base}/scores", f"{layouts.SCORES}, session_id string", attempt)
        write_rollup(written, scores, f"{base}/rollup", attempt, sessions)
    write_sessions(sessions.withColumn("environment", F.lit(environment)), f"{base}/sessions", attempt)

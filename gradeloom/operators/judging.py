"""Judge prompts, judge calls and verdict parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.functions.identity import is_finite
from gradeloom.functions.json_text import strict_json
from gradeloom.functions.text import let, trim_all
from gradeloom.operators.inference import infer, infer_to, replay_responses
from gradeloom.operators.requests import build_messages, build_provider_requests
from gradeloom.operators.responses import normalize_responses


def judge_prompt(input: Column, output: Column, criteria: Column) -> Column:
    return F.concat(
        F.lit(fixed.JUDGE_PROMPT_BEFORE_INPUT),
        F.coalesce(input, F.lit("")),
        F.lit(fixed.JUDGE_PROMPT_BEFORE_OUTPUT),
        F.coalesce(output, F.lit("")),
        F.lit(fixed.JUDGE_PROMPT_BEFORE_CRITERIA),
        F.coalesce(criteria, F.lit("")),
        F.lit(fixed.JUDGE_PROMPT_AFTER_CRITERIA),
    )


def build_judge_prompts(df: DataFrame) -> DataFrame:
    """Adds `judge_prompt` from input, output and criteria."""
    return df.withColumn("judge_prompt", judge_prompt(F.col("input"), F.col("output"), F.col("criteria")))


def build_judge_requests(
    df: DataFrame, model: str, provider: str = fixed.DEFAULT_PROVIDER, max_tokens: int = fixed.JUDGE_MAX_TOKENS,
    think: bool = False,
) -> DataFrame:
    """Adds `request`: the judge call of each row, for the judge's provider."""
    effective = {"temperature": fixed.JUDGE_TEMPERATURE, "max_completion_tokens": str(max_tokens)}
    effective = {**fixed.CLIENT_DEFAULTS.get(provider, {}), **effective}
    if "think" in fixed.SUPPORTED_PARAMS[provider]:
        effective["think"] = str(think).lower()
    shaped = build_judge_prompts(df).select(
        F.struct(*df.columns).alias("_row"),
        F.lit(model).alias("model"),
        F.lit(provider).alias("provider"),
        build_messages(F.col("judge_prompt"), F.lit(None).cast("string")).alias("messages"),
        F.create_map(*[F.lit(x) for pair in effective.items() for x in pair]).alias("effective"),
    )
    return build_provider_requests(shaped).select("_row.*", "request")


# A plain decimal number; leaves out the words a cast to double would also take.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def _score_value(field: Column) -> Column:
    """A score field that is a finite number or a numeric string, else null."""
    kind = F.schema_of_variant(field)
    text = trim_all(F.try_variant_get(field, "$", "string"))
    value = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(field, "$", "double")).when(
        (kind == "STRING") & text.rlike(_NUMBER), text.try_cast("double")
    )
    return let(value, lambda v: F.when(is_finite(v), v))


def _read_verdict(verdict: Column) -> Column:
    """(readable, score, reasoning) of a parsed verdict."""
    return F.struct(
        verdict.isNotNull().alias("readable"),
        let(F.try_variant_get(verdict, "$.score", "variant"), _score_value).alias("score"),
        F.try_variant_get(verdict, "$.reasoning", "string").alias("reasoning"),
    )


def parse_verdicts(
    df: DataFrame, content: str = "content", truncated: str = "truncated", max_tokens: int = fixed.JUDGE_MAX_TOKENS
) -> DataFrame:
    """Adds score and reasoning read from judge text.

    A cut-off verdict and an unreadable one have a null score and different
    reasons. The range of the score is not checked.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    bare = trim_all(text)
    for fence in (r"(?i)^```json\s*", r"^```\s*", r"```\s*\z"):
        bare = F.regexp_replace(bare, fence, "")
    verdict = F.col("_verdict")
    cut = F.coalesce(F.col(truncated), F.lit(False))
    problem = F.when(~verdict["readable"], fixed.JUDGE_NOT_JSON).otherwise(fixed.JUDGE_NO_SCORE)
    too_long = str(max_tokens).join(fixed.JUDGE_CUT_OFF)
    return (
        df.withColumn("_verdict", let(strict_json(bare), _read_verdict))
        .withColumns(
            {
                "score": F.when(~cut, verdict["score"]),
                "reasoning": F.when(cut, F.concat(F.lit(too_long), text))
                .when(
                    verdict["score"].isNull(),
                    F.concat(F.lit(fixed.JUDGE_UNREADABLE[0]), problem, F.lit(fixed.JUDGE_UNREADABLE[1]), text),
                )
                .otherwise(F.coalesce(verdict["reasoning"], F.lit(""))),
            }
        )
        .drop("_verdict")
    )


def judge(
    df: DataFrame,
    client_factory=None,
    recorded: DataFrame | None = None,
    model: str = fixed.JUDGE_MODEL,
    provider: str = fixed.DEFAULT_PROVIDER,
    max_tokens: int = fixed.JUDGE_MAX_TOKENS,
    think: bool = False,
    path: str | None = None,
    **options,
) -> DataFrame:
    """Adds score, reasoning and judge_failed to every row with an output.

    Judge replies come from `client_factory` (see `infer`) or from `recorded`.
    With a path, replies are stored there and a later call asks only for what
    it lacks (see `infer_to`). A failed judge call leaves the row unscored.
    Rows that carry an error are not judged and keep null verdict columns.
    """
    # The row travels as one column, so its own raw/error/timing columns stay apart
    # from those of the judge call.
    row = F.struct(*df.columns).alias("_row")
    answered = F.col("_row.error").isNull() if "error" in df.columns else F.lit(True)
    session = ["session_id"] if "session_id" in df.columns else []
    if client_factory is not None:
        # The call goes to the judge: its model and provider, under that provider's limits.
        asked = build_judge_requests(df, model, provider, max_tokens, think).select(
            *session,
            F.lit(model).alias("model"),
            F.lit(provider).alias("provider"),
            F.concat_ws("/", "provider", "model", "item_id").alias("item_id"),
            "request",
            row,
        )
        asked = asked.withColumn("request", F.when(answered, F.col("request")))
        if path is None:
            replies = infer(asked, client_factory, **options)
        else:
            calls = infer_to(asked.where("request IS NOT NULL").drop("_row"), path, client_factory, **options)
            replies = asked.drop("request", "model", "provider").join(
                calls.drop("model"), [*session, "item_id"], "left"
            )
            replies = replies.withColumn("provider", F.lit(provider))
    else:
        packed = df.select(*session, "model", "provider", "item_id", row)
        replies = replay_responses(packed, recorded).withColumn("provider", F.lit(provider))
    read = normalize_responses(replies)
    failed = F.col("error").isNotNull()
    return parse_verdicts(read, "content", "truncated", max_tokens).select(
        "_row.*",
        F.when(answered & ~failed, F.col("score")).alias("score"),
        F.when(
            answered,
            F.when(failed, F.concat(F.lit(fixed.JUDGE_CALL_FAILED), F.col("error"))).otherwise(F.col("reasoning")),
        ).alias("reasoning"),
        F.when(answered, failed).alias("judge_failed"),
    )

"""Scorers: responses to one long table of score rows.

A scorer gives one column per response: a struct in the layout of a score row,
or null where it has nothing to say. All scorers of a run are evaluated in one
pass over the responses and exploded together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.functions import json_schema
from gradeloom.functions.json_check import check_json
from gradeloom.functions.identity import is_finite
from gradeloom.functions.json_text import extract_json_loose, loose_parse_error
from gradeloom.functions.text import let

Scorer = Callable[[DataFrame], "Column | DataFrame"]
_REGISTRY: dict[str, Scorer] = {}


def numeric_score(name: str, value: Column, comment: Column) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        value.cast("double").alias("value_num"),
        F.lit(None).cast("string").alias("value_str"),
        F.lit(fixed.NUMERIC).alias("data_type"),
        comment.cast("string").alias("comment"),
    )


def categorical_score(name: str, value: Column, comment: Column) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(None).cast("double").alias("value_num"),
        value.cast("string").alias("value_str"),
        F.lit(fixed.CATEGORICAL).alias("data_type"),
        comment.cast("string").alias("comment"),
    )


def judge_score(score: str = "score", reasoning: str = "reasoning") -> Scorer:
    """A finite score is numeric; anything else is an error row, never a 0."""
    return lambda df: F.when(
        is_finite(F.col(score)), numeric_score(fixed.JUDGE_SCORE, F.col(score), F.col(reasoning))
    ).otherwise(categorical_score(fixed.JUDGE_ERROR, F.lit(fixed.UNSCORED), F.col(reasoning)))


def truncation_score(truncated: str = "truncated", done_reason: str = "done_reason") -> Scorer:
    """1 or 0 where the provider reports it; no row where it does not."""

    def score(df: DataFrame) -> Column:
        cut = F.col(truncated)
        reason = F.coalesce(F.col(done_reason), F.when(cut, "length").otherwise("stop"))
        comment = F.when(
            cut, F.concat(F.lit(fixed.CUT_OFF[0]), reason, F.lit(fixed.CUT_OFF[1]))
        ).otherwise(F.concat(F.lit(fixed.FINISHED[0]), reason, F.lit(fixed.FINISHED[1])))
        return F.when(cut.isNotNull(), numeric_score(fixed.TRUNCATION_SCORE, cut.cast("int"), comment))

    return score


def conformance(output: Column, schema: dict) -> Column:
    """Struct (parsed, marks) of a response text against one schema."""
    return let(
        extract_json_loose(output),
        lambda value: F.struct(
            value.isNotNull().alias("parsed"), json_schema.conformance_marks(value, schema).alias("marks")
        ),
    )


def _comment(output: Column, parsed: Column, errors: Column, passed: Column, checked: Column) -> Column:
    ratio = F.concat_ws("/", passed.cast("string"), checked.cast("string"))
    unreadable = F.concat(
        F.lit(fixed.UNPARSEABLE[0]),
        loose_parse_error(output),
        F.lit(fixed.UNPARSEABLE[1]),
        F.left(F.coalesce(output, F.lit("")), F.lit(200)),
    )
    conforms = F.concat(F.lit(fixed.CONFORMS[0]), ratio, F.lit(fixed.CONFORMS[1]))
    violates = F.concat(
        F.lit(fixed.VIOLATES[0]),
        F.size(errors).cast("string"),
        F.lit(fixed.VIOLATES[1]),
        ratio,
        F.lit(fixed.VIOLATES[2]),
        F.array_join(errors, "; "),
    )
    return F.when(~parsed, unreadable).when(F.size(errors) == 0, conforms).otherwise(violates)


def with_item_schema(df: DataFrame, schema: str = "score_schema", output: str = "output") -> DataFrame:
    """Adds schema_value and schema_comment of each output against its own row's schema.

    Null where the row has no readable schema, or carries an error. Keywords that
    are malformed constrain nothing. However many schemas there are, the plan
    stays the same.
    """
    asked = F.col(schema).isNotNull() & F.try_parse_json(F.col(schema)).isNotNull()
    if "error" in df.columns:
        asked = asked & F.col("error").isNull()
    value = F.when(asked, F.to_json(extract_json_loose(F.col(output))))
    found = df.withColumn("_value", value).withColumn("_found", check_json("_value", schema))
    errors, parsed = F.col("_found.errors"), F.col("_value").isNotNull()
    fits = parsed & (F.size(errors) == 0)
    # A schema or an answer may be too deeply nested to be read: then there is nothing to score by.
    asked = asked & (~parsed | errors.isNotNull())
    comment = _comment(F.col(output), parsed, errors, F.col("_found.passed"), F.col("_found.checked"))
    return found.withColumns(
        {
            "schema_value": F.when(asked, F.when(fits, 1).otherwise(0)),
            "schema_comment": F.when(asked, comment),
        }
    ).drop("_value", "_found")


def found_schema_score(value: str = "schema_value", comment: str = "schema_comment") -> Scorer:
    """The score row of columns that `with_item_schema` or a dict of schemas has filled."""
    return lambda df: F.when(F.col(value).isNotNull(), numeric_score(fixed.SCHEMA_SCORE, F.col(value), F.col(comment)))


def _judged(result: Column) -> Column:
    """Struct (parsed, errors, passed, checked) of a `conformance`; bound once, as score and comment name them often."""
    return F.struct(
        result["parsed"].alias("parsed"),
        json_schema.marks_errors(result["marks"]).alias("errors"),
        json_schema.marks_passed(result["marks"]).alias("passed"),
        json_schema.marks_checked(result["marks"]).alias("checked"),
    )


def schema_score(schema: dict | None = None, schemas: dict[str, dict] | None = None,
                 output: str = "output", schema_id: str = "schema_id") -> Scorer:
    """1 iff the response parses and conforms, else 0, with the cause.

    Either one schema for all rows, or a dict from schema id to schema; rows
    whose id is unknown or null get no score.
    """

    def one(body: dict) -> Column:
        def score(r: Column) -> Column:
            value = F.when(r["parsed"] & (F.size(r["errors"]) == 0), 1).otherwise(0)
            comment = _comment(F.col(output), r["parsed"], r["errors"], r["passed"], r["checked"])
            return numeric_score(fixed.SCHEMA_SCORE, value, comment)

        return let(let(conformance(F.col(output), body), _judged), score)

    def score(df: DataFrame) -> Column:
        if schema is not None:
            return one(schema)
        result = None
        for key, body in (schemas or {}).items():
            is_key = F.col(schema_id) == key
            result = F.when(is_key, one(body)) if result is None else result.when(is_key, one(body))
        if result is None:
            raise ValueError("no schema given")
        return result

    return score


def score_exact(output: str = "output", expected: str = "expected", name: str = "exact-match") -> Scorer:
    """1 where the response equals the expected text; no row without an expected text."""
    return lambda df: F.when(
        F.col(expected).isNotNull(),
        numeric_score(
            name,
            F.coalesce(F.col(output) == F.col(expected), F.lit(False)).cast("int"),
            F.when(F.col(output) == F.col(expected), "equal").otherwise("different"),
        ),
    )


def score_regex(pattern: str, output: str = "output", name: str = "regex-match") -> Scorer:
    """1 where the pattern is found in the response."""
    return lambda df: numeric_score(
        name, F.coalesce(F.col(output).rlike(pattern), F.lit(False)).cast("int"), F.lit(f"pattern: {pattern}")
    )


def register_scorer(name: str, scorer: Scorer) -> None:
    """Makes a scorer available to `all_scores` by name.

    It takes the responses and returns a struct column (see `numeric_score`) or,
    if it needs joins or aggregates, a DataFrame of score rows.
    """
    _REGISTRY[name] = scorer


def score_rows(results: DataFrame, scorers: list[Scorer | str], keys: tuple[str, ...] = ("observation_id",)) -> DataFrame:
    """Score rows of all scorers; rows that carry an error are not scored."""
    scored = results.where(F.col("error").isNull()) if "error" in results.columns else results
    columns, tables = [], []
    for scorer in scorers:
        made = (_REGISTRY[scorer] if isinstance(scorer, str) else scorer)(scored)
        (columns if isinstance(made, Column) else tables).append(made)
    layout = ["name", "value_num", "value_str", "data_type", "comment"]
    parts = list(tables)
    if columns:
        exploded = scored.select(*keys, F.explode(F.array_compact(F.array(*columns))).alias("_score"))
        parts.insert(0, exploded.select(*keys, *[F.col(f"_score.{c}").alias(c) for c in layout]))
    rows = parts[0].select(*keys, *layout)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*keys, *layout))
    return rows


def build_judge_scores(results: DataFrame) -> DataFrame:
    return score_rows(results, [judge_score()])


def truncation_scores(results: DataFrame) -> DataFrame:
    return score_rows(results, [truncation_score()])


def score_json_schema(results: DataFrame, schema: dict | None = None, schemas: dict[str, dict] | None = None) -> DataFrame:
    return score_rows(results, [schema_score(schema, schemas)])


def all_scores(results: DataFrame, schema: dict | None = None, schemas: dict[str, dict] | None = None,
               extra: list[Scorer | str] | None = None, keys: tuple[str, ...] = ("observation_id",)) -> DataFrame:
    """Judge, schema, truncation and any further scores as one long table."""
    scorers: list[Scorer | str] = [judge_score()]
    if schema is not None or schemas:
        scorers.append(schema_score(schema, schemas))
    scorers.append(truncation_score())
    return score_rows(results, [*scorers, *(extra or [])], keys)


def validate_json(df: DataFrame, value: str, schema: dict) -> DataFrame:
    """Adds valid, checked, passed and errors of a VARIANT column; null for a null value."""
    marks = F.col("_marks")
    return (
        df.withColumn("_marks", json_schema.conformance_marks(F.col(value), schema))
        .withColumns(
            {
                "checked": json_schema.marks_checked(marks),
                "passed": json_schema.marks_passed(marks),
                "errors": json_schema.marks_errors(marks),
            }
        )
        .withColumn("valid", F.when(marks.isNotNull(), F.size("errors") == 0))
        .drop("_marks")
    )


def schema_violations(df: DataFrame, schema: dict, output: str = "output", keys: tuple[str, ...] = ("observation_id",)) -> DataFrame:
    """One row per violated constraint: path and problem. Unreadable outputs have none."""
    result = conformance(F.col(output), schema)
    problems = F.filter(result["marks"], lambda m: m["problem"].isNotNull())
    return df.select(*keys, F.explode(problems).alias("_m")).select(
        *keys, F.col("_m.path").alias("path"), F.col("_m.problem").alias("problem")
    )

"""JSON reading and schema conformance."""

import json

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from gradeloom.functions import json_text
from gradeloom.operators import scoring

LINE = {
    "type": "object",
    "properties": {"sku": {"type": "string"}, "qty": {"type": "integer"}},
    "required": ["sku"],
}
SCHEMA = {
    "type": "object",
    "required": ["paid", "lines"],
    "properties": {
        "lines": {"type": "array", "items": LINE},
        "paid": {"type": "boolean"},
        "total": {"type": "number"},
        "channel": {"enum": ["web", "shop"]},
    },
}
BASE = {"paid": True, "lines": [{"sku": "k1", "qty": 2}]}


@pytest.mark.parametrize(
    "text,expected",
    [
        ('{"a":1}', '{"a":1}'),
        ('{"a":1} x', None),
        ("1,2", None),
        ("1] x", None),
        ("1} x", None),
        ('1],[2', None),
        ('{"a":[1]}] }', None),
        ("", None),
        ('{"a":1,"a":2}', '{"a":2}'),
        ("{'a':1}", None),
        ("null", "null"),
        ('"s"', '"s"'),
        (" 5 \n", "5"),
        ("-0.5", "-0.5"),
        ("true", "true"),
        ("tru", None),
        ("01", None),
        ("NaN", None),
        ("10m", None),
        ('["a",["b"]]', '["a",["b"]]'),
    ],
)
def test_strict_json(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(F.to_json(json_text.strict_json(F.col("t"))).alias("j")))["j"] == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ('{"a":1}', '{"a":1}'),
        ('```json\n{"a":1}\n```', '{"a":1}'),
        ('```JSON {"a":1}```', '{"a":1}'),
        ('```\n{"a":1}\n```', '{"a":1}'),
        ('Here you go: {"a":1} hope that helps', '{"a":1}'),
        ("list: [1,2] done", "[1,2]"),
        ("[1,2]", "[1,2]"),
        (' ﻿{"a":1} ', '{"a":1}'),
        ('```\nnot json\n``` but {"b":2}.', '{"b":2}'),
        ('a {"x": 1} and } more', None),
        ("not json at all", None),
        ("", None),
        ("   ", None),
        (None, None),
    ],
)
def test_extract_json_loose(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(F.to_json(json_text.extract_json_loose(F.col("t"))).alias("j")))["j"] == expected


def validate(spark, value, schema):
    df = spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "t string")
    parsed = df.withColumn("v", json_text.strict_json(F.col("t")))
    return one(scoring.validate_json(parsed, "v", schema).select("valid", "checked", "passed", "errors"))


def test_conforming_value(spark):
    good = {"paid": False, "lines": [{"sku": "k1"}, {"sku": "k2", "qty": 3}], "total": 9.5, "channel": "shop"}
    result = validate(spark, good, SCHEMA)
    assert result["valid"] and result["checked"] == result["passed"] and not result["errors"]


def test_missing_fields(spark):
    result = validate(spark, {"total": 1, "note": "free"}, SCHEMA)
    assert result["errors"] == ["$.paid: required property is missing", "$.lines: required property is missing"]
    assert (result["checked"], result["passed"]) == (4, 2)


@pytest.mark.parametrize(
    "change,error",
    [
        ({"paid": "yes"}, "$.paid: expected boolean, got string"),
        ({"paid": None}, "$.paid: expected boolean, got null"),
        ({"lines": "k1"}, "$.lines: expected array, got string"),
        ({"lines": {"sku": "k1"}}, "$.lines: expected array, got object"),
        ({"lines": [{"sku": "k1"}, 7]}, "$.lines[1]: expected object, got number"),
        ({"lines": [{"sku": "k1"}, {"qty": 1}]}, "$.lines[1].sku: required property is missing"),
        ({"lines": [{"sku": "k1", "qty": 1.5}]}, "$.lines[0].qty: expected integer, got number"),
        ({"lines": [{"sku": []}]}, "$.lines[0].sku: expected string, got array"),
        ({"total": "9"}, "$.total: expected number, got string"),
        ({"channel": "fax"}, '$.channel: "fax" is not one of ["web","shop"]'),
    ],
)
def test_one_error_without_cascade(spark, change, error):
    assert validate(spark, {**BASE, **change}, SCHEMA)["errors"] == [error]


def test_unknown_keywords_and_types_pass(spark):
    assert validate(spark, {"a": "x"}, {"type": "object", "properties": {"a": {"type": "string", "pattern": "^y$"}}})["valid"]
    assert validate(spark, {"a": 1}, {"type": "object", "properties": {"a": {"type": "colour"}}})["valid"]
    assert validate(spark, "5", {})["valid"]


@pytest.mark.parametrize(
    "value,schema,valid",
    [
        ("1.0", {"type": "integer"}, True),
        ("1.5", {"type": "integer"}, False),
        ("12345678901234567890", {"type": "integer"}, True),
        ("1e400", {"type": "number"}, False),
        ("null", {"type": ["string", "null"]}, True),
        ("3", {"type": ["string", "null"]}, False),
        ('"a"', {"enum": ["a", 1, None]}, True),
        ("1.0", {"enum": ["a", 1, None]}, True),
        ("null", {"enum": ["a", 1, None]}, True),
        ("true", {"enum": [1]}, False),
        ("true", {"enum": [True]}, True),
        ('{"a":1}', {"properties": {"a": {"enum": []}}}, False),
        ('{"a":1}', {"properties": {"a": {"type": []}}}, False),
        ('{"b":1}', {"properties": {"a": {"type": []}}}, True),
        ('{"a":1}', {"enum": [{"a": 1}]}, False),
        ('"x"', {"required": ["a"]}, True),
        ('{"it\'s":1}', {"properties": {"it's": {"type": "string"}}}, False),
        ('{"a":{"b":[[1],["x"]]}}', {"properties": {"a": {"properties": {"b": {"items": {"items": {"type": "number"}}}}}}}, False),
    ],
)
def test_keyword_details(spark, value, schema, valid):
    assert validate(spark, value, schema)["valid"] is valid


def test_nested_array_path(spark):
    schema = {"properties": {"b": {"items": {"items": {"type": "number"}}}}}
    assert validate(spark, {"b": [[1], [2, "x"]]}, schema)["errors"] == ["$.b[1][1]: expected number, got string"]


def test_additional_properties_are_errors_but_not_checked(spark):
    schema = {"type": "object", "properties": {"a": {}}, "additionalProperties": False}
    result = validate(spark, {"a": 1, "b": 2}, schema)
    assert result == {"valid": False, "checked": 1, "passed": 1, "errors": ["$.b: unexpected property"]}


def test_type_list_error_text(spark):
    assert validate(spark, "3", {"type": ["string", "null"]})["errors"] == ["$: expected string|null, got number"]


def test_schema_scores(spark):
    texts = [
        (1, json.dumps(BASE)),
        (2, "```json\n" + json.dumps(BASE) + "\n```"),
        (3, "I'm afraid I can't do that"),
        (4, '{"paid":1,"lines":[{}]}'),
        (5, ""),
    ]
    df = spark.createDataFrame(texts, "observation_id long, output string")
    found = rows(scoring.score_json_schema(df, SCHEMA), "observation_id")
    assert [r["value_num"] for r in found] == [1, 1, 0, 0, 0]
    assert found[0]["comment"].startswith("Valid JSON matching the schema (")
    assert found[2]["comment"] == (
        "Not parseable as JSON: output is not parseable JSON. First 200 chars: I'm afraid I can't do that"
    )
    assert "does not match the schema (2 problem(s), 5/7 constraints passed)" in found[3]["comment"]
    assert found[4]["comment"] == "Not parseable as JSON: empty response. First 200 chars: "


def test_schema_by_id(spark):
    df = spark.createDataFrame(
        [(1, "{}", "obj"), (2, "{}", "arr"), (3, "{}", None), (4, "{}", "other")],
        "observation_id long, output string, schema_id string",
    )
    schemas = {"obj": {"type": "object"}, "arr": {"type": "array"}}
    found = rows(scoring.score_json_schema(df, schemas=schemas), "observation_id")
    assert [(r["observation_id"], r["value_num"]) for r in found] == [(1, 1), (2, 0)]


def test_violations(spark):
    df = spark.createDataFrame([(1, json.dumps({**BASE, "lines": [1, {"sku": "k"}, 2]})), (2, "no")], "observation_id long, output string")
    found = rows(scoring.schema_violations(df, SCHEMA), "path")
    assert [(r["observation_id"], r["path"], r["problem"]) for r in found] == [
        (1, "$.lines[0]", "expected object, got number"),
        (1, "$.lines[2]", "expected object, got number"),
    ]


def test_schema_fields(spark):
    df = spark.createDataFrame([(json.dumps(SCHEMA),), ('{"type":"array"}',), ("x",)], "s string")
    found = [r["f"] for r in rows(df.select(json_text.schema_fields(F.col("s")).alias("f")))]
    assert found == [["lines", "paid", "total", "channel"], None, None]


def test_schemas_as_data_agree_with_compiled_ones(spark):
    """Each row with its own schema gives what the schema gives as an expression."""
    outputs = [json.dumps(BASE), json.dumps({"lines": [{"sku": 1}, 2], "paid": True, "channel": "fax"}), "```json\n{}\n```", "[1, 2]", "no", "", None, "null"]
    schemas = [SCHEMA, {"type": []}, {"enum": []}, {"enum": [None, 1]}, {"type": ["array", "null"], "items": {"type": "integer"}},
               {"properties": {"paid": {}}, "additionalProperties": False}, {}]
    cases = [(i, o, json.dumps(s), str(k)) for i, (o, (k, s)) in enumerate((o, x) for o in outputs for x in enumerate(schemas))]
    df = spark.createDataFrame(cases, "observation_id int, output string, score_schema string, schema_id string")
    own = rows(scoring.with_item_schema(df), "observation_id")
    for k, schema in enumerate(schemas):
        compiled = rows(scoring.score_json_schema(df.where(F.col("schema_id") == str(k)), schema), "observation_id")
        mine = [r for r in own if r["schema_id"] == str(k)]
        assert [(r["value_num"], r["comment"]) for r in compiled] == [(r["schema_value"], r["schema_comment"]) for r in mine]
    none = df.limit(2).withColumn("score_schema", F.when(F.col("observation_id") == 0, "{not json"))
    assert [(r["schema_value"], r["schema_comment"]) for r in rows(scoring.with_item_schema(none))] == [(None, None)] * 2


def random_schema(rng, depth=0):
    keywords = {}
    if rng.random() < 0.6:
        names = ["object", "array", "string", "number", "integer", "boolean", "null", "odd"]
        keywords["type"] = rng.choice([*names, rng.sample(names, 2), "object", "array"])
    if rng.random() < 0.2:
        keywords["enum"] = rng.sample([None, True, 1, 1.5, "a", "b"], 3)
    if rng.random() < 0.4:
        keywords["required"] = rng.sample(["a", "b", "c"], 2)
    if rng.random() < 0.3:
        keywords["additionalProperties"] = rng.choice([False, False, True])
    if depth < 3 and rng.random() < 0.7:
        keywords["properties"] = {k: random_schema(rng, depth + 1) for k in rng.sample(["c", "b", "a"], rng.randrange(1, 4))}
    if depth < 3 and rng.random() < 0.4:
        keywords["items"] = random_schema(rng, depth + 1)
    return keywords


def random_value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 6)
    if kind == 6:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 7 or depth == 0:
        return {k: random_value(rng, depth + 1) for k in rng.sample(["a", "b", "c", "d"], rng.randrange(4))}
    return [None, True, 1, 1.5, "a", "x"][kind]


def test_random_schemas_as_data_agree_with_compiled_ones(spark):
    import random

    rng = random.Random(8)
    schemas = [random_schema(rng) for _ in range(12)]
    cases = [(i, json.dumps(random_value(rng)), json.dumps(schemas[i % 12]), i % 12) for i in range(600)]
    df = spark.createDataFrame(cases, "observation_id int, output string, score_schema string, k int")
    own = {r["observation_id"]: r for r in scoring.with_item_schema(df).collect()}
    failing = 0
    for k, schema in enumerate(schemas):
        for r in scoring.score_json_schema(df.where(F.col("k") == k), schema).collect():
            mine = own[r["observation_id"]]
            assert (r["value_num"], r["comment"]) == (mine["schema_value"], mine["schema_comment"]), (schema, mine)
            failing += r["value_num"] == 0
    assert 100 < failing < 590


def test_malformed_schemas_end_no_job(spark):
    """Keywords of the wrong form constrain nothing; what can't be read leaves the row unscored."""
    deep = '{"items":' * 3000 + "{}" + "}" * 3000
    cases = [
        ('{"type": [1]}', 1), ('{"type": {"x": 1}}', 1), ('{"properties": [1, 2]}', 1), ('{"required": 5}', 1), ('{"required": "ab"}', 1),
        ('{"required": [1, "a"]}', 1), ('{"required": [null, "z"]}', 0), ('{"enum": 3}', 1), ('{"items": [{"type": "null"}]}', 1),
        ('{"properties": {"a": 7}}', 1), ('{"additionalProperties": false, "properties": 3}', 0), ("[]", 1), ("5", 1), ("{", None), (deep, None),
    ]
    df = spark.createDataFrame([(i, '{"a": 1}', s) for i, (s, _) in enumerate(cases)], "observation_id int, output string, score_schema string")
    found = rows(scoring.with_item_schema(df), "observation_id")
    assert [r["schema_value"] for r in found] == [v for _, v in cases]
    assert all((r["schema_comment"] is None) == (r["schema_value"] is None) for r in found)
    scores = scoring.score_rows(scoring.with_item_schema(df), [scoring.found_schema_score()])
    assert scores.count() == sum(v is not None for _, v in cases)


def test_depth_is_no_limit_of_the_walk():
    from gradeloom.functions import json_check

    schema, value = {"type": "integer"}, "x"
    for _ in range(5000):
        schema, value = {"type": "array", "items": schema}, [value]
    checked, passed, errors = json_check.check(value, json_check.compiled(schema))
    assert (checked, passed) == (5001, 5000) and errors[0].startswith("$[0][0]") and errors[0].endswith("got string")

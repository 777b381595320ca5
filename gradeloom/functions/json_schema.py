"""JSON Schema conformance as one column expression.

The schema is compiled on the driver into built-in expressions over VARIANT.
Every constraint yields one entry `(counted, path, problem)`; problem is null
where the constraint holds. Supported: type, enum, required, properties, items,
additionalProperties=false. Other keywords are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.functions.text import let

MARKS = "array<struct<counted:boolean,path:string,problem:string>>"


def _no_marks() -> Column:
    return F.array().cast(MARKS)


def _mark(path: Column, problem: Column, counted: bool = True) -> Column:
    return F.struct(
        F.lit(counted).alias("counted"), path.alias("path"), problem.cast("string").alias("problem")
    )


class _Node:
    """A value inside the document: a root VARIANT and a path below it.

    Members are reached by longer paths from the same root, so that a nested
    object costs no intermediate values.
    """

    def __init__(self, root: Column, steps: str = "$"):
        self.root = root
        self.steps = steps

    def get(self, cast: str) -> Column:
        return F.try_variant_get(self.root, self.steps, cast)

    @property
    def value(self) -> Column:
        return self.root if self.steps == "$" else self.get("variant")

    def member(self, key: str) -> _Node:
        if "'" not in key:
            return _Node(self.root, f"{self.steps}['{key}']")
        if '"' not in key:
            return _Node(self.root, f'{self.steps}["{key}"]')
        return _Node(F.try_element_at(self.get("map<string,variant>"), F.lit(key)))


def _is_number(node: _Node) -> Column:
    numeric = F.schema_of_variant(node.value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return numeric & (F.abs(node.get("double")) < F.lit(float("inf")))


def _has_type(node: _Node, name: str) -> Column:
    if name == "object":
        # Cheapest cast that only an object survives: no field is read.
        return node.get("struct<>").isNotNull()
    if name == "array":
        return node.get("array<variant>").isNotNull()
    if name == "string":
        return F.schema_of_variant(node.value) == "STRING"
    if name == "number":
        return _is_number(node)
    if name == "integer":
        return _is_number(node) & (F.rint(node.get("double")) == node.get("double"))
    if name == "boolean":
        return F.schema_of_variant(node.value) == "BOOLEAN"
    if name == "null":
        return F.is_variant_null(node.value)
    return F.lit(True)


def _type_name(node: _Node) -> Column:
    kind = F.schema_of_variant(node.value)
    return (
        F.when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def _in_enum(node: _Node, allowed: list) -> Column:
    texts = [x for x in allowed if isinstance(x, str)]
    flags = [x for x in allowed if isinstance(x, bool)]
    numbers = [float(x) for x in allowed if isinstance(x, (int, float)) and not isinstance(x, bool)]
    hit = F.lit(False)
    if texts:
        hit = hit | (_has_type(node, "string") & node.get("string").isin(texts))
    if flags:
        hit = hit | (_has_type(node, "boolean") & node.get("boolean").isin(flags))
    if numbers:
        hit = hit | (_is_number(node) & node.get("double").isin(numbers))
    if None in allowed:
        hit = hit | F.is_variant_null(node.value)
    return F.coalesce(hit, F.lit(False))


def _object_marks(node: _Node, schema: dict, path: Column) -> Column:
    properties = schema.get("properties") or {}
    groups = []

    required = schema.get("required") or []
    if required:
        missing = F.lit(fixed.MISSING_PROPERTY)
        groups.append(
            F.array(
                *[
                    _mark(F.concat(path, F.lit(f".{key}")), F.when(node.member(key).value.isNull(), missing))
                    for key in required
                ]
            )
        )

    if schema.get("additionalProperties") is False:
        extra = F.map_keys(node.get("map<string,variant>"))
        if properties:
            extra = F.array_except(extra, F.array(*[F.lit(key) for key in properties]))
        groups.append(
            F.transform(
                extra,
                lambda key: _mark(F.concat(path, F.lit("."), key), F.lit(fixed.UNEXPECTED_PROPERTY), counted=False),
            )
        )

    for key, child in properties.items():
        if _constrains(child):
            member = node.member(key)
            inside = _marks(member, child, F.concat(path, F.lit(f".{key}")))
            groups.append(F.when(member.value.isNotNull(), inside).otherwise(_no_marks()))
    return F.concat(*groups) if groups else _no_marks()


def _constrains(schema) -> bool:
    if not isinstance(schema, dict):
        return False
    keywords = ("type", "enum", "required", "properties", "items")
    lists = isinstance(schema.get("enum"), list) or isinstance(schema.get("type"), list)
    return lists or any(schema.get(key) for key in keywords) or schema.get("additionalProperties") is False


def _item_marks(schema: dict, path: Column):
    def marks(element: Column, i: Column) -> Column:
        return _marks(_Node(element), schema, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))

    return marks


def _marks(node: _Node, schema: dict, path: Column) -> Column:
    groups = []
    declared = schema.get("type")
    types = declared if isinstance(declared, list) else [declared] if declared else []

    if isinstance(schema.get("enum"), list):
        allowed = schema["enum"]
        shown = json.dumps(allowed, separators=(",", ":"), ensure_ascii=False)
        problem = F.concat(F.to_json(node.value), F.lit(f"{fixed.NOT_IN_ENUM}{shown}"))
        groups.append(F.array(_mark(path, F.when(~_in_enum(node, allowed), problem))))

    if schema.get("required") or schema.get("properties") or schema.get("additionalProperties") is False:
        inside = _object_marks(node, schema, path)
        if types != ["object"]:
            inside = F.when(_has_type(node, "object"), inside).otherwise(_no_marks())
        groups.append(inside)

    if _constrains(schema.get("items")):
        elements = F.coalesce(node.get("array<variant>"), F.array().cast("array<variant>"))
        groups.append(F.flatten(F.transform(elements, _item_marks(schema["items"], path))))

    body = F.concat(*groups) if groups else None
    if not types and not isinstance(declared, list):
        return body if body is not None else _no_marks()

    matches = F.lit(False)
    for name in types:
        matches = matches | F.coalesce(_has_type(node, name), F.lit(False))
    passed = F.array(_mark(path, F.lit(None)))
    failed = F.array(_mark(path, F.concat(F.lit(f"{fixed.WRONG_TYPE[0]}{'|'.join(types)}{fixed.WRONG_TYPE[1]}"), _type_name(node))))
    return F.when(matches, F.concat(passed, body) if body is not None else passed).otherwise(failed)


def conformance_marks(value: Column, schema: dict) -> Column:
    """All constraint outcomes of a VARIANT against a schema; null for a null value.

    The value is bound once: the checks name it many times.
    """

    def marks(v: Column) -> Column:
        found = _marks(_Node(v), schema, F.lit("$")) if _constrains(schema) else _no_marks()
        return F.when(v.isNotNull(), found)

    return let(value, marks)


def marks_checked(marks: Column) -> Column:
    return F.size(F.filter(marks, lambda m: m["counted"]))


def marks_passed(marks: Column) -> Column:
    return F.size(F.filter(marks, lambda m: m["problem"].isNull()))


def marks_errors(marks: Column) -> Column:
    return F.transform(
        F.filter(marks, lambda m: m["problem"].isNotNull()),
        lambda m: F.concat(m["path"], F.lit(": "), m["problem"]),
    )

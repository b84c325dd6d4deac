"""Schema checks against a plain version, and what is refused."""

from __future__ import annotations

import json
import random
import re

import pytest

from meshloom.operators import schema_check

SCHEMA = {
    "$schema": "x", "title": "t", "type": "object", "required": ["id", "links"], "additionalProperties": False, "minProperties": 2,
    "patternProperties": {"^x-": {"type": ["string", "null"], "maxLength": 3}},
    "properties": {
        "id": {"type": "integer", "minimum": 0, "exclusiveMaximum": 50}, "state.x": {"enum": ["up", "down", 1, None]},
        "links": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"$ref": "#/$defs/link"}},
        "attrs": {"type": "object", "additionalProperties": {"type": "number", "multipleOf": 0.5}, "propertyNames": {"pattern": "^[a-c]$"}, "maxProperties": 2},
        "kind": {"oneOf": [{"type": "string", "pattern": "^k"}, {"type": "string", "minLength": 3}], "not": {"const": "kkk"}},
        "any": {"anyOf": [{"type": "boolean"}, {"type": "number", "exclusiveMinimum": 1, "maximum": 3}], "allOf": [{"not": {"const": 2}}]},
    },
    "$defs": {"link": {"type": "object", "required": ["to"], "properties": {"to": {"type": "string", "pattern": "^n[0-9]+$"}, "cost": {"type": "number", "minimum": 0}, "sub": {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}}}},
}


def kind(v):
    return {bool: "boolean", str: "string", int: "number", float: "number", list: "array", dict: "object", type(None): "null"}[type(v)]


def same(a, b):
    return a == b and kind(a) == kind(b)


def plain(s, v, at="$"):
    """(path, rule) of what is broken."""
    out, k = [], kind(v)
    has = lambda t: k == t or (t == "integer" and k == "number" and v == int(v))
    if "type" in s and not any(map(has, [s["type"]] if isinstance(s["type"], str) else s["type"])):
        out.append((at, "type"))
    if "enum" in s and not any(same(v, x) for x in s["enum"]):
        out.append((at, "enum"))
    if "const" in s and not same(v, s["const"]):
        out.append((at, "const"))
    if k == "number":
        tests = {"minimum": lambda w: v < w, "maximum": lambda w: v > w, "exclusiveMinimum": lambda w: v <= w, "exclusiveMaximum": lambda w: v >= w, "multipleOf": lambda w: v / w != round(v / w)}
    elif k == "string":
        tests = {"pattern": lambda w: not re.search(w, v), "minLength": lambda w: len(v) < w, "maxLength": lambda w: len(v) > w}
    elif k == "array":
        tests = {"minItems": lambda w: len(v) < w, "maxItems": lambda w: len(v) > w, "uniqueItems": lambda w: any(same(a, b) for i, a in enumerate(v) for b in v[:i])}
    elif k == "object":
        tests = {"minProperties": lambda w: len(v) < w, "maxProperties": lambda w: len(v) > w}
        out += [(at, "required") for n in s.get("required", ()) if n not in v]
        for n, x in v.items():
            matched = [t for p, t in s.get("patternProperties", {}).items() if re.search(p, n)]
            out += [i for t in matched for i in plain(t, x, f"{at}.{n}")]
            if n in s.get("properties", {}):
                out += plain(s["properties"][n], x, f"{at}.{n}")
            elif not matched and "additionalProperties" in s:
                more = s["additionalProperties"]
                out += [(at, "additionalProperties")] if more is False else plain(more, x, f"{at}.{n}")
            if "propertyNames" in s and not re.search(s["propertyNames"]["pattern"], n):
                out.append((at, "propertyNames"))
    else:
        tests = {}
    out += [(at, r) for r, broken in tests.items() if r in s and broken(s[r])]
    if k == "array" and "items" in s:
        out += [i for n, x in enumerate(v) for i in plain(s["items"], x, f"{at}[{n}]")]
    fits = lambda t: not plain(t, v, at)
    if "anyOf" in s and not any(map(fits, s["anyOf"])):
        out.append((at, "anyOf"))
    if "oneOf" in s and sum(map(fits, s["oneOf"])) != 1:
        out.append((at, "oneOf"))
    if "not" in s and fits(s["not"]):
        out.append((at, "not"))
    out += [i for t in s.get("allOf", ()) for i in plain(t, v, at)]
    if "$ref" in s:
        out += plain(SCHEMA["$defs"]["link"], v, at)
    return out


def documents(n):
    r = random.Random(4)
    leaf = lambda: r.choice([None, True, 0, 7, 1.0, 2, 2.5, -1, 1e3, "", "n1", "up", "kkk", "k", "long text", [], {}, [1], {"a": 1}])
    link = lambda: r.choice([leaf(), {"to": r.choice(["n1", "n2", "x", 3]), "cost": leaf()}, {"cost": -2}, {"to": "n5", "sub": [[1, 2.0], [leaf()], leaf()]}])
    out = []
    for _ in range(n):
        d = {"id": r.choice([1, 2, 49, 50, leaf()]), "links": r.choice([leaf(), [link() for _ in range(r.randint(0, 4))], [{"to": "n1"}]])}
        for name, make in (("state.x", leaf), ("kind", leaf), ("any", leaf), ("x-1", leaf), ("x-2", leaf), ("other", leaf), ("attrs", lambda: r.choice([leaf(), {r.choice("abcde"): leaf() for _ in range(4)}]))):
            if r.random() < 0.5:
                d[name] = make()
        if r.random() < 0.1:
            d.pop(r.choice(list(d)))
        out.append(r.choice([d] * 20 + [leaf()]))
    return out


def test_against_a_plain_version(spark):
    docs = documents(400)
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "key int, text string").selectExpr("*", "1 AS value", "2 AS x", "3 AS path")
    got = sorted((r.key, r.path, r.rule) for r in schema_check.check(rows.repartition(3), SCHEMA).collect())
    want = sorted((i, *x) for i, d in enumerate(docs) for x in plain(SCHEMA, d))
    assert got == want and len({x[2] for x in want}) >= 17 and len({x[0] for x in want}) < 400


def test_odd_documents(spark):
    rows = spark.createDataFrame([(1, None), (2, "{bad"), (None, '{"id": 1, "links": [{"to": "n1"}]}'), (None, "[]"), (None, "[]"), (3, "")], "key int, text string")
    got = sorted(((r.key or 0), r.path, r.rule) for r in schema_check.check(rows, SCHEMA).collect())
    assert got == [(0, "$", "type"), (0, "$", "type"), (1, "$", "json"), (2, "$", "json"), (3, "$", "json")]
    assert schema_check.check(rows.where("false"), SCHEMA).count() == 0
    assert schema_check.check(rows.where("key IS NULL"), {}).count() == 0 and schema_check.check(rows.where("key IS NULL"), {"additionalProperties": True}).count() == 0
    quoted = spark.createDataFrame([(1, json.dumps({"it's": 1, 'a"b': 2, "a.b": "x", "'\"": 0}))], "key int, text string")
    s = {"properties": {"it's": {"type": "string"}, 'a"b': {"minimum": 3}, "a.b": {"type": "number"}, "'\"": {"const": 1}}, "additionalProperties": False}
    assert sorted(r.path for r in schema_check.check(quoted, s).collect()) == ["$.'\"", '$.a"b', "$.a.b", "$.it's"]


@pytest.mark.parametrize("schema, message", [
    ({"type": "thing"}, "unknown type"), ({"minimun": 1}, "unknown rule"), ({"$ref": "#/$defs/none"}, "reference to nothing"), ({"$ref": "http://x"}, "another document"),
    ({"properties": {"a": {"$ref": "#"}}}, "too deeply"), ({"items": 3}, "no schema"),
])
def test_schemas_that_are_refused(spark, schema, message):
    with pytest.raises(ValueError, match=message):
        schema_check.check(spark.createDataFrame([(1, "{}")], "key int, text string"), schema)


def test_rules_are_asked_only_what_they_need(spark):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"$ref": "#/$defs/x"}}}, "$defs": {"x": {"type": "object", "required": ["y"], "properties": {"y": {"enum": ["p", 1]}}}}}
    rows = spark.createDataFrame([(1, '{"a": [{"y": "p"}, {"y": "q"}, {"y": 1.0}, {"y": "1"}, {}, []]}'), (2, '{"b": 1}'), (3, "[]")], "key int, text string")
    found = schema_check.check(rows, schema)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "schema_of_variant(value#" not in plan  # the type of a whole document isn't spelled out
    assert sorted((r.key, r.path, r.rule) for r in found.collect()) == [
        (1, "$.a[1].y", "enum"), (1, "$.a[3].y", "enum"), (1, "$.a[4]", "required"), (1, "$.a[5]", "type"), (2, "$", "additionalProperties"), (2, "$", "required"), (3, "$", "type"),
    ]

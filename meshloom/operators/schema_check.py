"""Documents checked against a JSON schema, as one Column for each rule.

Documents are VARIANT values. A schema is compiled once, on the driver, into a Column: an
array of what is broken, each with its path, rule and message; rows are then judged by
Spark's own functions, wherever they are. Members of arrays and of objects with free keys
are judged by higher-order functions, so nothing is exploded.

Rules taken: ``type`` (one or several), ``required``, ``properties``, ``patternProperties``,
``additionalProperties`` (false, or a schema), ``propertyNames`` (pattern), ``items``, ``minItems``, ``maxItems``,
``uniqueItems``, ``enum``, ``const``, ``pattern``, ``minLength``, ``maxLength``, ``minimum``, ``maximum``,
``exclusiveMinimum``, ``exclusiveMaximum``, ``multipleOf``, ``minProperties``, ``maxProperties``,
``allOf``, ``anyOf``, ``oneOf``, ``not`` and local ``$ref``. An unknown rule is an error, not ignored;
annotations (``title``, ``description``, ``default``, ``examples``, names in ``$``) say nothing. As in the
standard, a rule for one type holds for values of that type only, and a whole number may be written 1.0.

A null document, or text that isn't JSON, breaks the rule ``json``; repeated rows are judged each.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUES = "array<struct<path:string,rule:string,message:string>>"
# Names of the standard.
#: What a value's own type is called, by how the schema of a VARIANT begins.
TYPES = {
    "object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "integer": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
}
SAID = {"title", "description", "default", "examples", "$schema", "$id", "$defs", "$comment", "definitions", "deprecated", "readOnly", "writeOnly"}
#: Rules that are read with another one.
WITH = {"additionalProperties", "patternProperties"}
#: Rules that ask for a value's text, its keys or its members.
TEXT, MEMBERS = {"pattern", "minLength", "maxLength"}, {"minItems", "maxItems", "uniqueItems", "items"}
KEYS = {"minProperties", "maxProperties", "required", "properties", "propertyNames", "patternProperties", "additionalProperties"}
#: Rules that ask for a value's number.
NUMBER = {"enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}
#: How deep references may lead into each other.
DEPTH = 24


def _is(own: Column, number: Column, kind: str) -> Column:
    """Whether a value has the type, by the schema of its VARIANT and its number."""
    found = reduce(Column.__or__, (own.startswith(p) for p in TYPES[kind]))
    if kind == "integer":
        found = found & (number == F.floor(number))
    return F.coalesce(found, F.lit(False))


def _number(value: Column) -> Column:
    """The value of a number, else null; text isn't tried, as each that is no number would be an exception with its stack."""
    return F.when(_is(F.schema_of_variant(value), F.lit(None), "number"), F.try_variant_get(value, "$", "double"))


def _plain(value: Column) -> Column:
    """A value as text that equal values share: JSON, numbers as doubles."""
    return F.coalesce(_number(value).cast("string"), F.to_json(value))


def _lit(value: object) -> Column:
    """A constant in the form of :func:`_plain`."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.lit(float(value)).cast("string")
    return F.to_json(F.parse_json(F.lit(json.dumps(value))))


class Compiler:
    """Columns of one schema."""

    def __init__(self, schema: Mapping):
        self.root = schema

    def resolve(self, ref: str) -> Mapping:
        """The part of the schema that a local reference names."""
        if not ref.startswith("#"):
            raise ValueError(f"reference to another document: {ref}")
        found = self.root
        for step in [s for s in ref[1:].split("/") if s]:
            step = step.replace("~1", "/").replace("~0", "~")
            if not isinstance(found, Mapping) or step not in found:
                raise ValueError(f"reference to nothing: {ref}")
            found = found[step]
        return found

    def issues(self, schema: Mapping | bool, value: Column, path: Column, depth: int = 0) -> Column:
        """What of a value breaks the schema: an array, in which rules that hold are null."""
        if depth > DEPTH:
            raise ValueError("schema refers to itself too deeply")
        none = F.array().cast(ISSUES)
        if schema is True or schema == {}:
            return none
        issue = lambda rule, message, at=path: F.struct(at.alias("path"), F.lit(rule).alias("rule"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
        if schema is False:
            return F.array(issue("false", "nothing is allowed here")).cast(ISSUES)
        if not isinstance(schema, Mapping):
            raise ValueError(f"no schema: {schema!r}")
        if list(schema) == ["$ref"]:
            return self.issues(self.resolve(schema["$ref"]), value, path, depth + 1)
        # what rules ask of a value is found once, and held while they are tried; taking variants out of one writes
        # them anew, and the type of an object or array is that of all in it, so neither is done where no rule asks for it
        held = {
            "own": F.schema_of_variant(value), "number": _number(value), "text": F.try_variant_get(value, "$", "string"),
            "fields": F.try_variant_get(value, "$", "map<string,variant>"), "members": F.try_variant_get(value, "$", "array<variant>"),
        }
        kinds = {schema["type"]} if isinstance(schema.get("type"), str) else set(schema.get("type", ()))
        asked = {
            "own": schema.keys() & (NUMBER | TEXT) or kinds - {"object", "array"}, "number": schema.keys() & NUMBER or kinds & {"number", "integer"}, "text": schema.keys() & TEXT,
            "fields": schema.keys() & KEYS or "object" in kinds, "members": schema.keys() & MEMBERS or "array" in kinds,
        }
        needed = [n for n in held if asked[n]]
        bound = F.struct(value.alias("value"), path.alias("path"), *[held[n].alias(n) for n in needed])
        return F.transform(F.array(bound), lambda s: self._rules(schema, s["value"], s["path"], {n: s[n] for n in needed}, depth))[0]

    def _rules(self, schema: Mapping, value: Column, path: Column, held: Mapping[str, Column], depth: int) -> Column:
        """What of a value breaks each rule of the schema, from what is held of it."""
        none = F.array().cast(ISSUES)
        issue = lambda rule, message, at=path: F.struct(at.alias("path"), F.lit(rule).alias("rule"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
        single, many = [], []
        number, text, fields, members = (held.get(n) for n in ("number", "text", "fields", "members"))
        keys = None if fields is None else F.map_keys(fields)
        known = {"object": fields, "array": members}  # only objects and arrays have these
        is_ = lambda kind: known[kind].isNotNull() if kind in known else _is(held["own"], number, kind)
        plain = F.when(is_("number"), number.cast("string")).otherwise(F.to_json(value)) if number is not None else None
        breaks = lambda kind, rule, message, broken: single.append(F.when(is_(kind) & F.coalesce(broken, F.lit(False)), issue(rule, message)))
        down = lambda s, v, p: self.issues(s, v, p, depth + 1)
        passes = lambda s: F.size(F.filter(down(s, value, path), lambda x: x.isNotNull())) == 0
        for rule, want in schema.items():
            if rule in SAID or rule in WITH:
                continue
            if rule == "type":
                kinds = [want] if isinstance(want, str) else list(want)
                if unknown := [k for k in kinds if k not in TYPES]:
                    raise ValueError(f"unknown type: {unknown[0]}")
                single.append(F.when(~reduce(Column.__or__, (is_(k) for k in kinds)), issue(rule, f"not {' or '.join(kinds)}")))
            elif rule == "enum":
                single.append(F.when(~plain.isin(*[_lit(v) for v in want]), issue(rule, f"none of {json.dumps(want)}")))
            elif rule == "const":
                single.append(F.when(plain != _lit(want), issue(rule, f"not {json.dumps(want)}")))
            elif rule in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
                says, broken = {
                    "minimum": ("under", number < want), "maximum": ("over", number > want),
                    "exclusiveMinimum": ("not over", number <= want), "exclusiveMaximum": ("not under", number >= want),
                }[rule]
                breaks("number", rule, f"{says} {want}", broken)
            elif rule == "multipleOf":
                breaks("number", rule, f"no multiple of {want}", F.abs(number / want - F.rint(number / want)) > 1e-9)
            elif rule == "pattern":
                breaks("string", rule, f"doesn't match {want}", ~text.rlike(want))
            elif rule in ("minLength", "maxLength"):
                breaks("string", rule, f"{'under' if rule == 'minLength' else 'over'} {want} characters", F.length(text) < want if rule == "minLength" else F.length(text) > want)
            elif rule in ("minItems", "maxItems"):
                breaks("array", rule, f"{'under' if rule == 'minItems' else 'over'} {want} items", F.size(members) < want if rule == "minItems" else F.size(members) > want)
            elif rule == "uniqueItems":
                each = F.transform(members, _plain)
                if want:
                    breaks("array", rule, "an item is there twice", F.size(F.array_distinct(each)) < F.size(each))
            elif rule in ("minProperties", "maxProperties"):
                breaks("object", rule, f"{'under' if rule == 'minProperties' else 'over'} {want} keys", F.size(keys) < want if rule == "minProperties" else F.size(keys) > want)
            elif rule == "required":
                for name in want:
                    breaks("object", rule, f"{name} is missing", ~F.array_contains(keys, name))
            elif rule == "properties":
                for name, inner in want.items():
                    member = F.try_element_at(fields, F.lit(name))
                    many.append(F.when(is_("object") & F.array_contains(keys, name), down(inner, member, F.concat(path, F.lit(f".{name}")))))
            elif rule == "propertyNames":
                bad = F.filter(keys, lambda k: ~k.rlike(want["pattern"]))
                many.append(F.when(is_("object"), F.transform(bad, lambda k: issue(rule, F.concat(k, F.lit(f" doesn't match {want['pattern']}"))))))
            elif rule == "items":
                indexed = F.transform(members, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
                inside = F.transform(indexed, lambda x: down(want, x["v"], F.concat(path, F.lit("["), x["i"].cast("string"), F.lit("]"))))
                many.append(F.when(is_("array"), F.flatten(inside)))
            elif rule == "allOf":
                many += [down(s, value, path) for s in want]
            elif rule == "anyOf":
                single.append(F.when(~reduce(Column.__or__, (passes(s) for s in want)), issue(rule, "fits none of the forms")))
            elif rule == "oneOf":
                fits = reduce(Column.__add__, (passes(s).cast("int") for s in want))
                single.append(F.when(fits != 1, issue(rule, F.concat(F.lit("fits "), fits.cast("string"), F.lit(" of the forms")))))
            elif rule == "not":
                single.append(F.when(passes(want), issue(rule, "has a form that is not allowed")))
            elif rule == "$ref":
                many.append(down(self.resolve(want), value, path))
            else:
                raise ValueError(f"unknown rule: {rule}")
        patterns = schema.get("patternProperties", {})
        rest = None if fields is None else F.map_entries(fields)
        named = lambda p: lambda e: e["key"].rlike(p)
        inner = lambda s: lambda e: down(s, e["value"], F.concat(path, F.lit("."), e["key"]))
        for pattern, s in patterns.items():
            many.append(F.when(is_("object"), F.flatten(F.transform(F.filter(rest, named(pattern)), inner(s)))))
        more = schema.get("additionalProperties", True)
        if more is not True and more != {}:
            named_keys = [F.lit(k) for k in schema.get("properties", {})]
            free = lambda k: reduce(Column.__and__, [~k.rlike(p) for p in patterns], ~k.isin(*named_keys) if named_keys else F.lit(True))
            other = F.filter(rest, lambda e: free(e["key"]))
            found = F.transform(other, lambda e: issue("additionalProperties", F.concat(e["key"], F.lit(" is not a known key")))) if more is False else F.flatten(F.transform(other, inner(more)))
            many.append(F.when(is_("object"), found))
        arrays = ([F.array(*single).cast(ISSUES)] if single else []) + [F.coalesce(m.cast(ISSUES), none) for m in many]
        return arrays[0] if len(arrays) == 1 else F.concat(*arrays) if arrays else none


def compiled(schema: Mapping, value: Column) -> Column:
    """What of a VARIANT column breaks the schema: an array of ``(path, rule, message)``, empty if nothing does."""
    found = F.filter(Compiler(schema).issues(schema, value, F.lit("$")), lambda x: x.isNotNull())
    unread = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"), F.lit("no JSON").alias("message"))).cast(ISSUES)
    return F.when(value.isNull(), unread).otherwise(found)


def check(documents: DataFrame, schema: Mapping, key: str = "key", text: str = "text") -> DataFrame:
    """``(key, path, rule, message)``: a row for everything in the documents (JSON text, or VARIANT) that breaks the schema."""
    column = F.col(text)
    rows = documents.select(F.col(key).alias("key"), (column if documents.schema[text].dataType.typeName() == "variant" else F.try_parse_json(column)).alias("value"))
    return rows.select("key", F.explode(compiled(schema, F.col("value"))).alias("x")).select("key", "x.path", "x.rule", "x.message")

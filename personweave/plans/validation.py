"""JSON Schema (the common subset of draft 2020-12) compiled into predicates over VARIANT values.

Keywords: type, required, properties, patternProperties, additionalProperties (a schema or a boolean), items, enum,
const, minimum, maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern, minItems, maxItems,
uniqueItems, allOf, anyOf, oneOf, not, $ref into the root's $defs or definitions (not circular ones). Annotations,
format among them, assert nothing. Any other keyword is an error when the schema is compiled.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKED = ("type", "required", "properties", "patternProperties", "additionalProperties", "items", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "allOf", "anyOf", "oneOf", "not", "$ref")
IGNORED = ("$schema", "$id", "$defs", "definitions", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly")
#: References that may be followed inside each other.
MOST_REFERENCES = 32

ERROR = "struct<path:string,schema_path:string,message:string,validator:string>"


def _error(path: Column, schema_path: str, message: Column, validator: str) -> Column:
    return F.struct(path.alias("path"), F.lit(schema_path).alias("schema_path"), message.alias("message"), F.lit(validator).alias("validator")).cast(ERROR)


def _kind(v: Column) -> Column:
    """The JSON type of a VARIANT that is not absent."""
    s = F.schema_of_variant(v)
    number = F.when(v.cast("string").rlike(r"^-?\d+(\.0+)?$"), "integer").otherwise("number")
    return (
        F.when(s == "VOID", "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").otherwise(number)
    )


def _is(v: Column, kinds: list[str]) -> Column:
    k = _kind(v)
    wanted = set(kinds) | ({"integer"} if "number" in kinds else set())
    return k.isin(*wanted)


def _referred(ref: str, root: dict) -> dict | bool:
    place, _, name = ref.rpartition("/")
    if place not in ("#/$defs", "#/definitions") or name not in root.get(place.removeprefix("#/"), {}):
        raise ValueError(f"cannot resolve {ref!r}")
    return root[place.removeprefix("#/")][name]


def errors_of(v: Column, schema: dict | bool, path: Column | None = None, schema_path: str = "", root: dict | None = None, depth: int = 0) -> Column:
    """Array of errors of the value v (not absent) against the schema."""
    path = F.lit("$") if path is None else path
    if isinstance(schema, bool):
        refused = F.array(_error(path, schema_path, F.lit("no value is allowed here"), "false"))
        return F.array().cast(f"array<{ERROR}>") if schema else refused
    root = schema if root is None else root
    unknown = sorted(set(schema) - set(CHECKED) - set(IGNORED))
    if unknown:
        raise ValueError(f"keywords that are not supported: {', '.join(unknown)}")
    if depth > MOST_REFERENCES:
        raise ValueError("circular references are not supported")
    text = F.to_json(v)
    out: list[Column] = []
    none = F.array().cast(f"array<{ERROR}>")
    at = lambda k: f"{schema_path}/{k}" if schema_path else k

    def check(keyword: str, bad: Column, message: Column) -> None:
        out.append(F.when(bad, F.array(_error(path, at(keyword), message, keyword))).otherwise(none))

    said = lambda s: F.concat(text, F.lit(s))
    sub = lambda x, inner, where, name, deeper=0: errors_of(x, inner, where, at(name), root, depth + deeper)
    if "$ref" in schema:
        out.append(sub(v, _referred(schema["$ref"], root), path, "$ref", 1))
    for k, inner in enumerate(schema.get("allOf", ())):
        out.append(sub(v, inner, path, f"allOf/{k}"))
    for keyword, bad, words in (("anyOf", lambda n: n == 0, " is not valid under any of the given schemas"), ("oneOf", lambda n: n != 1, " is not valid under exactly one of the given schemas")):
        if keyword in schema:
            fits = [(F.size(sub(v, inner, path, f"{keyword}/{k}")) == 0).cast("int") for k, inner in enumerate(schema[keyword])]
            check(keyword, bad(sum(fits[1:], fits[0])), said(words))
    if "not" in schema:
        check("not", F.size(sub(v, schema["not"], path, "not")) == 0, said(" should not be valid under the given schema"))
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        check("type", ~_is(v, kinds), said(f" is not of type {', '.join(repr(k) for k in kinds)}"))
    if "enum" in schema:
        check("enum", ~text.isin(*[_canonical(x) for x in schema["enum"]]), said(f" is not one of {schema['enum']!r}"))
    if "const" in schema:
        check("const", text != _canonical(schema["const"]), F.lit(f"{schema['const']!r} was expected"))
    number, is_number = F.try_variant_get(v, "$", "double"), _is(v, ["number"])
    for keyword, bad, words in (("minimum", lambda x: number < x, "less than the minimum of"), ("maximum", lambda x: number > x, "greater than the maximum of"), ("exclusiveMinimum", lambda x: number <= x, "less than or equal to the minimum of"), ("exclusiveMaximum", lambda x: number >= x, "greater than or equal to the maximum of")):
        if keyword in schema:
            check(keyword, is_number & bad(schema[keyword]), said(f" is {words} {schema[keyword]}"))
    string, is_string = F.try_variant_get(v, "$", "string"), _is(v, ["string"])
    for keyword, bad, words in (("minLength", lambda x: F.length(string) < x, "is too short"), ("maxLength", lambda x: F.length(string) > x, "is too long")):
        if keyword in schema:
            check(keyword, is_string & bad(schema[keyword]), said(f" {words}"))
    if "pattern" in schema:
        check("pattern", is_string & ~F.regexp_like(string, F.lit(schema["pattern"])), said(f" does not match {schema['pattern']!r}"))
    is_object, is_array = _is(v, ["object"]), _is(v, ["array"])
    keys = F.json_object_keys(text)
    for name in schema.get("required", ()):
        check("required", is_object & ~F.coalesce(F.array_contains(keys, name), F.lit(False)), F.lit(f"{name!r} is a required property"))
    properties = schema.get("properties", {})
    has = lambda name: F.coalesce(F.array_contains(keys, name), F.lit(False))
    patterns = schema.get("patternProperties", {})
    matching = lambda p: lambda k: F.regexp_like(k, F.lit(p))
    named = lambda k, found: reduce(lambda a, b: a | b, [matching(p)(k) for p in found], F.lit(False))
    extra = F.filter(keys, lambda k: ~((k.isin(*properties) if properties else F.lit(False)) | named(k, patterns)))
    if schema.get("additionalProperties") is False:
        check("additionalProperties", is_object & (F.size(extra) > 0), F.concat(F.lit("Additional properties are not allowed: "), F.array_join(extra, ", ")))
    for name, inner in properties.items():
        child = F.try_variant_get(v, f"$['{name}']", "variant")
        out.append(F.when(has(name), sub(child, inner, F.concat(path, F.lit(f".{name}")), f"properties/{name}")).otherwise(none))

    def each_of(names: Column, inner: dict | bool, keyword: str) -> None:
        """The errors of the values of the named keys, which are known at run time alone."""
        values = F.try_variant_get(v, "$", "map<string,variant>")
        found = F.transform(names, lambda k: sub(F.try_element_at(values, k), inner, F.concat(path, F.lit("."), k), keyword))
        out.append(F.when(is_object, F.flatten(found)).otherwise(none))

    for p, inner in patterns.items():
        each_of(F.filter(keys, matching(p)), inner, f"patternProperties/{p}")
    if isinstance(schema.get("additionalProperties"), dict):
        each_of(extra, schema["additionalProperties"], "additionalProperties")
    items = F.try_variant_get(v, "$", "array<variant>")
    for keyword, bad, words in (("minItems", lambda x: F.size(items) < x, "is too short"), ("maxItems", lambda x: F.size(items) > x, "is too long")):
        if keyword in schema:
            check(keyword, is_array & bad(schema[keyword]), said(f" {words}"))
    if schema.get("uniqueItems"):
        shown = F.transform(items, lambda x: F.to_json(x))
        check("uniqueItems", is_array & (F.size(F.array_distinct(shown)) < F.size(shown)), said(" has non-unique elements"))
    if "items" in schema:
        each = F.transform(items, lambda x, i: sub(x, schema["items"], F.concat(path, F.lit("."), i.cast("string")), "items"))
        out.append(F.when(is_array, F.flatten(each)).otherwise(none))
    return F.concat(*out) if out else none


def _canonical(x: Any) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def validate(df: DataFrame, payload: str, schema: dict, strict: bool = False, output: str = "schema_errors") -> DataFrame:
    """The rows with the payload's errors, sorted by path. Text that is no JSON has one error.

    strict: any error fails the query, all messages joined by "; ".
    """
    v = F.try_parse_json(payload)
    unread = F.array(_error(F.lit("$"), "", F.lit("not a JSON value"), "type"))
    found = F.when(v.isNull(), unread).otherwise(F.array_sort(errors_of(v, schema)))
    if strict:
        messages = F.array_join(F.transform(found, lambda e: F.concat(e["path"], F.lit(": "), e["message"])), "; ")
        found = F.when(F.size(found) > 0, F.raise_error(messages)).otherwise(found)
    return df.withColumn(output, found)

import json

import pytest

from personweave.plans.projection import Config, project
from personweave.plans.validation import validate

SCHEMA = "name string, note string, overall_confidence double, tags array<string>, place struct<city:string,confidence:double,deep:struct<x:int>>, skills array<struct<name:string,confidence:double>>, extra map<string,string>, when date"


@pytest.fixture
def df(spark):
    import datetime

    return spark.createDataFrame([("Ann", None, 0.84, ["a", "b"], ("Austin", 0.5, (1,)), [("js", 0.25), ("go", None)], {"k": "v"}, datetime.date(2020, 1, 2))], SCHEMA)


def out(df, config, strict=False):
    r = project(df, config, strict).first()
    return json.loads(r["output"]), r["errors"], r["warnings"]


def test_paths(df):
    fields = [{"path": "n", "from": "name"}, {"path": "place.city"}, {"path": "e", "from": "extra.k"}, {"path": "when"}, {"path": "c", "from": "confidence"}, {"path": "no", "from": "skills.name"}, {"from": "name"}, {"note": 1}]
    assert out(df, {"fields": fields})[0] == {"n": "Ann", "place.city": "Austin", "e": "v", "when": "2020-01-02", "c": 0.84, "no": None, "name": "Ann"}


def test_nested_omission_keeps_inner_nulls_apart(df):
    skills = {"path": "skills", "fields": [{"path": "name"}, {"path": "confidence"}]}
    assert out(df, {"on_missing": "omit", "fields": [skills, {"path": "note"}]})[0] == {"skills": [{"name": "js", "confidence": 0.25}, {"name": "go"}]}
    assert out(df, {"fields": [skills, {"path": "note"}]})[0] == {"skills": [{"name": "js", "confidence": 0.25}, {"name": "go", "confidence": None}], "note": None}


def test_errors_keep_partial_data(df):
    got, errors, _ = out(df, {"fields": [{"path": "name"}, {"path": "note", "required": True}, {"path": "o", "from": "place", "fields": [{"path": "zip", "required": True}]}]})
    assert got == {"name": "Ann"} and [e.split(":")[0] for e in errors] == ["Field 'note'", "Field 'o'"]
    with pytest.raises(Exception, match="Projection completed with errors"):
        project(df, {"fields": [{"path": "note", "required": True}]}, strict=True).collect()
    got, errors, _ = out(df, {"on_missing": "error", "fields": {"name": "name", "note": "note"}})
    assert got == {"name": "Ann"} and errors == ["Field 'note': Required field 'note' could not be resolved."]


def test_rescale(df):
    fields = [{"path": "confidence"}, {"path": "skills", "fields": [{"path": "confidence"}]}]
    assert out(df, {"confidence_range": {"min": 0, "max": 100}, "fields": fields})[0] == {"confidence": 84.0, "skills": [{"confidence": 25.0}, {"confidence": None}]}
    assert out(df, {"confidence_range": {"min": 1, "max": 10}, "fields": {"confidence": "confidence", "c": "place.confidence"}})[0] == {"confidence": 8.56, "c": 0.5}
    assert out(df, {"confidence_range": "x", "fields": {"name": "name"}})[2] == ["Invalid confidence range (min=None, max=None). Falling back to default range [0.0, 1.0]."]


def test_types(df):
    cases = [("tags", "string", "a\nb"), ("overall_confidence", "integer", 0), ("name", "number", 0.0), ("name", "bool", False), ("tags", "array", ["a", "b"]), ("name", "array", ["Ann"]), ("name", "object", {"value": "Ann"}), ("place", "object", {"city": "Austin", "confidence": 0.5, "deep": {"x": 1}}), ("tags", "boolean", True), ("name", "other", "Ann")]
    for path, kind, expected in cases:
        assert out(df, {"fields": [{"path": "v", "from": path, "type": kind}]})[0] == {"v": expected}, (path, kind)


def test_dict_form(df):
    fields = {"lit": [1, 2], "m": {"path": "nope", "missing": 0}, "flat": {"path": "place", "flatten": True, "prefix": "p_"}, "obj": {"path": "place", "fields": {"town": "city"}}, "arr": {"path": "name", "array": {}}, "items": {"path": "skills", "array": {"fields": {"n": "name"}}}}
    assert out(df, {"fields": fields})[0] == {"lit": [1, 2], "m": 0, "flat": {"p_city": "Austin", "p_confidence": 0.5, "p_deep_x": 1}, "obj": {"town": "Austin"}, "arr": ["Ann"], "items": [{"n": "js"}, {"n": "go"}]}
    assert out(df, {"missing_value": "-", "fields": {"a": "nope"}})[0] == {"a": "-"}


def test_metadata(df):
    nested = [{"path": "skills", "fields": [{"path": "name"}]}]
    assert out(df, {"include_confidence": True, "fields": nested})[0] == {"skills": [{"name": "js", "confidence": 0.25}, {"name": "go", "confidence": None}], "confidence": 0.84}
    assert out(df, {"hide_confidence": True, "fields": [{"path": "place"}, {"path": "confidence"}]})[0] == {"place": {"city": "Austin", "deep": {"x": 1}}}
    assert out(df, {"include_provenance": False, "fields": {"name": "name", "provenance": "tags"}})[0] == {"name": "Ann"}


def test_config_file(df, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"fields": ["skip", {"path": "name"}]}'.replace('"skip", ', ""), encoding="utf-8")
    assert out(df, path)[0] == {"name": "Ann"} and Config.load(str(path)).on_missing == "null"


def test_schema(spark):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["string", "null"], "pattern": "^x", "maxLength": 3}, "n": {"type": "number", "minimum": 1}, "l": {"type": "array", "maxItems": 1, "items": {"type": "integer", "enum": [1, 2]}}, "d": {"type": "string", "format": "date"}, "k": {"const": 5}}}
    rows = [('{"a":"xyz","n":1.5,"l":[1],"d":"no date","k":5}', []), ('{"a":"yyyy","n":0,"l":[1,3,"x"],"z":1,"k":6}', ["$ additionalProperties", "$.a maxLength", "$.a pattern", "$.k const", "$.l maxItems", "$.l.1 enum", "$.l.2 enum", "$.l.2 type", "$.n minimum"]), ('{"a":null}', []), ("[]", ["$ type"]), ("oops", ["$ type"]), ('{"n":1}', ["$ required"])]
    df = spark.createDataFrame([(p,) for p, _ in rows], "p string")
    for got, (payload, expected) in zip(validate(df, "p", schema).collect(), rows, strict=True):
        assert sorted(f"{e['path']} {e['validator']}" for e in got["schema_errors"]) == expected, payload
    with pytest.raises(Exception, match="required property"):
        validate(df.limit(6).where("p like '%n%' AND p not like '%a%'"), "p", schema, strict=True).collect()


def test_schema_keywords(spark):
    def kinds(schema, value):
        df = validate(spark.createDataFrame([(value,)], "p string"), "p", schema)
        return [(e["path"], e["validator"]) for e in df.first()["schema_errors"]]

    assert kinds({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, "1") == [("$", "exclusiveMinimum")] and kinds({"exclusiveMaximum": 3}, "3") == [("$", "exclusiveMaximum")] and kinds({"exclusiveMinimum": 1}, "2") == []
    assert kinds({"uniqueItems": True}, '[1,{"a":1},1]') == [("$", "uniqueItems")] and kinds({"uniqueItems": True}, '[1,"1"]') == []
    assert kinds({"anyOf": [{"type": "string"}, {"minimum": 5}]}, "3") == [("$", "anyOf")] and kinds({"anyOf": [{"type": "string"}, {"minimum": 5}]}, "7") == []
    assert kinds({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, "7") == [("$", "oneOf")] and kinds({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, "3") == []
    assert kinds({"allOf": [{"type": "string"}, {"minLength": 2}]}, '"a"') == [("$", "minLength")]
    assert kinds({"not": {"type": "null"}}, "null") == [("$", "not")] and kinds({"not": {"type": "null"}}, "1") == []
    refs = {"properties": {"a": {"$ref": "#/$defs/n"}, "b": {"items": {"$ref": "#/definitions/s"}}}, "$defs": {"n": {"type": "integer"}}, "definitions": {"s": {"type": "string"}}}
    assert kinds(refs, '{"a":"x","b":["y",1]}') == [("$.a", "type"), ("$.b.1", "type")]
    wild = {"properties": {"a": {}}, "patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": {"type": "string"}}
    assert kinds(wild, '{"a":[],"n_1":"x","n_2":3,"z":"ok","y":5}') == [("$.n_1", "type"), ("$.y", "type")]
    assert kinds({"patternProperties": {"^n_": True}, "additionalProperties": False}, '{"n_1":1}') == [] and kinds({"additionalProperties": False}, '{"n_1":1}') == [("$", "additionalProperties")]
    assert kinds({"properties": {"a": False}, "format": "email", "title": "t"}, '{"a":1}') == [("$.a", "false")]
    for bad in ({"if": {}}, {"properties": {"a": {"contains": {}}}}, {"$ref": "#/$defs/none"}, {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}}):
        with pytest.raises(ValueError):
            kinds(bad, "1")

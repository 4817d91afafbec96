"""Queries of projection and validation, over entities with a scalar, an object and a list."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pipeline import generate_output
from .projection import project
from .validation import validate
from .views import Catalog, frame

catalog = Catalog()
add = catalog.add

_ENTITY = """SELECT c_custkey AS id, c_name AS display_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lower(c_mktsegment) END AS segment, c_acctbal AS balance, 0.25D + (c_custkey % 4) * 0.125D AS overall_confidence,
  named_struct('city', n_name, 'country', CASE c_custkey % 3 WHEN 0 THEN 'India' WHEN 1 THEN 'fr' ELSE 'Nowhere' END, 'confidence', 0.5D) AS location,
  CASE WHEN c_custkey % 2 = 0 THEN array(named_struct('name', 'js', 'confidence', 0.75D, 'provenance', array('a')), named_struct('name', 'spark_sql', 'confidence', 0.5D, 'provenance', array('b'))) ELSE array() END AS skills,
  concat('(212) 555-', lpad(cast(c_custkey % 10000 as string), 4, '0')) AS phone FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""

#: The same entities in DuckDB, with what the outputs show.
_E = """
WITH e AS (SELECT c_custkey AS id, c_name AS display_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lower(c_mktsegment) END AS segment, c_acctbal AS balance, 0.25::DOUBLE + (c_custkey % 4) * 0.125::DOUBLE AS overall_confidence,
  n_name AS city, CASE c_custkey % 3 WHEN 0 THEN 'India' WHEN 1 THEN 'fr' ELSE 'Nowhere' END AS country, c_custkey % 2 = 0 AS skilled, concat('(212) 555-', lpad((c_custkey % 10000)::VARCHAR, 4, '0')) AS phone FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def _q(x: str) -> str:
    """A JSON string or null."""
    return f"coalesce('\"' || {x} || '\"', 'null')"


def _project(spark: SparkSession, sf_dir: str, config: dict[str, Any]) -> DataFrame:
    out = project(frame(spark, sf_dir, _ENTITY), config)
    return out.select("id", "output", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


def _case(name: str, config: dict[str, Any], output: str, errors: str = "''", warnings: str = "''") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _project(spark, sf_dir, config)

    run.__name__ = name
    add(_E + f"SELECT id, {output} AS output, {errors} AS errors, {warnings} AS warnings FROM e")(run)


_SKILLS = "CASE WHEN skilled THEN '{0}' ELSE '[]' END"

_case(
    "project_list_form",
    {"fields": [{"path": "id"}, {"path": "name", "from": "display_name"}, {"path": "segment"}, {"path": "place", "from": "location", "fields": [{"path": "city"}]}, {"path": "skills", "fields": [{"path": "n", "from": "name"}]}, {"path": "gone", "from": "a.b"}]},
    f"""concat('{{"id":', id, ',"name":', {_q('display_name')}, ',"segment":', {_q('segment')}, ',"place":{{"city":', {_q('city')}, '}},"skills":', {_SKILLS.format('[{"n":"js"},{"n":"spark_sql"}]')}, ',"gone":null}}')""",
)
_case(
    "project_dict_form",
    {"fields": {"id": "id", "kind": 7, "name": {"path": "display_name"}, "city": "location.city", "list": {"path": "skills", "array": {"fields": {"n": "name"}}}, "one": {"path": "phone", "array": {}}, "seg": {"path": "segment", "missing": "none"}}},
    f"""concat('{{"id":', id, ',"kind":7,"name":', {_q('display_name')}, ',"city":', {_q('city')}, ',"list":', {_SKILLS.format('[{"n":"js"},{"n":"spark_sql"}]')}, ',"one":["', phone, '"],"seg":"', coalesce(segment, 'none'), '"}}')""",
)
_case(
    "project_missing_omit",
    {"on_missing": "omit", "fields": [{"path": "id"}, {"path": "segment"}, {"path": "place", "from": "location", "fields": [{"path": "city"}, {"path": "street"}]}]},
    f"""concat('{{"id":', id, coalesce(',"segment":"' || segment || '"', ''), ',"place":{{"city":', {_q('city')}, '}}}}')""",
)
_case("project_missing_null", {"on_missing": "null", "fields": {"id": "id", "segment": "segment"}}, f"""concat('{{"id":', id, ',"segment":', {_q('segment')}, '}}')""")
_case(
    "project_missing_error",
    {"on_missing": "error", "fields": [{"path": "id"}, {"path": "seg", "from": "segment"}]},
    """concat('{"id":', id, coalesce(',"seg":"' || segment || '"', ''), '}')""",
    "CASE WHEN segment IS NULL THEN 'Field ''seg'': Required field ''seg'' (from ''segment'') could not be resolved.' ELSE '' END",
)
_case(
    "project_required_nested",
    {"fields": [{"path": "id"}, {"path": "skills", "fields": [{"path": "name"}, {"path": "level", "required": True}]}]},
    """concat('{"id":', id, CASE WHEN skilled THEN '' ELSE ',"skills":[]' END, '}')""",
    "CASE WHEN skilled THEN 'Field ''skills'': Required field ''level'' (from ''level'') could not be resolved.' ELSE '' END",
)
_case(
    "project_normalize",
    {"fields": [{"path": "phone", "normalize": "e164"}, {"path": "country", "from": "location.country", "normalize": "ISO3166"}, {"path": "segment", "normalize": "canonical"}]},
    f"""concat('{{"phone":"+1212555', substr(phone, 11), '","country":"', CASE country WHEN 'India' THEN 'IN' WHEN 'fr' THEN 'FR' ELSE country END, '","segment":', {_q("upper(segment[1]) || segment[2:]")}, '}}')""",
)
_case(
    "project_coerce",
    {"fields": [{"path": "s", "from": "id", "type": "string"}, {"path": "i", "from": "balance", "type": "integer"}, {"path": "bad", "from": "display_name", "type": "int"}, {"path": "b", "from": "segment", "type": "boolean"}, {"path": "a", "from": "id", "type": "array"}, {"path": "o", "from": "id", "type": "object"}, {"path": "f", "from": "display_name", "type": "number"}]},
    """concat('{"s":"', id, '","i":', trunc(balance)::BIGINT, ',"bad":0,"b":', CASE WHEN segment IS NULL THEN 'null' ELSE 'false' END, ',"a":[', id, '],"o":{"value":', id, '},"f":0.0}')""",
)
_case(
    "project_rescale",
    {"confidence_range": {"min": 0, "max": 100}, "fields": [{"path": "id"}, {"path": "confidence"}, {"path": "c", "from": "location.confidence"}, {"path": "skills", "fields": [{"path": "confidence"}]}]},
    f"""concat('{{"id":', id, ',"confidence":', CASE id % 4 WHEN 0 THEN '25.0' WHEN 1 THEN '37.5' WHEN 2 THEN '50.0' ELSE '62.5' END, ',"c":50.0,"skills":', {_SKILLS.format('[{"confidence":75.0},{"confidence":50.0}]')}, '}}')""",
)
_case(
    "project_bad_range",
    {"confidence_range": {"min": 5, "max": 1}, "fields": {"id": "id"}},
    """concat('{"id":', id, '}')""",
    warnings="'Invalid confidence range (min=5, max=1). Falling back to default range [0.0, 1.0].'",
)
_case(
    "project_flatten",
    {"fields": {"id": "id", "at": {"path": "location", "flatten": True, "prefix": "loc_"}}},
    """concat('{"id":', id, ',"at":{"loc_city":"', city, '","loc_country":"', country, '","loc_confidence":0.5}}')""",
)
_case(
    "project_inject",
    {"include_confidence": True, "fields": [{"path": "id"}, {"path": "skills", "fields": [{"path": "name"}]}]},
    f"""concat('{{"id":', id, ',"skills":', {_SKILLS.format('[{"name":"js","confidence":0.75},{"name":"spark_sql","confidence":0.5}]')}, ',"confidence":', CASE id % 4 WHEN 0 THEN '0.25' WHEN 1 THEN '0.375' WHEN 2 THEN '0.5' ELSE '0.625' END, '}}')""",
)
_case(
    "project_hide",
    {"hide_confidence": True, "include_provenance": False, "fields": {"id": "id", "confidence": "overall_confidence", "at": "location", "skills": "skills"}},
    f"""concat('{{"id":', id, ',"at":{{"city":"', city, '","country":"', country, '"}},"skills":', {_SKILLS.format('[{"name":"js"},{"name":"spark_sql"}]')}, '}}')""",
)

_SCHEMA = {
    "type": "object",
    "required": ["id", "segment"],
    "properties": {"id": {"type": "integer", "maximum": 100}, "segment": {"type": "string", "enum": ["building", "machinery", "household"]}, "skills": {"type": "array", "minItems": 1, "items": {"type": "object", "properties": {"name": {"type": "string", "minLength": 3}}}}},
}


@add(_E + """
, x AS (SELECT id, unnest([CASE WHEN segment IS NULL THEN '$ required' END, CASE WHEN id > 100 THEN '$.id maximum' END, CASE WHEN segment NOT IN ('building', 'machinery', 'household') THEN '$.segment enum' END,
    CASE WHEN NOT skilled THEN '$.skills minItems' END, CASE WHEN skilled THEN '$.skills.0.name minLength' END]) AS e FROM e)
SELECT id, coalesce(string_agg(e, '|' ORDER BY e), '') AS found FROM x GROUP BY id""")
def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"on_missing": "omit", "fields": [{"path": "id"}, {"path": "segment"}, {"path": "skills", "fields": [{"path": "name"}]}]}
    out = validate(project(frame(spark, sf_dir, _ENTITY), config), "output", _SCHEMA)
    shown = F.transform("schema_errors", lambda e: F.concat_ws(" ", e["path"], e["validator"]))
    return out.select("id", F.array_join(F.array_sort(shown), "|").alias("found"))


@add(_E + f"""
SELECT id, concat('{{"id":', id, coalesce(',"segment":"' || segment || '"', ''), ',"skills":', {_SKILLS.format('[{"name":"js"},{"name":"spark_sql"}]')}, '}}') AS output,
  (CASE WHEN segment IS NULL THEN 1 ELSE 0 END + CASE WHEN id > 100 THEN 1 ELSE 0 END + CASE WHEN segment NOT IN ('building', 'machinery', 'household') THEN 1 ELSE 0 END + 1)::INTEGER AS n_errors FROM e""")
def output_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"on_missing": "omit", "fields": [{"path": "id"}, {"path": "segment"}, {"path": "skills", "fields": [{"path": "name"}]}]}
    out = generate_output(frame(spark, sf_dir, _ENTITY), config, _SCHEMA)
    return out.select("id", "output", F.size("schema_errors").alias("n_errors"))

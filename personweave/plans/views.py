"""Raw records derived from the driver's tables, in SQL that Spark and DuckDB both read, and helpers for the queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _k(expr: str) -> str:
    return f"cast({expr} as string)"



VIEWS: dict[str, str] = {
    # one delimited row a person
    "v_crm": f"""
SELECT c_custkey AS k, {_k("c_custkey")} AS entity_key, concat('crm-', {_k("c_custkey")}) AS uid,
  concat('  cust', chr(cast(97 + c_custkey % 26 as int)), '  ', CASE WHEN c_custkey % 3 = 0 THEN 'VAN ' ELSE '' END, lower(replace(n_name, '_', ''))) AS full_name,
  CASE WHEN c_custkey % 11 = 0 THEN 'not-an-address'
       WHEN c_custkey % 4 = 0 THEN concat('User', {_k("c_custkey")}, '@Mail', {_k("c_custkey % 5")}, '.Example.com; alt', {_k("c_custkey")}, '@other.example.org')
       ELSE concat(' USER', {_k("c_custkey")}, '@mail', {_k("c_custkey % 5")}, '.example.com ') END AS email,
  CASE c_custkey % 5 WHEN 0 THEN concat('(212) 555-', lpad({_k("c_custkey % 10000")}, 4, '0'))
       WHEN 1 THEN concat('+1 415-555-', lpad({_k("c_custkey % 10000")}, 4, '0'))
       WHEN 2 THEN concat('+44 20 7946 0', lpad({_k("c_custkey % 1000")}, 3, '0'))
       WHEN 3 THEN '123-45' ELSE concat('617.555.', lpad({_k("c_custkey % 10000")}, 4, '0')) END AS phone,
  CASE c_custkey % 3 WHEN 0 THEN concat(n_name, ', ', substr(r_name, 1, 2), ', US')
       WHEN 1 THEN concat('City ', {_k("c_custkey % 50")}, ' , ', n_name) ELSE r_name END AS location,
  CASE c_custkey % 4 WHEN 0 THEN concat('js|Python| ', lower(c_mktsegment)) WHEN 1 THEN 'JS; node-js ;Postgres;; js'
       WHEN 2 THEN 'reactjs, data_engineering, postgres' ELSE '' END AS skills,
  concat('Acme ', {_k("c_custkey % 20")}, CASE c_custkey % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', LLC' ELSE '' END) AS company,
  CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE concat('Engineer ', {_k("c_custkey % 3")}) END AS title,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('Works in ', lower(c_mktsegment), ' . Since ', {_k("1990 + c_custkey % 30")}, '.') END AS summary,
  concat('https://github.com/user', {_k("c_custkey")}, '/') AS github_url,
  CASE WHEN c_custkey % 2 = 0 THEN concat('https://www.linkedin.com/in/u', {_k("c_custkey")}) ELSE concat('http://site', {_k("c_custkey % 9")}, '.example.com/') END AS website
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    # the latest order of each person
    "v_last": """
SELECT o_custkey AS k, max(o_orderkey) AS last_order, count(*) AS n_orders, max(o_totalprice) AS top_price FROM {orders} GROUP BY o_custkey""",
    # a nested JSON export
    "v_ats": f"""
SELECT k, {_k("k")} AS entity_key, last_order,
  concat('{{{{"id":', {_k("last_order")}, ',"first_name":"Cust', chr(cast(97 + k % 26 as int)), '","last_name":" N', {_k("k % 4")}, ' ",',
    '"email_addresses":[{{{{"value":"user', {_k("k")}, '@mail', {_k("k % 5")}, '.example.com","type":"Work"}}}},{{{{"value":"ats', {_k("k")}, '@jobs.example.com","type":"home"}}}},null],',
    '"phone_numbers":[{{{{"value":"415-555-', lpad({_k("k % 10000")}, 4, '0'), '","type":"cell"}}}}],',
    '"addresses":[{{{{"value":"City ', {_k("k % 50")}, ', CA, US","type":"home"}}}}],"tags":["Python"," node_js ","sql',  {_k("n_orders % 3")}, '"],',
    '"website_addresses":[{{{{"value":"https://github.com/user', {_k("k")}, '"}}}}],"application":{{{{"current_employer":"Acme ', {_k("k % 20")}, ' Ltd","current_title":"Lead"}}}}}}}}') AS payload
FROM ({{v_last}})""",
    # skills seen by a repository host
    "v_api": f"""
SELECT user_id AS k, {_k("user_id")} AS entity_key, event_id AS ord, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS name,
  concat('repo', {_k("event_id % 3")}) AS context FROM {{events}}""",
    # notes of a person
    "v_notes": f"""
SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0
    THEN concat('Summary: Solid ', lower(c_mktsegment), ' person.', chr(10), 'Keywords: sql, Spark ; SQL | c++', chr(10), 'Observations: prefers teams; - calm -')
    ELSE concat('Strong candidate with leadership in ', lower(c_mktsegment), '. Noted for Problem Solving and C++ work! Uses node.js, spark-sql and R2', {_k("c_custkey % 4")}, '. No concern? ', CASE WHEN c_custkey % 2 = 0 THEN 'Good teamwork.' ELSE 'Good TEAMWORK too' END) END AS text
FROM {{customer}}""",
    # a sectioned text of a person
    "v_resume": f"""
SELECT c_custkey AS k, concat('Jane Q', chr(cast(97 + c_custkey % 26 as int)), ' Roe', chr(10), 'jane', {_k("c_custkey")}, '@mail.example.com | (212) 555-', lpad({_k("c_custkey % 10000")}, 4, '0'), chr(10),
  'https://github.com/jane', {_k("c_custkey")}, '.', chr(10), chr(10),
  '=== Professional Summary ===', chr(10), 'Builds ', lower(c_mktsegment), ' systems.', chr(10), chr(10),
  'SKILLS:', chr(10), 'Languages: Python, SQL; Go', chr(10), 'Tools', chr(10), '- Spark | 42 | sql', chr(10), chr(10),
  'Work Experience', chr(10), 'Senior Engineer', chr(10), 'Acme ', {_k("c_custkey % 20")}, ', Inc', chr(10), 'Jan ', {_k("2000 + c_custkey % 10")}, ' - Mar ', {_k("2012 + c_custkey % 8")}, chr(10),
  '- Cut cost by ', {_k("c_custkey % 90")}, '%', chr(10), '- Wrote code', chr(10), chr(10), 'Analyst | Beta ', {_k("c_custkey % 3")}, ' | 2019 - Present', chr(10), '• Ran reports', chr(10), chr(10),
  'Education', chr(10), 'State University ', {_k("c_custkey % 6")}, chr(10), 'Bachelor of Science in Physics', chr(10), '2004 - 2008', chr(10), 'GPA: 3.', {_k("c_custkey % 10")}, ' / 4.0', chr(10), chr(10),
  'Projects', chr(10), 'Line Tool | Python, Redis', chr(10), '- Built a parser with docker', chr(10), 'and more', chr(10), 'Project', chr(10), 'Tech: Spark, go', chr(10)) AS text, lower(c_mktsegment) AS segment
FROM {{customer}}""",
    # records of three sources in one shape; names in parts come from the second source alone
    "v_rec": f"""
SELECT entity_key, 0 AS src_ord, 'csv' AS source_type, concat('csv:', entity_key) AS source_id, full_name, cast(null as string) AS first_name, cast(null as string) AS last_name,
  email, phone, skills, location, company, title, summary, github_url AS url FROM ({{v_crm}})
UNION ALL
SELECT {_k("k")}, 1, 'ats_json', concat('ats:', {_k("last_order")}), cast(null as string), concat('cust', chr(cast(97 + k % 26 as int))), CASE WHEN k % 2 = 0 THEN concat('nation', {_k("k % 25")}) ELSE 'Other' END,
  concat('user', {_k("k")}, '@mail', {_k("k % 5")}, '.example.com;ats', {_k("k")}, '@jobs.example.com'), concat('(212) 555-', lpad({_k("k % 10000")}, 4, '0')),
  concat('Python;node_js;sql', {_k("n_orders % 3")}), concat('City ', {_k("k % 50")}, ', CA, US'), concat('Acme ', {_k("k % 20")}, ' Ltd'), 'Engineer 1', 'Ordered before.', concat('https://github.com/user', {_k("k")})
FROM ({{v_last}})
UNION ALL
SELECT {_k("user_id")}, 2, 'github', concat('github:u', {_k("user_id")}), cast(null as string), concat('Cust', chr(cast(97 + user_id % 26 as int))), 'Handle',
  concat('user', {_k("user_id")}, '@mail', {_k("user_id % 5")}, '.example.com'), '', concat('python;', CASE WHEN count(*) > 10 THEN 'Postgres' ELSE 'click' END), '', '', '', concat('Seen ', {_k("count(*)")}, ' times.'), concat('https://github.com/user', {_k("user_id")}, '/')
FROM {{events}} GROUP BY user_id""",
}


def _expand(sql: str, tables: dict[str, str]) -> str:
    """Views replaced by their text, then table names."""
    names = dict(tables)
    for name, text in VIEWS.items():
        names[name] = text.format(**names) if "{" in text else text
    return sql.format(**names)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over tables and views in braces, or the view or table of that name."""
    if re.fullmatch(r"\w+", sql):
        sql = VIEWS[sql] if sql in VIEWS else f"SELECT * FROM {{{sql}}}"
    return spark.sql(_expand(sql, {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


class Catalog:
    """Queries with their DuckDB SQL, in which views stand by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = with_views(sql)
            return f

        return keep


def with_views(sql: str) -> str:
    """The SQL with a CTE for each view that it names."""
    plain = {t: t for t in TABLES}
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = [f"{v} AS ({_expand(VIEWS[v], plain).strip()})" for v in used]
    sql = sql.strip()
    if not ctes:
        return sql
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + sql


# DuckDB forms of expressions that several queries share


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"regexp_replace({sql_trim(x)}, '\\s+', ' ', 'g')"


def sql_title_words(x: str) -> str:
    return f"array_to_string(list_transform(string_split({sql_collapse(x)}, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')"


def sql_title_letters(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '([A-Za-z]+|[^A-Za-z]+)', 1), lambda w: concat(upper(w[1]), lower(w[2:]))), '')"


def sql_split(x: str) -> str:
    cut = f"CASE WHEN contains({x}, '|') THEN string_split({x}, '|') WHEN contains({x}, ';') THEN string_split({x}, ';') ELSE string_split({x}, ',') END"
    return f"list_filter(list_transform({cut}, lambda w: trim(w)), lambda w: w <> '')"


def sql_skill(x: str) -> str:
    from ..functions.profile import SKILL_ALIASES

    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SKILL_ALIASES.items())
    clean = f"regexp_replace(trim({x}), '[_-]', ' ', 'g')"
    return f"CASE lower(trim({x})) {cases} ELSE {sql_title_letters(clean)} END"


def sql_is_email(x: str) -> str:
    return f"regexp_matches(lower(trim({x})), '^[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{{2,}}$')"


#: E.164 of the shapes of numbers in the views; null for others.
def sql_e164(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return (
        f"CASE WHEN starts_with(trim({x}), '+44') THEN concat('+', {d}) WHEN starts_with(trim({x}), '+1') AND regexp_matches({d}, '^1[2-9][0-9][0-9][2-9][0-9]{{6}}$') THEN concat('+', {d}) "
        f"WHEN NOT starts_with(trim({x}), '+') AND regexp_matches({d}, '^[2-9][0-9][0-9][2-9][0-9]{{6}}$') THEN concat('+1', {d}) END"
    )

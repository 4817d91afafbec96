"""Queries of normalisation, merging, conflict resolution, scoring and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact, dates, profile, text
from ..functions.ids import uuid5
from ..operators import lineage, merge, normalize, resolve, score
from ..schemas import EDUCATION, ROLES, SKILLS, extracted, record
from ..sources import csv
from .pipeline import fuse
from .views import Catalog, frame, sql_e164, sql_is_email, sql_skill, sql_split, sql_title_words

catalog = Catalog()
add = catalog.add
AS_OF = "2024-01-01"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted records of the three sources, dealt by entity while they are raw; a repository host's skills are inferred."""
    df = merge.spread(frame(spark, sf_dir, "v_rec"))
    cells = {c: text.blank_to_null(F.col(n)) for c, n in (("full_name", "full_name"), ("first_name", "first_name"), ("last_name", "last_name"), ("email", "email"), ("phone", "phone"), ("skills", "skills"), ("location", "location"), ("current_company", "company"), ("current_title", "title"), ("summary", "summary"), ("github_url", "url"))}
    made = csv.fields(cells)
    host = F.col("source_type") == "github"
    inferred = F.transform(made["skills"], lambda s: s.withField("is_inferred", F.lit(True)).withField("github_occurrence_count", F.when(s["name"] == "python", F.lit(2)).otherwise(F.lit(1)).cast("bigint")))
    made["skills"] = F.when(host, inferred.cast(SKILLS)).otherwise(made["skills"].cast(SKILLS))
    return extracted(df, entity_key="entity_key", src_ord="src_ord", source_type="source_type", source_id="source_id", **made)


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(records(spark, sf_dir), AS_OF, with_logs=False)


def _votes(is_skill: bool) -> str:
    return "VALUES " + ", ".join(f"('{s}', '{m}', {v!r}, {w!r})" for s, m, v, w in score.Formula().votes(is_skill) if s and m)


_KEY = "regexp_replace(trim(lower({0})), '\\s+', ' ', 'g')"
_PARTS = f"string_split({sql_title_words('full_name')}, ' ')"
_METHOD = "CASE source_type WHEN 'github' THEN 'api_response' ELSE 'structured_field' END"
_COMPANY = "trim(regexp_replace(company, '(?i)\\b(inc|llc|ltd|corp|corporation|pvt|private|limited)\\b\\.?', '', 'g'), ' ,')"
_LOC = "list_transform(string_split(location, ','), lambda p: trim(p))"

#: The stages of the fusion over v_rec, as CTEs.
BASE = f"""
WITH n AS (SELECT *, {_METHOD} AS method,
    CASE WHEN first_name IS NULL AND last_name IS NULL THEN {_PARTS}[1] ELSE {sql_title_words("first_name")} END AS n_first,
    CASE WHEN first_name IS NULL AND last_name IS NULL AND len({_PARTS}) > 2 THEN array_to_string({_PARTS}[2:-2], ' ') END AS n_middle,
    CASE WHEN first_name IS NULL AND last_name IS NULL THEN CASE WHEN len({_PARTS}) > 1 THEN {_PARTS}[-1] END ELSE {sql_title_words("last_name")} END AS n_last,
    nullif(trim(summary), '') AS n_summary FROM v_rec),
sc AS (SELECT entity_key, src_ord, source_type, source_id, method, f.field, CASE f.field WHEN 'first_name' THEN n_first WHEN 'middle_name' THEN n_middle WHEN 'last_name' THEN n_last WHEN 'summary' THEN n_summary
         ELSE array_to_string(list_filter([{_LOC}[1], CASE WHEN len({_LOC}[2]) <= 3 THEN upper({_LOC}[2]) ELSE {_LOC}[2] END, CASE WHEN len({_LOC}[3]) = 2 THEN upper({_LOC}[3]) ELSE {_LOC}[3] END], lambda x: x IS NOT NULL AND x <> ''), ', ') END AS value
       FROM n, (VALUES ('first_name'), ('middle_name'), ('last_name'), ('summary'), ('location')) f(field)),
opt AS (SELECT entity_key, field, {_KEY.format("value")} AS item_key, arg_max(value, src_ord) AS value, max(src_ord) AS newest, list(struct_pack(source_type := source_type, source_id := source_id, method := method) ORDER BY src_ord) AS p,
          string_agg(source_type, '|' ORDER BY src_ord) AS sources FROM sc WHERE value IS NOT NULL AND value <> '' GROUP BY entity_key, field, {_KEY.format("value")}),
rk AS (SELECT *, row_number() OVER (PARTITION BY entity_key, field ORDER BY 1 DESC, newest DESC, lower(value) DESC) AS r, count(*) OVER (PARTITION BY entity_key, field) - 1 AS n_conflicts FROM opt),
res AS (SELECT entity_key, field, value, n_conflicts, p, sources FROM rk WHERE r = 1),
em AS (SELECT entity_key, src_ord, source_type, source_id, method, i AS item_ord, lower(a[i]) AS item_key, lower(a[i]) AS item, FALSE AS inferred, 1 AS evidence, TRUE AS ok
       FROM (SELECT *, list_filter({sql_split("email")}, lambda x: {sql_is_email("x")}) AS a FROM n), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)),
ph AS (SELECT entity_key, src_ord, source_type, source_id, method, i AS item_ord, coalesce({sql_e164("a[i]")}, regexp_replace(a[i], '[^0-9]', '', 'g')) AS item_key, a[i] AS item, FALSE AS inferred, 1 AS evidence, {sql_e164("a[i]")} IS NOT NULL AS ok
       FROM (SELECT *, {sql_split("phone")} AS a FROM n), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)),
s0 AS (SELECT entity_key, src_ord, source_type, source_id, CASE WHEN source_type = 'github' THEN 'inferred' ELSE method END AS method, i AS item_ord, {sql_skill("a[i]")} AS item, source_type = 'github' AS inferred,
         CASE WHEN source_type = 'github' AND a[i] = 'python' THEN 2 ELSE 1 END AS evidence, TRUE AS ok FROM (SELECT *, {sql_split("skills")} AS a FROM n), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)),
sk AS (SELECT entity_key, src_ord, source_type, source_id, method, item_ord, {_KEY.format("item")} AS item_key, item, inferred, evidence, ok FROM (SELECT *, row_number() OVER (PARTITION BY entity_key, src_ord, lower(item) ORDER BY item_ord) AS d FROM s0) WHERE d = 1),
ex AS (SELECT entity_key, src_ord, source_type, source_id, method, 1 AS item_ord, {_KEY.format(f"concat_ws('|', {_COMPANY}, coalesce(nullif(trim(title), ''), 'Unknown'), 'None')")} AS item_key, {_COMPANY} AS item, FALSE AS inferred, 1 AS evidence, TRUE AS ok FROM n WHERE company <> ''),
pr AS (SELECT entity_key, src_ord, source_type, source_id, method, 1 AS item_ord, lower(concat('github:', regexp_replace(url, '/+$', ''))) AS item_key, regexp_replace(url, '/+$', '') AS item, FALSE AS inferred, 1 AS evidence, TRUE AS ok FROM n),
every AS (SELECT 'emails' AS family, * FROM em UNION ALL SELECT 'phones', * FROM ph UNION ALL SELECT 'skills', entity_key, src_ord, source_type, source_id, method, item_ord, item_key, item, inferred, evidence, ok FROM sk
          UNION ALL SELECT 'experience', * FROM ex UNION ALL SELECT 'profiles', * FROM pr),
mi AS (SELECT entity_key, family, item_key, arg_min(item, src_ord * 1000 + item_ord) AS item, arg_min(inferred, src_ord * 1000 + item_ord) AS inferred, arg_min(ok, src_ord * 1000 + item_ord) AS ok, max(evidence)::BIGINT AS evidence,
         list(struct_pack(source_type := source_type, source_id := source_id, method := method) ORDER BY src_ord, item_ord) AS p, string_agg(source_type, '|' ORDER BY src_ord, item_ord) AS sources FROM every WHERE item_key <> '' GROUP BY ALL),
v AS (SELECT FALSE AS skill, * FROM ({_votes(False)}) t(s, m, good, bad) UNION ALL SELECT TRUE, * FROM ({_votes(True)}) t(s, m, good, bad)),
pi AS (SELECT entity_key, family, item_key, item, inferred, ok, evidence, sources, unnest(p) AS x FROM mi),
vi AS (SELECT entity_key, family, item_key, any_value(item) AS item, any_value(inferred) AS inferred, any_value(evidence) AS evidence, max(CASE WHEN ok THEN good ELSE bad END) AS base, count(DISTINCT concat(x.source_type, x.source_id)) AS n,
         bool_or(x.source_type = 'github') AS gh, bool_or(x.source_type <> 'github') AS other FROM pi JOIN v ON v.s = x.source_type AND v.m = x.method AND v.skill = (family = 'skills') GROUP BY entity_key, family, item_key),
c1 AS (SELECT *, greatest(0, least(1, round(base + least((n - 1) * 0.04::DOUBLE, 0.12::DOUBLE), 4))) AS c FROM vi),
c2 AS (SELECT * REPLACE (CASE WHEN family = 'skills' AND inferred AND NOT (gh AND other) THEN least(c, 0.7::DOUBLE) ELSE c END AS c) FROM c1),
c3 AS (SELECT * REPLACE (CASE WHEN gh AND other THEN greatest(0, least(1, round(c + 0.1::DOUBLE, 4))) ELSE c END AS c) FROM c2),
items AS (SELECT * REPLACE (CASE WHEN family = 'skills' AND gh AND evidence > 1 THEN greatest(0, least(1, round(c + 0.05::DOUBLE, 4))) ELSE c END AS c) FROM c3),
ps AS (SELECT entity_key, field, n_conflicts, unnest(p) AS x FROM res),
vs AS (SELECT entity_key, field, any_value(n_conflicts) AS n_conflicts, max(good) AS base, count(DISTINCT concat(x.source_type, x.source_id)) AS n, bool_or(x.source_type = 'github') AS gh, bool_or(x.source_type <> 'github') AS other
       FROM ps JOIN v ON v.s = x.source_type AND v.m = x.method AND NOT v.skill WHERE NOT (x.source_type = 'github' AND field LIKE '%_name') GROUP BY entity_key, field),
ss AS (SELECT entity_key, field, CASE WHEN gh AND other THEN greatest(0, least(1, round(c + 0.1::DOUBLE, 4))) ELSE c END AS c
       FROM (SELECT *, greatest(0, least(1, round(base + least((n - 1) * 0.04::DOUBLE, 0.12::DOUBLE) - n_conflicts * 0.08::DOUBLE, 4))) AS c FROM vs)),
fld AS (SELECT r.entity_key, r.field, coalesce(ss.c, 0)::DOUBLE AS c FROM res r LEFT JOIN ss ON r.entity_key = ss.entity_key AND r.field = ss.field
        UNION ALL SELECT entity_key, family, CASE WHEN family IN ('emails', 'phones') THEN max(c) ELSE list_sum(list(c ORDER BY item_key)) / count(*) END FROM items GROUP BY entity_key, family),
w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in {**score.Formula().importance, "middle_name": 0.25}.items())}) t(field, weight)),
ov AS (SELECT entity_key, greatest(0, least(1, round(sum(c * weight) / sum(weight), 4)))::DOUBLE AS overall FROM fld JOIN w USING (field) GROUP BY entity_key)
"""


def _join(c: Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def _sources(p: Column) -> Column:
    return _join(F.transform(p, lambda x: x["source_type"]))


# normalisation


@add(f"SELECT k, {sql_e164('phone')} AS e164, {sql_e164('phone')} IS NOT NULL AS is_valid FROM v_crm")
def phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = contact.phone_parts(F.col("phone"))
    return frame(spark, sf_dir, "v_crm").select("k", p["normalized"].alias("e164"), p["is_valid"].alias("is_valid"))


@add(f"""SELECT k, {_PARTS}[1] AS first_name, CASE WHEN len({_PARTS}) > 2 THEN array_to_string({_PARTS}[2:-2], ' ') END AS middle_name, CASE WHEN len({_PARTS}) > 1 THEN {_PARTS}[-1] END AS last_name,
  {sql_title_words("full_name")} AS full_name FROM v_crm""")
def name_split_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")
    made = normalize.names(null, null, null, F.col("full_name"))
    return frame(spark, sf_dir, "v_crm").select("k", *[c.alias(n) for n, c in made.items()])


@add("""SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN concat(s_name, ' Holding') WHEN 2 THEN s_name ELSE concat('Incremental ', s_name) END AS company FROM supplier""")
def company_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN concat(s_name, ' Inc.') WHEN 1 THEN concat(s_name, ' Holding') WHEN 2 THEN concat(s_name, ', Pvt. LTD, ') ELSE concat('Incremental ', s_name, ' LLC') END AS c FROM {supplier}")
    return df.select("k", text.collapse_ws(profile.company(F.col("c"))).alias("company"))


@add(f"SELECT k, array_to_string(list_transform({sql_split('skills')}, lambda x: {sql_skill('x')}), '|') AS names FROM v_crm")
def skill_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "v_crm").select("k", _join(F.transform(text.split_multi(F.col("skills")), lambda s: profile.skill_name(s))).alias("names"))


@add(f"""SELECT k, {_LOC}[1] AS city, CASE WHEN len({_LOC}[2]) > 3 THEN {_LOC}[2] END AS state, CASE WHEN len({_LOC}[2]) <= 3 THEN upper({_LOC}[2]) END AS state_code,
  CASE WHEN len({_LOC}[3]) <> 2 THEN {_LOC}[3] END AS country, CASE WHEN len({_LOC}[3]) = 2 THEN upper({_LOC}[3]) END AS country_code FROM v_crm""")
def location_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "v_crm").select("k", profile.parse_location(F.col("location")).alias("p")).select("k", "p.*")


@add("""SELECT o_orderkey AS k, greatest(0, CASE o_orderkey % 3 WHEN 0 THEN (2024 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) WHEN 1 THEN 30 ELSE 0 END)::INTEGER AS months, o_orderkey % 3 = 0 AS is_current FROM orders""")
def duration_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "SELECT o_orderkey AS k, cast(o_orderdate as date) AS s, CASE o_orderkey % 3 WHEN 1 THEN add_months(cast(o_orderdate as date), 30) WHEN 2 THEN add_months(cast(o_orderdate as date), -5) END AS e, CASE o_orderkey % 3 WHEN 0 THEN ' Present' ELSE 'x' END AS raw_end FROM {orders}")
    current = dates.is_current(F.col("raw_end"))
    return df.select("k", dates.duration_months(F.col("s"), F.col("e"), current, F.lit(AS_OF).cast("date")).alias("months"), current.alias("is_current"))


@add(f"""
WITH e AS (SELECT k, {sql_split("email")} AS m, {sql_split("skills")} AS s, phone, location FROM v_crm)
SELECT k, (len(m) + 1 + 1 + 1 + len(s) + 1)::BIGINT AS n_logs, concat_ws('|', CASE WHEN {sql_e164("phone")} IS NULL THEN 'phones[0]' END) AS failed FROM e""")
def norm_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "v_crm")
    cells = {n: text.blank_to_null(F.col(c)) for n, c in (("full_name", "full_name"), ("email", "email"), ("phone", "phone"), ("location", "location"), ("skills", "skills"), ("current_company", "company"), ("current_title", "title"))}
    # all addresses go on, so that the normaliser meets invalid ones too
    made = csv.fields(cells)
    made["emails"] = F.transform(text.split_multi(cells["email"]), lambda a: F.struct(a.alias("address"), F.lit("unknown").alias("type"), F.lit(False).alias("is_primary"), F.lit(None).cast("string").alias("domain")))
    out = normalize.normalize(extracted(df, entity_key=F.col("k"), **made), AS_OF)
    failed = F.filter(normalize.failed(F.col("normalization_logs")), lambda x: x["normalizer"] == "PhoneNormalizer")
    return out.select(F.col("entity_key").cast("bigint").alias("k"), F.size("normalization_logs").cast("bigint").alias("n_logs"), _join(F.transform(failed, lambda x: x["field"])).alias("failed"))


@add("""SELECT p_partkey AS k, CASE WHEN p_size % 5 <= 4 AND p_size / 10.0 > CASE p_size % 2 WHEN 0 THEN 4 ELSE 2 END THEN 0 ELSE 1 END::BIGINT AS n_kept, CASE WHEN p_size / 10.0 > CASE p_size % 2 WHEN 0 THEN 4 ELSE 2 END THEN 1 ELSE 0 END::BIGINT AS n_warnings FROM part""")
def gpa_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "part")
    item = record(EDUCATION, institution=F.col("p_name"), gpa=F.col("p_size") / 10.0, gpa_scale=F.when(F.col("p_size") % 2 != 0, F.lit(2.0)))
    kept, warnings = normalize.check_gpa(F.array(item))
    return df.select(F.col("p_partkey").alias("k"), F.size(kept).cast("bigint").alias("n_kept"), F.size(warnings).cast("bigint").alias("n_warnings"))


@add(f"""
SELECT k, nullif(trim(summary), '') AS summary, concat(CASE WHEN trim(title) = '' THEN 'Unknown' ELSE title END, '@', company) AS role, array_to_string(list_transform({sql_split("skills")}, lambda x: concat('csv:skills_column:', x)), '|') AS contexts,
  concat('github:https://github.com/user', k::VARCHAR, CASE WHEN k % 2 = 0 THEN '|linkedin:' ELSE '|other:' END, regexp_replace(website, '/+$', '')) AS links, location, phone FROM v_crm""")
def crm_populate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "SELECT k, summary, title, company, skills, github_url AS github, website, location, phone FROM ({v_crm})")
    made = csv.fields(csv.canonical(df.drop("k")))
    rows = df.select("k", *[c.alias(n) for n, c in made.items()])
    role = F.col("experience")[0]
    return rows.select(
        "k", "summary", F.concat_ws("@", role["title"], role["company"]).alias("role"), _join(F.transform("skills", lambda s: s["source_context"])).alias("contexts"),
        _join(F.transform("profiles", lambda p: F.concat_ws(":", p["platform"], p["url"]))).alias("links"), F.col("location")["raw"].alias("location"), F.col("phones")[0]["raw"].alias("phone"),
    )


# merging


@add(BASE + "SELECT entity_key, field, item_key, value, sources FROM opt WHERE field <> 'location'")
def merge_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_scalars(normalized(spark, sf_dir)).select("entity_key", "field", "item_key", "value", _sources(F.col("provenance")).alias("sources"))


@add(BASE + "SELECT entity_key, item_key, value AS shown, sources FROM opt WHERE field = 'location'")
def merge_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.merge_locations(normalized(spark, sf_dir))
    return out.select("entity_key", "item_key", profile.location_display(F.col("value")).alias("shown"), _sources(F.col("provenance")).alias("sources"))


def _family(name: str, shown: str, more: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = merge.merge_list(normalized(spark, sf_dir), name)
        extra = [F.col("item.github_occurrence_count").alias("evidence")] if more else []
        return out.select("entity_key", "item_key", F.col(f"item.{shown}").alias("item"), _sources(F.col("provenance")).alias("sources"), *extra)

    run.__name__ = f"merge_{name}"
    add(BASE + f"SELECT entity_key, item_key, item, sources{more} FROM mi WHERE family = '{name}'")(run)


_family("emails", "address")
_family("phones", "raw")
_family("skills", "name", ", evidence")
_family("experience", "company")
_family("profiles", "url")


@add("""
WITH p AS (SELECT p_brand AS entity_key, p_partkey, concat('Tool ', (p_size % 4)::VARCHAR) AS title, CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('20', lpad((p_size % 30)::VARCHAR, 2, '0')) END AS raw FROM part)
SELECT entity_key, concat('personal project|', lower(title), '|', coalesce(raw, 'none')) AS item_key, arg_min(CASE WHEN p_partkey % 2 = 0 THEN upper(title) ELSE title END, p_partkey) AS title, count(*)::BIGINT AS n FROM p GROUP BY entity_key, title, raw""")
def merge_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "part")
    title = F.concat(F.lit("Tool  "), (F.col("p_size") % 4).cast("string"))
    raw = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("20"), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0")))
    item = record(ROLES, company=F.lit("Personal Project"), title=F.when(F.col("p_partkey") % 2 == 0, F.upper(title)).otherwise(title), raw_start=raw)
    rows = extracted(df, entity_key=F.col("p_brand"), src_ord=F.col("p_partkey"), source_type=F.lit("csv"), source_id=F.col("p_name"), projects=F.array(item))
    out = merge.merge_list(merge.spread(rows), "projects")
    return out.select("entity_key", "item_key", text.collapse_ws(F.col("item.title")).alias("title"), F.size("provenance").cast("bigint").alias("n"))


@add("""
SELECT s_nationkey::VARCHAR AS entity_key, lower(concat('uni ', (s_suppkey % 3)::VARCHAR, '|bsc ', (s_suppkey % 2)::VARCHAR, '|')) AS item_key, concat('Uni ', (min(s_suppkey) % 3)::VARCHAR) AS institution, count(*)::BIGINT AS n
FROM supplier GROUP BY s_nationkey, s_suppkey % 3, s_suppkey % 2""")
def merge_education(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "supplier")
    item = record(EDUCATION, institution=F.concat(F.lit("Uni "), (F.col("s_suppkey") % 3).cast("string")), degree=F.concat(F.lit("BSc  "), (F.col("s_suppkey") % 2).cast("string")))
    rows = extracted(df, entity_key=F.col("s_nationkey"), src_ord=F.col("s_suppkey"), source_type=F.lit("csv"), source_id=F.col("s_name"), education=F.array(item))
    out = merge.merge_list(merge.spread(rows), "education")
    return out.select("entity_key", "item_key", F.col("item.institution").alias("institution"), F.size("provenance").cast("bigint").alias("n"))


_UUID = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({0}))"


def _sql_uuid(x: str) -> str:
    h = _UUID.format(x)
    variant = f"substr('89ab', ((strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) & 3) + 1, 1)"
    return f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-', {variant}, substr({h}, 18, 3), '-', substr({h}, 21, 12))"


@add(f"SELECT c_custkey AS k, {_sql_uuid('c_name')} AS id FROM customer")
def candidate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), uuid5(F.col("c_name")).alias("id"))


@add(BASE + f"""
, f AS (SELECT n.entity_key, arg_min(em.item, em.src_ord * 1000 + em.item_ord) AS mail, arg_min(regexp_replace(n.url, '/+$', ''), n.src_ord) AS url FROM n LEFT JOIN em ON em.entity_key = n.entity_key GROUP BY n.entity_key),
o AS (SELECT entity_key, string_agg(source_id, '|' ORDER BY src_ord) AS merged_from FROM n GROUP BY entity_key)
SELECT f.entity_key, {_sql_uuid("coalesce(mail, url)")} AS candidate_id, merged_from FROM f JOIN o ON f.entity_key = o.entity_key""")
def merged_from_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.candidate_ids(normalized(spark, sf_dir))
    return out.select("entity_key", "candidate_id", _join("merged_from").alias("merged_from"))


@add(BASE + """
, p AS (SELECT entity_key, field, len(string_split(sources, '|')) AS n FROM opt UNION ALL SELECT entity_key, family, len(string_split(sources, '|')) FROM mi)
SELECT entity_key, field, sum(n)::BIGINT AS n FROM p GROUP BY entity_key, field""")
def provenance_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.merge(normalized(spark, sf_dir), co_partition=False)
    return out.select("entity_key", F.explode(merge.flat_provenance(out)).alias("field", "p")).select("entity_key", "field", F.size("p").cast("bigint").alias("n"))


@add("""
SELECT c_custkey AS k, concat_ws('|', concat('name:', c_name, ':0.9'), CASE WHEN c_custkey % 3 <> 0 THEN concat('segment:', c_mktsegment, ':1.0') END) AS records, CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_lineage FROM customer""")
def lineage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    made = [lineage.record("name", F.col("c_name"), "csv", F.col("c_name"), confidence=0.9), lineage.record("segment", segment, "csv", F.col("c_name"), confidence=7.0)]
    shown = F.transform(lineage.batch(made), lambda x: F.concat_ws(":", x["field"], x["value"], x["confidence"].cast("string")))
    return df.select(F.col("c_custkey").alias("k"), _join(shown).alias("records"), F.size(lineage.confidence_field(segment, made[1])["provenance"]).cast("bigint").alias("n_lineage"))


# resolution and scoring


@add(BASE + "SELECT entity_key, field, value, n_conflicts::BIGINT AS n_conflicts FROM res")
def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (*merge.SCALARS, "location")
    out = resolve.resolve(merge.merge(normalized(spark, sf_dir), co_partition=False, fields=names))
    shown = {n: profile.location_display(F.col("location")["value"]) if n == "location" else F.col(n)["value"] for n in names}
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.when(F.col(n).isNotNull(), shown[n]).alias("value"), F.size(F.col(n)["conflicts"]).cast("bigint").alias("n_conflicts")) for n in names])
    return out.select("entity_key", F.explode(each).alias("x")).select("entity_key", "x.*").where("value IS NOT NULL")


_ROLES = """SELECT o_custkey AS k, o_orderkey AS n, CASE WHEN o_orderkey % 5 <> 0 THEN cast(o_orderdate as date) END AS start,
  concat(CASE o_orderkey % 3 WHEN 0 THEN 'ACME ' WHEN 1 THEN 'acme ' ELSE 'Beta ' END, cast(o_orderkey % 7 as string)) AS company, CASE WHEN o_orderkey % 2 = 0 THEN 'LEAD' ELSE 'clerk' END AS title FROM {orders}"""


@add(f"""
WITH r AS ({_ROLES.replace("{orders}", "orders")})
SELECT k, string_agg(concat_ws('/', coalesce(start::VARCHAR, 'undated'), company, title), '|' ORDER BY start IS NULL DESC, start DESC, lower(company) DESC, lower(title) DESC, n) AS roles FROM r GROUP BY k""")
def order_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, _ROLES)
    item = F.struct(F.col("start").alias("start_date"), F.lit(None).cast("string").alias("raw_start"), "company", "title")
    grouped = df.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", item.alias("item")))).alias("roles"))
    shown = F.transform(resolve.order_roles(F.col("roles")), lambda x: F.concat_ws("/", F.coalesce(x["item"]["start_date"].cast("string"), F.lit("undated")), x["item"]["company"], x["item"]["title"]))
    return grouped.select("k", _join(shown).alias("roles"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse([records(spark, sf_dir)], AS_OF, co_partition=False)


@add(BASE + "SELECT entity_key, family, item_key, c::DOUBLE AS confidence FROM items")
def score_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _fused(spark, sf_dir)
    families = ("emails", "phones", "skills", "experience", "profiles")
    row = lambda f: lambda x: F.struct(F.lit(f).alias("family"), x["item_key"].alias("item_key"), x["confidence"].alias("confidence"))
    each = F.concat(*[F.transform(f, row(f)) for f in families])
    return out.select("entity_key", F.explode(each).alias("x")).select("entity_key", "x.*")


@add(BASE + "SELECT entity_key, field, round(c, 6) AS confidence FROM fld")
def score_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("entity_key", F.explode("field_confidences").alias("field", "c")).select("entity_key", "field", F.round("c", 6).alias("confidence"))


@add(BASE + "SELECT entity_key, round(overall, 3) AS overall, overall < 0.9 AS review FROM ov")
def score_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("entity_key", F.round("overall_confidence", 3).alias("overall"), score.needs_review(0.9).alias("review"))


@add(BASE + "SELECT entity_key, string_agg(item, '|' ORDER BY c DESC, item_key) AS names, count(*)::BIGINT AS n FROM items WHERE family = 'skills' GROUP BY entity_key")
def skill_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = score.ranked_skills(F.col("skills"))
    return _fused(spark, sf_dir).select("entity_key", _join(names).alias("names"), F.size(names).cast("bigint").alias("n")).where("n > 0")


@add(BASE + f"""
, e AS (SELECT entity_key, item_key, arg_min(item_ord, src_ord * 1000 + item_ord) AS pos FROM em GROUP BY entity_key, item_key),
f AS (SELECT entity_key, coalesce(min(item_key) FILTER (WHERE pos = 1), min(item_key)) AS mail FROM e GROUP BY entity_key),
g AS (SELECT entity_key, arg_min(item_key, item_key) AS phone FROM mi WHERE family = 'phones' GROUP BY entity_key),
h AS (SELECT entity_key, arg_min(coalesce({sql_e164("item")}, item), item_key) AS phone FROM mi WHERE family = 'phones' GROUP BY entity_key),
d AS (SELECT a.entity_key, concat_ws(' ', a.value, b.value) AS display_name FROM (SELECT * FROM res WHERE field = 'first_name') a LEFT JOIN (SELECT * FROM res WHERE field = 'last_name') b ON a.entity_key = b.entity_key)
SELECT d.entity_key, display_name, f.mail AS primary_email, h.phone AS primary_phone FROM d LEFT JOIN f ON f.entity_key = d.entity_key LEFT JOIN h ON h.entity_key = d.entity_key""")
def primary_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("entity_key", "display_name", "primary_email", "primary_phone")


FUSE_SQL = BASE + """
, e AS (SELECT entity_key, item_key, arg_min(item_ord, src_ord * 1000 + item_ord) AS pos FROM em GROUP BY entity_key, item_key),
f AS (SELECT entity_key, coalesce(min(item_key) FILTER (WHERE pos = 1), min(item_key)) AS mail FROM e GROUP BY entity_key)
SELECT n.entity_key, any_value(a.value) AS first_name, any_value(f.mail) AS primary_email, count(DISTINCT n.source_id)::BIGINT AS n_sources, round(any_value(ov.overall), 3) AS overall
FROM n LEFT JOIN (SELECT * FROM res WHERE field = 'first_name') a ON a.entity_key = n.entity_key LEFT JOIN f ON f.entity_key = n.entity_key LEFT JOIN ov ON ov.entity_key = n.entity_key GROUP BY n.entity_key"""


@add(FUSE_SQL)
def fuse_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _fused(spark, sf_dir)
    return out.select("entity_key", F.col("first_name.value").alias("first_name"), "primary_email", F.size("merged_from").cast("bigint").alias("n_sources"), F.round("overall_confidence", 3).alias("overall"))


#: Queries over all fields of the fused entities.
QUERIES_OF_FUSION = {f.__name__: f for f in (fuse_end_to_end, resolve_conflicts, score_overall, provenance_flat)}

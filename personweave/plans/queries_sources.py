"""Queries of sources, field population and text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact, dates, lines, profile, text
from ..functions.ids import row_hash
from ..sources import base, coerce, csv, json_paths, notes, repo_api, sectioned
from .views import Catalog, frame, sql_collapse, sql_is_email, sql_split, sql_trim

catalog = Catalog()
add = catalog.add


def _join(c, sep: str = "|"):
    return F.array_join(c, sep)


@add(f"""
SELECT k, nullif({sql_trim("full_name")}, '') AS full_name, nullif({sql_trim("email")}, '') AS email, coalesce(nullif({sql_trim("title")}, ''), nullif({sql_trim("company")}, '')) AS current_title,
       nullif({sql_trim("summary")}, '') AS summary FROM v_crm""")
def csv_map_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "SELECT k, full_name AS `Candidate Name`, email AS `E-Mail`, company AS `Role`, title AS ` Job Title `, summary AS `AboutMe` FROM ({v_crm})")
    cells = csv.canonical(df)
    return df.select("k", *[cells[n].alias(n) for n in ("full_name", "email", "current_title", "summary")])


@add("""
WITH o AS (SELECT concat('u', o_custkey::VARCHAR) AS uid, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Name ', o_orderkey::VARCHAR) END AS name,
             concat('m', (o_orderkey % 4)::VARCHAR, '@x.example.com') AS mail, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS about FROM orders),
m AS (SELECT uid, mail, min(ord) AS ord FROM o GROUP BY uid, mail),
e AS (SELECT uid, string_agg(mail, '|' ORDER BY ord) AS emails FROM m GROUP BY uid)
SELECT o.uid AS entity_key, arg_min(name, ord) FILTER (WHERE name IS NOT NULL) AS full_name, arg_min(about, ord) FILTER (WHERE about IS NOT NULL) AS summary, any_value(e.emails) AS emails
FROM o JOIN e ON o.uid = e.uid GROUP BY o.uid""")
def csv_group_by_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, """SELECT o_orderkey, concat('u', cast(o_custkey as string)) AS UID, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE concat('Name ', cast(o_orderkey as string)) END AS fullName,
        concat('m', cast(o_orderkey % 4 as string), '@x.example.com') AS emailAddress, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS aboutMe FROM {orders}""")
    out = csv.grouped(df, F.col("o_orderkey"))
    return out.select("entity_key", "full_name", "summary", _join(F.transform("emails", lambda e: e["address"])).alias("emails"))


@add("""
WITH r AS (SELECT concat('o', l_orderkey::VARCHAR) AS uid, l_linenumber AS n, l_partkey AS p, l_quantity AS q FROM lineitem)
SELECT uid AS entity_key, coalesce(string_agg(concat('Part', (p % 20)::VARCHAR), '|' ORDER BY n, p, q) FILTER (WHERE n % 4 = 1), '') AS skills,
       coalesce(string_agg(concat('School ', (p % 9)::VARCHAR, '/', (p % 5)::VARCHAR), '|' ORDER BY n, p, q) FILTER (WHERE n % 4 = 2 AND p % 5 <= 4), '') AS education,
       coalesce(string_agg(concat('Project ', p::VARCHAR, '/', 'a+b'), '|' ORDER BY n, p, q) FILTER (WHERE n % 4 = 3), '') AS projects,
       count(*) FILTER (WHERE n % 4 = 2 AND p % 7 > 4 AND p % 5 = 9)::BIGINT AS n_warnings
FROM r GROUP BY uid""")
def csv_record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, """SELECT concat('o', cast(l_orderkey as string)) AS uid, struct(l_linenumber, l_partkey, l_quantity) AS ord, CASE l_linenumber % 4 WHEN 1 THEN 'Skill' WHEN 2 THEN 'education' WHEN 3 THEN 'project ' ELSE 'other' END AS record_type,
        concat('Part', cast(l_partkey % 20 as string)) AS technology, concat('School ', cast(l_partkey % 9 as string)) AS institutionName, cast(l_partkey % 5 as string) AS cgpa, '4.0' AS gradingScale,
        concat('Project ', cast(l_partkey as string)) AS projectName, 'a; b;' AS stack FROM {lineitem}""")
    rows = df.select("uid", "ord", "record_type", "technology", "institutionName", "cgpa", "gradingScale", "projectName", "stack")
    typed = csv.typed_row(rows)
    listed = lambda c, s: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(F.col("ord").alias("o"), s.alias("s"))))), lambda x: x["s"]), "|")
    e, p = typed["education"], typed["projects"]
    return rows.groupBy(F.col("uid").alias("entity_key")).agg(
        listed(typed["skills"], typed["skills"]["name"]).alias("skills"),
        listed(e, F.concat(e["institution"], F.lit("/"), e["gpa"].cast("int").cast("string"))).alias("education"),
        listed(p, F.concat(p["title"], F.lit("/"), F.array_join(p["technologies"], "+"))).alias("projects"),
        F.count(F.when(e["gpa"] > 8.5, 1)).alias("n_warnings"),
    )


@add("""
SELECT c_custkey AS k, concat('csv:', substr(sha256(array_to_string(list_sort([concat('c_name=', c_name), concat('c_mktsegment=', c_mktsegment), concat('c_custkey=', c_custkey::VARCHAR)]), '&')), 1, 16)) AS source_id,
       substr(sha256(c_name), 1, 12) AS short_hash FROM customer""")
def row_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "customer")
    columns = {n: F.col(n) for n in ("c_custkey", "c_name", "c_mktsegment")}
    return df.select(F.col("c_custkey").alias("k"), row_hash(columns).alias("source_id"), text.content_hash(F.col("c_name"), 12).alias("short_hash"))


@add("""
SELECT event_id, (props->>'$.k')::BIGINT AS k, CAST(NULL AS VARCHAR) AS absent, concat('v', (event_id % 5)::VARCHAR) AS nested, CASE WHEN event_id % 2 = 0 THEN 'x' END AS listed
FROM events""")
def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "SELECT event_id, props, concat('{{\"a\":{{\"0\":[\"', CASE WHEN event_id % 2 = 0 THEN ' x ' ELSE '' END, '\",{{\"b\":\"v', cast(event_id % 5 as string), '\"}}]}}}}') AS doc FROM {events}")
    v, d = F.try_parse_json("props"), F.try_parse_json("doc")
    return df.select("event_id", json_paths.value_at(v, "k", "bigint").alias("k"), json_paths.scalar_at(v, "a.b.0").alias("absent"), json_paths.scalar_at(d, "a.0.1.b").alias("nested"), json_paths.scalar_at(d, "a.0.0").alias("listed"))


@add(f"""
SELECT k, concat('user', k::VARCHAR, '@mail', (k % 5)::VARCHAR, '.example.com:unknown|ats', k::VARCHAR, '@jobs.example.com:unknown') AS emails,
       concat('415-555-', lpad((k % 10000)::VARCHAR, 4, '0'), ':unknown') AS phones, concat('Python|node_js|sql', (n_orders % 3)::VARCHAR) AS skills,
       concat('Cust', chr(cast(97 + k % 26 as int))) AS first_name, concat('N', (k % 4)::VARCHAR) AS last_name, concat('Lead@Acme ', (k % 20)::VARCHAR, ' Ltd') AS role,
       concat('github:https://github.com/user', k::VARCHAR) AS profile, concat('ats:', last_order::VARCHAR) AS source_id FROM v_last""")
def json_array_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "v_ats")
    out = json_paths.read(df, F.col("payload"), json_paths.NESTED_VENDOR, entity_key=F.col("k"))
    typed = lambda c, f: _join(F.transform(c, lambda x: F.concat_ws(":", x[f], x["type"])))
    return out.select(
        F.col("entity_key").cast("bigint").alias("k"), typed("emails", "address").alias("emails"), typed("phones", "raw").alias("phones"), _join(F.transform("skills", lambda s: s["name"])).alias("skills"),
        "first_name", "last_name", F.concat_ws("@", F.col("experience")[0]["title"], F.col("experience")[0]["company"]).alias("role"),
        F.concat_ws(":", F.col("profiles")[0]["platform"], F.col("profiles")[0]["url"]).alias("profile"), "source_id",
    )


@add("""
SELECT user_key, full_name, rank FROM (SELECT o_custkey AS user_key, o_orderkey AS full_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 10""")
def topk_repos_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repo_api.top_repositories(frame(spark, sf_dir, "orders"), 10, "o_custkey", "o_totalprice", "o_orderdate", "o_orderkey")
    return out.select(F.col("o_custkey").alias("user_key"), F.col("o_orderkey").alias("full_name"), "rank")


@add("""
SELECT entity_key, arg_min(concat(upper(name[1]), name[2:]), ord) AS name, arg_min(context, ord) AS source_context, count(*)::BIGINT AS github_occurrence_count FROM v_api GROUP BY entity_key, lower(name)""")
def infer_skills_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_api.infer_technologies(frame(spark, sf_dir, "v_api"), "entity_key").drop("ord")


_MANIFEST = """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'package.json' WHEN 1 THEN 'requirements.txt' WHEN 2 THEN 'pom.xml' WHEN 3 THEN 'vite.config.ts' ELSE 'notes.md' END AS filename,
  CASE p_partkey % 5 WHEN 0 THEN concat('{{{{"dependencies":{{{{"lib', cast(p_size as string), '":"1","react":"2"}}}},"devDependencies":{{{{"vitest":"*"}}}}}}}}')
   WHEN 1 THEN concat('pandas>=2', chr(10), chr(10), ' dep', cast(p_size as string), '[all]~=1', chr(10), 'numpy') WHEN 2 THEN concat('<x><artifactId>art', cast(p_size as string), '</artifactId><artifactId>b</artifactId></x>') ELSE '' END AS content FROM {part}"""


@add("""
SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN concat('Node.js|lib', p_size::VARCHAR, '|react|vitest') WHEN 1 THEN concat('pandas|dep', p_size::VARCHAR, '|numpy')
  WHEN 2 THEN concat('Java|Maven|art', p_size::VARCHAR, '|b') WHEN 3 THEN 'Vite|TypeScript' ELSE '' END AS names FROM part""")
def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, _MANIFEST.replace("{{{{", "{{").replace("}}}}", "}}"))
    return df.select("k", _join(repo_api.manifest_names(F.col("filename"), F.col("content"))).alias("names"))


@add("""
WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://github.com/dev', page_id::VARCHAR, '/repo?x=1') WHEN 1 THEN concat('@dev', page_id::VARCHAR) WHEN 2 THEN concat(' www.linkedin.com/in/', page_id::VARCHAR, '/ ') ELSE url END AS link FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'github' WHEN 2 THEN 'linkedin' WHEN 1 THEN 'other' ELSE CASE WHEN contains(lower(link), 'x.com') THEN 'twitter' ELSE 'other' END END AS platform,
  CASE page_id % 4 WHEN 0 THEN concat('dev', page_id::VARCHAR) WHEN 1 THEN concat('dev', page_id::VARCHAR) WHEN 2 THEN 'in' ELSE nullif(regexp_extract(regexp_replace(link, '^https?://[^/?#]+', ''), '^/*([^/?#]+)', 1), '') END AS username,
  CASE page_id % 4 WHEN 2 THEN concat('www.linkedin.com/in/', page_id::VARCHAR) ELSE regexp_replace(link, '/+$', '') END AS url FROM u""")
def platform_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, """SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://github.com/dev', cast(page_id as string), '/repo?x=1') WHEN 1 THEN concat('@dev', cast(page_id as string)) WHEN 2 THEN concat(' www.linkedin.com/in/', cast(page_id as string), '/ ') ELSE url END AS link FROM {pages}""")
    link = F.col("link")
    return df.select("page_id", contact.platform(link).alias("platform"), contact.username(link).alias("username"), contact.clean_url(link).alias("url"))


@add("SELECT doc_id, sha256(text) AS sha, length(text)::BIGINT AS n FROM documents")
def b64_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "utf-8")), "(.{60})", "$1\n ").alias("cell"))
    back = text.decode_base64(F.col("cell"))
    return df.select("doc_id", F.sha2(back, 256).alias("sha"), F.length(back).cast("bigint").alias("n"))


@add(f"SELECT k, array_to_string({sql_split('skills')}, '|') AS parts, len({sql_split('skills')})::BIGINT AS n FROM v_crm")
def split_multivalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "v_crm")
    parts = text.split_multi(F.col("skills"))
    return df.select("k", _join(parts).alias("parts"), F.size(parts).cast("bigint").alias("n"))


@add("""
WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '([a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,})', 1)) AS a, generate_subscripts(regexp_extract_all(text, '([a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,})', 1), 1) AS i FROM documents),
g AS (SELECT doc_id, lower(a) AS a, min(i) AS i FROM f GROUP BY ALL)
SELECT d.doc_id, coalesce(string_agg(a, '|' ORDER BY i), '') AS emails FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id""")
def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "documents").select("doc_id", _join(contact.find_emails(F.col("text"))).alias("emails"))


@add(f"""
WITH e AS (SELECT k, {sql_split("email")} AS a FROM v_crm)
SELECT k, array_to_string(list_transform(list_filter(a, lambda x: {sql_is_email("x")}), lambda x: lower(x)), '|') AS valid, array_to_string(list_filter(a, lambda x: NOT {sql_is_email("x")}), '|') AS invalid,
       nullif(split_part(lower(list_filter(a, lambda x: {sql_is_email("x")})[1]), '@', 2), '') AS domain FROM e""")
def email_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "v_crm")
    made = csv.fields({"email": F.col("email")})
    return df.select("k", _join(F.transform(made["emails"], lambda e: e["address"])).alias("valid"), _join(F.transform(made["warnings"], lambda w: w["raw"])).alias("invalid"), F.get(made["emails"], 0)["domain"].alias("domain"))


# DuckDB's patterns look neither back nor ahead, so each step takes one number off the rest, of which the first
# character is the one before: a space, then the last one of the number that was taken
_PHONE = r"(?:(?:\+?1[ \t\n\x0b\f\r.\-]?)?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ \t\n\x0b\f\r.\-]?[2-9][0-9]{2}[ \t\n\x0b\f\r.\-]?[0-9]{4}|\+[0-9]{1,3}[ \t\n\x0b\f\r.\-]?[0-9 \t\n\x0b\f\r.\-]{6,20})"


@add(f"""
WITH RECURSIVE step AS (
  SELECT doc_id, 0 AS i, '' AS num, concat(' ', text) AS rest, regexp_extract(concat(' ', text), '(?s)^(.*?[^0-9])({_PHONE})(?:[^0-9]|$)', ['pre', 'num']) AS m FROM documents
  UNION ALL
  SELECT doc_id, i + 1, m.num, r, regexp_extract(r, '(?s)^(.*?[^0-9])({_PHONE})(?:[^0-9]|$)', ['pre', 'num'])
  FROM (SELECT *, concat(right(m.num, 1), substr(rest, length(m.pre) + length(m.num) + 1)) AS r FROM step WHERE m.num <> '')),
t AS (SELECT doc_id, i, regexp_replace(num, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS num FROM step WHERE i > 0),
f AS (SELECT doc_id, num, min(i) AS i FROM t GROUP BY doc_id, num)
SELECT d.doc_id, coalesce(string_agg(num, '|' ORDER BY i), '') AS phones FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id""")
def phone_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "documents").select("doc_id", _join(contact.find_phones(F.col("text"))).alias("phones"))


@add("""
WITH f AS (SELECT page_id, regexp_extract_all(concat(url, '. ', html), '(?i)(https?://[^\\s<>"''()]+|(?:github|linkedin|twitter|gitlab|kaggle|leetcode|behance|dribbble)\\.com/[^\\s<>"''()]+)', 1) AS a FROM pages),
g AS (SELECT page_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM f),
h AS (SELECT page_id, arg_min(regexp_replace(x, '[.,;:!?)\\]}]+$', ''), i) AS x, min(i) AS i FROM g GROUP BY page_id, lower(regexp_replace(x, '[.,;:!?)\\]}]+$', '')))
SELECT p.page_id, coalesce(string_agg(x, '|' ORDER BY i), '') AS urls FROM pages p LEFT JOIN h ON p.page_id = h.page_id GROUP BY p.page_id""")
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "SELECT page_id, concat(url, '. ', html) AS t FROM {pages}")
    return df.select("page_id", _join(contact.find_urls(F.col("t"))).alias("urls"))


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '^[=\\-_*•·|▬▪◦\\s]+|[=\\-_*•·|▬▪◦\\s]+$', '', 'g'), '[:\\-|\\s]+$', ''), '\\s+', ' ', 'g'))"


@add(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, sha256(string_agg({_NORM}, chr(10) ORDER BY i)) AS sha, count(*)::BIGINT AS n FROM l GROUP BY doc_id""")
def line_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.transform(F.split("text", "\n"), lines.normalize_line)
    return frame(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(norm, "\n"), 256).alias("sha"), F.size(norm).cast("bigint").alias("n"))


@add("""
SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'skills' WHEN 1 THEN 'experience' WHEN 2 THEN 'languages_spoken' WHEN 3 THEN NULL WHEN 4 THEN 'education' ELSE NULL END AS section FROM part""")
def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN '=== Technical  SKILLS ===' WHEN 1 THEN concat(repeat('-', cast(p_size as int)), ' Work Experience:') WHEN 2 THEN '** Spoken Languages **' WHEN 3 THEN p_name
        WHEN 4 THEN 'EDUCATION |' ELSE 'my very own work experience' END AS line FROM {part}""")
    return df.select("k", lines.heading_section(F.col("line")).alias("section"))


@add("""
SELECT k, concat('Builds ', segment, ' systems.') AS summary, concat('Languages: Python, SQL; Go', chr(10), 'Tools', chr(10), '- Spark | 42 | sql') AS skills,
  8::BIGINT AS n_roles, 'education,experience,header,projects,skills,summary' AS names FROM v_resume""")
def section_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sectioned.parse(frame(spark, sf_dir, "v_resume").select("k", "text"))
    s = lambda n: F.trim(F.regexp_replace(F.try_element_at("sections", F.lit(n)), r"^\s+|\s+$", ""))
    count = F.size(F.filter(F.split(F.try_element_at("sections", F.lit("experience")), "\n"), lambda x: x != ""))
    return df.select("k", s("summary").alias("summary"), s("skills").alias("skills"), (count + 1).cast("bigint").alias("n_roles"), F.array_join(F.array_sort(F.map_keys("sections")), ",").alias("names"))


@add("""
SELECT c_custkey AS k, concat('Jane Q', chr(cast(97 + c_custkey % 26 as int)), ' Roe') AS name, concat('jane', c_custkey::VARCHAR, '@mail.example.com') AS emails,
  concat('(212) 555-', lpad((c_custkey % 10000)::VARCHAR, 4, '0')) AS phones, concat('https://github.com/jane', c_custkey::VARCHAR) AS urls, concat('Builds ', lower(c_mktsegment), ' systems.') AS summary FROM customer""")
def name_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sectioned.read(frame(spark, sf_dir, "v_resume").select("k", "text"), entity_key=F.col("k"))
    listed = lambda c, f: _join(F.transform(c, lambda x: x[f]))
    return out.select(F.col("entity_key").cast("bigint").alias("k"), F.col("full_name").alias("name"), listed("emails", "address").alias("emails"), listed("phones", "raw").alias("phones"), listed("profiles", "url").alias("urls"), "summary")


@add("""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
w AS (SELECT conv_id, turn, i, x FROM l)
SELECT conv_id, turn, coalesce(string_agg(trim(x), ' ' ORDER BY i) FILTER (WHERE len(string_split(trim(x), ' ')) >= 8), '') AS summary FROM w GROUP BY conv_id, turn""")
def summary_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", F.coalesce(lines.header_summary(F.col("text")), F.lit("")).alias("summary"))


@add("SELECT c_custkey AS k, 'Python|SQL|Go|Tools|Spark' AS names FROM customer")
def skill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sectioned.parse(frame(spark, sf_dir, "v_resume").select("k", "text"))
    return df.select("k", _join(lines.skill_names(F.try_element_at("sections", F.lit("skills")))).alias("names"))


@add("""
SELECT p_partkey AS k, list_transform(range(0, 1), lambda i: array_to_string(list_distinct([]::VARCHAR[]), ''))[1] AS gone,
  CASE p_partkey % 3 WHEN 0 THEN 'A|b' WHEN 1 THEN 'Red|Blue|GREEN' ELSE '' END AS kept FROM part""")
def dedupe_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN ' A ,a,b,,B ' WHEN 1 THEN 'Red,red ,Blue,GREEN,green' ELSE ' , ' END AS cell FROM {part}")
    return df.select("k", F.lit("").alias("gone"), _join(text.dedupe_ci(F.split("cell", ","))).alias("kept"))


_ORDER_DATE = """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast((month(o_orderdate) - 1) * 3 + 1 as int), 3) AS mon FROM {orders}"""


@add("""
SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN make_date(year(o_orderdate), month(o_orderdate), 1) WHEN 2 THEN make_date(year(o_orderdate), 1, 1)
  WHEN 3 THEN o_orderdate::DATE WHEN 4 THEN make_date(1900, month(o_orderdate), 1) WHEN 5 THEN NULL ELSE make_date(year(o_orderdate), month(o_orderdate), 1) END AS parsed FROM orders""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, f"""SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN concat(cast(y as string), '-', lpad(cast(m as string), 2, '0'), '-', lpad(cast(d as string), 2, '0')) WHEN 1 THEN concat(' ', mon, ' ', cast(y as string))
        WHEN 2 THEN cast(y as string) WHEN 3 THEN concat(lower(mon), '. ', cast(d as string), ', ', cast(y as string)) WHEN 4 THEN mon WHEN 5 THEN 'no date' ELSE concat(lpad(cast(m as string), 2, '0'), '/', cast(y as string)) END AS cell FROM ({_ORDER_DATE})""")
    return df.select("k", dates.parse_date(F.col("cell")).alias("parsed"))


@add("""
SELECT o_orderkey AS k, concat('Jan ', y::VARCHAR) AS raw_start, CASE o_orderkey % 3 WHEN 0 THEN 'Present' WHEN 1 THEN (y + 2)::VARCHAR ELSE concat('Mar ', (y + 1)::VARCHAR) END AS raw_end, make_date(y, 1, 1) AS start_date,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN make_date(y + 2, 1, 1) ELSE make_date(y + 1, 3, 1) END AS end_date, o_orderkey % 3 = 0 AS is_current FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""")
def date_range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, """SELECT o_orderkey AS k, concat('Engineer, Jan ', cast(y as string), CASE o_orderkey % 3 WHEN 0 THEN ' – Present' WHEN 1 THEN concat(' - ', cast(y + 2 as string)) ELSE concat('—Mar ', cast(y + 1 as string)) END, ' (remote)') AS line
        FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM {orders})""")
    span = dates.split_range(dates.find_range(F.col("line")))
    return df.select("k", *[span[n].alias(n) for n in ("raw_start", "raw_end", "start_date", "end_date", "is_current")])


@add("""
SELECT c_custkey AS k, concat('Senior Engineer@Acme ', (c_custkey % 20)::VARCHAR, '@Jan ', (2000 + c_custkey % 10)::VARCHAR, '|Analyst@Beta ', (c_custkey % 3)::VARCHAR, '@2019') AS roles,
  concat('Cut cost by ', (c_custkey % 90)::VARCHAR, '%') AS achievements, 'Wrote code|Ran reports' AS responsibilities FROM customer""")
def experience_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sectioned.read(frame(spark, sf_dir, "v_resume").select("k", "text"), entity_key=F.col("k"))
    each = F.transform("experience", lambda r: F.concat_ws("@", r["title"], r["company"], r["raw_start"]))
    flat = lambda n: _join(F.flatten(F.transform("experience", lambda r: r[n])))
    return out.select(F.col("entity_key").cast("bigint").alias("k"), _join(each).alias("roles"), flat("achievements").alias("achievements"), flat("responsibilities").alias("responsibilities"))


@add("""
SELECT c_custkey AS k, concat('State University ', (c_custkey % 6)::VARCHAR) AS institution, 'Bachelor of Science in Physics' AS degree, 'bachelor' AS degree_level, 'Physics' AS field, make_date(2004, 1, 1) AS start_date, make_date(2008, 1, 1) AS end_date,
  concat('3.', (c_custkey % 10)::VARCHAR)::DOUBLE AS gpa, 4.0::DOUBLE AS gpa_scale FROM customer""")
def education_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sectioned.read(frame(spark, sf_dir, "v_resume").select("k", "text"), entity_key=F.col("k"))
    e = F.col("education")[0]
    return out.select(F.col("entity_key").cast("bigint").alias("k"), *[e[n].alias(n) for n in ("institution", "degree", "degree_level", "field", "start_date", "end_date", "gpa", "gpa_scale")])


@add("SELECT c_custkey AS k, 'Line Tool | Python, Redis|Project' AS titles, 'Python+Redis+Docker|Spark+go+Go' AS technologies, 'Built a parser with docker and more' AS bullets FROM customer")
def project_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sectioned.parse(frame(spark, sf_dir, "v_resume").select("k", "text"))
    return df.select("k", _join(F.transform("projects", lambda p: p["title"])).alias("titles"), _join(F.transform("projects", lambda p: F.array_join(p["technologies"], "+"))).alias("technologies"), _join(F.flatten(F.transform("projects", lambda p: p["bullets"]))).alias("bullets"))


@add("""
SELECT p_partkey AS k, ['doctorate','master','bachelor','associate','certificate','unknown','master'][p_partkey % 7 + 1] AS level, ['doctorate','master','bachelor','associate','certificate','high_school','unknown'][p_partkey % 7 + 1] AS text_level FROM part""")
def degree_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "SELECT p_partkey AS k, element_at(array('PhD in Art', 'MBA, 2nd', 'B.Tech. Civil', 'Associate degree', 'Certificate of ', 'High School', 'Systems '), cast(p_partkey % 7 + 1 as int)) AS degree FROM {part}")
    return df.select("k", profile.degree_level(F.col("degree")).alias("level"), profile.text_degree_level(F.col("degree")).alias("text_level"))


@add("""
SELECT p_partkey AS k, concat('Cut ', p_size::VARCHAR, '% of cost|Led ', p_size::VARCHAR, ' engineers') AS achievements, concat('Did ', p_name) AS responsibilities FROM part""")
def bullet_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "SELECT p_partkey AS k, array(concat('• Cut ', cast(p_size as string), '% of cost'), concat('- Did ', p_name), ' ', concat('* Led ', cast(p_size as string), ' engineers')) AS ls FROM {part}")
    out = lines.bullets(F.col("ls"))
    return df.select("k", _join(out["achievements"]).alias("achievements"), _join(out["responsibilities"]).alias("responsibilities"))


_SENTENCES = f"list_filter(string_split(regexp_replace({sql_collapse('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@add(f"SELECT conv_id, turn, len({_SENTENCES})::BIGINT AS n, {_SENTENCES}[1] AS first, {_SENTENCES}[-1] AS last FROM conversations")
def notes_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return frame(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(s).cast("bigint").alias("n"), F.get(s, 0).alias("first"), F.get(s, F.size(s) - 1).alias("last"))


@add("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN concat('Solid ', lower(c_mktsegment), ' person.') ELSE concat('Strong candidate with leadership in ', lower(c_mktsegment), '.') END AS summary,
  CASE WHEN c_custkey % 3 = 0 THEN 'sql|Spark|c++' ELSE concat('in|', CASE WHEN c_mktsegment = 'none' THEN '' ELSE lower(c_mktsegment) END, '|Noted|for|Problem|Solving|work|Uses|node.js|spark-sql|R2', (c_custkey % 4)::VARCHAR, '|No|concern', CASE WHEN c_custkey % 2 = 1 THEN '|too' ELSE '' END) END AS keywords,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Leadership|Problem Solving|Teamwork' END AS soft,
  CASE WHEN c_custkey % 3 = 0 THEN 'prefers teams|calm' ELSE 'Noted for Problem Solving and C++ work!|No concern?' END AS observations FROM customer""")
def notes_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, t = frame(spark, sf_dir, "v_notes"), F.col("text")
    return df.select("k", notes.summary(t).alias("summary"), _join(notes.keywords(t)).alias("keywords"), _join(notes.soft_skills(t)).alias("soft"), _join(notes.observations(t)).alias("observations"))


@add("""
WITH s AS (SELECT user_id AS k, concat('user', user_id::VARCHAR) AS login, count(*) AS n FROM events GROUP BY user_id)
SELECT k, concat('Dev ', k::VARCHAR) AS full_name, CASE WHEN n % 2 = 0 THEN 'Likes code' END AS summary, concat('https://github.com/', login) AS url, login AS username, CASE WHEN k % 3 = 0 THEN NULL ELSE 'Berlin' END AS location FROM s""")
def profile_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, """SELECT user_id AS k, concat('{{"login":"user', cast(user_id as string), '","name":" Dev ', cast(user_id as string), ' ","bio":"', CASE WHEN count(*) % 2 = 0 THEN 'Likes code' ELSE '  ' END,
        '","location":', CASE WHEN user_id % 3 = 0 THEN 'null' ELSE '"Berlin"' END, ',"html_url":"https://github.com/user', cast(user_id as string), '/","followers":3}}') AS payload FROM {events} GROUP BY user_id""")
    f = repo_api.profile_fields(F.col("payload"))
    return df.select("k", f["full_name"].alias("full_name"), f["summary"].alias("summary"), f["profiles"][0]["url"].alias("url"), f["profiles"][0]["username"].alias("username"), f["location"]["raw"].alias("location"))


@add("""
WITH t AS (SELECT l_orderkey AS k, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS topics FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS k, coalesce(t.topics, '') AS topics FROM orders LEFT JOIN t ON o_orderkey = t.k""")
def repo_payload_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = frame(spark, sf_dir, "SELECT o_orderkey AS full_name FROM {orders}")
    topics = frame(spark, sf_dir, "SELECT l_orderkey AS full_name, sort_array(collect_set(l_returnflag)) AS topics FROM {lineitem} GROUP BY l_orderkey")
    return repo_api.with_payloads(repos, {"topics": topics}).select(F.col("full_name").alias("k"), _join("topics").alias("topics"))


# records without a cell that is not empty go, those of two segments here
@add("""
SELECT c_custkey AS k, concat('Ann "', c_name, '"') AS name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE concat('a,', c_mktsegment) END AS mail FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def csv_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, """SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN ',' WHEN 'MACHINERY' THEN NULL
        ELSE translate(concat('~Ann ~~', c_name, '~~~,', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE concat('~a,', c_mktsegment, '~') END), '~', chr(34)) END AS line FROM {customer}""")
    return csv.parse_lines(df, "line", ["name", "mail"])


@add("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('{"t":"', event_type, '"}') WHEN 1 THEN concat('["', event_type, '",1]') ELSE '{"empty":true}' END AS value FROM events""")
def json_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('{{"t": "', event_type, '"}}') WHEN 1 THEN concat(' ["', event_type, '", 1]')
        WHEN 2 THEN concat('{{', event_type) ELSE '  ' END AS text FROM {events}""")
    return df.select("event_id", F.to_json(json_paths.parse_text(F.col("text"), '{"empty": true}')).alias("value"))


@add("""
SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'text:No text' WHEN 1 THEN 'text:No text' WHEN 2 THEN 'full_name:No name at the top of the text' ELSE '' END AS warnings,
  CASE c_custkey % 4 WHEN 3 THEN 'Ann Lee Roe' END AS full_name FROM customer""")
def blank_text_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN concat(' ', chr(10), chr(9)) WHEN 1 THEN NULL
        WHEN 2 THEN concat('Skills', chr(10), '- ', c_mktsegment) ELSE concat('Ann Lee Roe', chr(10), 'Skills', chr(10), '- sql') END AS text FROM {customer}""")
    out = base.builtin().read("resume", df, entity_key=F.col("k"))
    shown = F.transform("warnings", lambda w: F.concat_ws(":", w["field"], w["message"]))
    return out.select(F.col("entity_key").cast("bigint").alias("k"), _join(shown).alias("warnings"), "full_name")


#: What the payloads of json_coerce_defaults are brought to.
_SETTINGS = {
    "type": "object",
    "required": ["k", "name", "tags", "mode"],
    "properties": {"k": {"$ref": "#/$defs/count"}, "name": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}, "mode": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "profiles": {"type": "array"}},
    "$defs": {"count": {"type": "integer"}},
}


@add("""
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0 ELSE (props->>'$.k')::BIGINT END AS k, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN concat(event_type, chr(10), 'x') ELSE 'N/A' END AS name,
  CASE event_id % 5 WHEN 1 THEN event_type WHEN 2 THEN 'a|N/A' ELSE '' END AS tags, CASE WHEN event_id % 5 = 4 THEN 'fallback' END AS mode, CASE event_id % 5 WHEN 3 THEN 1 END AS n_profiles FROM events""")
def json_coerce_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, """SELECT event_id, CASE event_id % 5
        WHEN 0 THEN concat('{{"k":', get_json_object(props, '$.k'), ',"name":"', event_type, '"}}')
        WHEN 1 THEN concat('{{"k":"', get_json_object(props, '$.k'), '.7","name":["', event_type, '","x"],"tags":"', event_type, '"}}')
        WHEN 2 THEN concat('{{"k":', get_json_object(props, '$.k'), ',"name":null,"tags":["a",null]}}')
        WHEN 3 THEN concat('{{"k":', get_json_object(props, '$.k'), ',"profiles":[{{"platform":"github","url":"u"}},{{"platform":"nowhere","url":"u"}},{{"platform":"github"}}]}}')
        ELSE 'not json' END AS config FROM {events}""")
    made = coerce.coerce_json(df, "config", _SETTINGS, fallback='{"mode":"fallback"}')
    p = F.from_json("config", "k bigint, name string, tags array<string>, mode string, profiles array<struct<platform:string,url:string>>")
    found = made.select("event_id", p.alias("p"))
    return found.select("event_id", "p.k", "p.name", _join(F.col("p.tags")).alias("tags"), "p.mode", F.when(F.col("p.profiles").isNotNull(), F.size("p.profiles")).alias("n_profiles"))


@add("""
WITH n AS (SELECT user_id AS username, event_id, unnest(CASE event_id % 4 WHEN 0 THEN [event_type] WHEN 1 THEN [event_type, 'my_lib'] WHEN 2 THEN ['CI'] ELSE ['React'] END) AS name, event_id % 4 AS k FROM events)
SELECT username, concat(upper(replace(name, '_', ' ')[1]), replace(name, '_', ' ')[2:]) AS name, count(*)::BIGINT AS n, count(DISTINCT CASE k WHEN 0 THEN 'github languages' WHEN 1 THEN 'u/r topics' WHEN 2 THEN 'u/r workflows' ELSE 'u/r README' END)::BIGINT AS contexts
FROM n GROUP BY username, concat(upper(replace(name, '_', ' ')[1]), replace(name, '_', ' ')[2:])""")
def payload_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = frame(spark, sf_dir, """SELECT user_id AS username, 1 AS rank, 'u/r' AS full_name, element_at(array('languages', 'topics', 'workflows', 'readme'), cast(event_id % 4 + 1 as int)) AS kind, cast(event_id as string) AS path,
        CASE event_id % 4 WHEN 0 THEN concat('{{"', event_type, '":9}}') WHEN 1 THEN concat('{{"names":["', event_type, '","my_lib"]}}') WHEN 2 THEN '{{"workflows":[{{"name":"CI"}},{{}}]}}' ELSE '{{"encoding":"base64","content":"dXNlcyBSRUFDVA=="}}' END AS payload FROM {events}""")
    rows = repo_api.evidence(landed)
    return rows.groupBy("username", repo_api.technology_name(F.col("name")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("context").alias("contexts"))

"""CSV sources: header mapping at plan time, one row a person or several typed rows a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact
from ..functions.ids import row_hash
from ..functions.text import blank_to_null, first_by, split_multi, trim_ws
from ..schemas import EDUCATION, EMAILS, LOCATION, PHONES, PROFILES, ROLES, SKILLS, WARNINGS, extracted, record

#: Header names (lower case) of each canonical field.
ALIASES: dict[str, tuple[str, ...]] = {
    "first_name": ("first_name", "first name", "firstname", "given_name", "given name", "f_name"),
    "middle_name": ("middle_name", "middle name", "middlename"),
    "last_name": ("last_name", "last name", "lastname", "family_name", "family name", "surname", "l_name"),
    "full_name": ("full_name", "fullname", "name", "candidate_name", "candidate name", "applicant_name", "applicant name"),
    "email": ("email", "email_address", "email address", "emailaddress", "e-mail", "e_mail", "mail"),
    "phone": ("phone", "phone_number", "phone number", "mobile", "mobile_number", "mobile number", "cell", "cell_phone", "telephone", "contact_number", "contact number", "contactnumber"),
    "location": ("location", "currentcity", "address"),
    "location_city": ("city",),
    "location_state": ("state", "province"),
    "location_country": ("country",),
    "location_postal_code": ("zip", "zip_code", "postal_code", "postal code"),
    "summary": ("summary", "aboutme", "bio", "about", "objective", "profile_summary", "profile summary"),
    "skills": ("skills", "skill", "technologies", "tech_stack", "tech stack"),
    "current_company": ("current_company", "current company", "company", "employer", "organization", "organisation"),
    "current_title": ("current_title", "current title", "title", "job_title", "job title", "position", "role", "designation"),
    "linkedin_url": ("linkedin", "linkedin_url", "linkedin url", "linkedin_profile", "linkedin profile"),
    "github_url": ("github", "github_url", "github url", "github_profile", "github profile"),
    "portfolio_url": ("portfolio", "portfolio_url", "portfolio_link"),
    "website_url": ("website", "website_url", "personal_website", "personal website"),
}
UID_HEADERS = ("uid", "uidaddress", "candidate_id", "candidateid")

def mapping(custom: dict[str, str] | None = None) -> dict[str, str]:
    """header -> canonical field; custom headers override. ValueError for a field that does not exist."""
    out = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
    for header, name in (custom or {}).items():
        if name not in ALIASES:
            raise ValueError(f"{name} is no canonical field")
        out[header.strip().lower()] = name
    return out


def read(spark: SparkSession, path: str, encoding: str = "utf-8", delimiter: str = ",") -> DataFrame:
    """All cells as text; absent ones empty. Headers stay as written."""
    df = spark.read.options(header=True, encoding=encoding, sep=delimiter, multiLine=True, escape='"', inferSchema=False).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def parse_lines(df: DataFrame, line: str, headers: list[str], delimiter: str = ",") -> DataFrame:
    """Rows of delimited text, one record in each value of the column `line`: all cells as text, absent ones empty.

    The headers' columns take the place of `line`; other columns stay. Records whose cells are all empty, and null ones, go.
    """
    names = [f"c{i}" for i in range(len(headers))]
    cells = F.from_csv(F.col(f"`{line}`"), ", ".join(f"{n} string" for n in names), {"sep": delimiter, "escape": '"'})
    others = [F.col(f"`{c}`") for c in df.columns if c != line]
    kept = df.select(*others, cells.alias("__cells")).where(F.coalesce(*[F.nullif(F.col(f"__cells.{n}"), F.lit("")) for n in names]).isNotNull())
    return kept.select(*others, *[F.coalesce(F.col(f"__cells.{n}"), F.lit("")).alias(h) for n, h in zip(names, headers, strict=True)])


def canonical(df: DataFrame, custom: dict[str, str] | None = None) -> dict[str, Column]:
    """For each canonical field that some header maps to, its trimmed cell: of several columns the last that is not blank."""
    table, found = mapping(custom), {}
    for c in df.columns:
        name = table.get(c.strip().lower())
        if name:
            found.setdefault(name, []).append(blank_to_null(F.col(f"`{c}`")))
    return {name: F.coalesce(*reversed(cells)) for name, cells in found.items()}


def fields(cells: dict[str, Column]) -> dict[str, Column]:
    """Fields of an extracted record from canonical cells."""
    get = lambda n: cells.get(n, F.lit(None).cast("string"))
    addresses = split_multi(get("email"))
    good = F.transform(F.filter(addresses, contact.is_email), contact.address)
    emails = F.transform(good, lambda a, i: record(EMAILS, address=a, type=F.lit("unknown"), is_primary=i == 0, domain=contact.email_domain(a)))
    bad = F.transform(F.filter(addresses, lambda a: ~contact.is_email(a)), lambda a: F.struct(F.lit("email").alias("field"), F.lit("Could not parse email").alias("message"), a.alias("raw")))
    phones = F.transform(split_multi(get("phone")), lambda p, i: record(PHONES, raw=p, type=F.lit("unknown"), is_primary=i == 0, is_valid=F.lit(False)))
    place = {k: get(n) for k, n in (("raw", "location"), ("city", "location_city"), ("state", "location_state"), ("country", "location_country"), ("postal_code", "location_postal_code"))}
    skills = F.transform(split_multi(get("skills")), lambda s: record(SKILLS, name=s, source_context=F.concat(F.lit("csv:skills_column:"), s), is_inferred=F.lit(False), github_occurrence_count=F.lit(1)))
    return {
        **{n: get(n) for n in ("first_name", "middle_name", "last_name", "full_name", "summary")},
        "emails": emails,
        "phones": phones,
        "location": F.when(F.coalesce(*place.values()).isNotNull(), record(LOCATION, **place)),
        "skills": skills,
        "experience": current_role(get("current_company"), get("current_title")),
        "profiles": links([(get("linkedin_url"), "linkedin"), (get("github_url"), "github"), (get("portfolio_url"), "portfolio"), (get("website_url"), None)]),
        "warnings": bad,
    }


def current_role(company: Column, title: Column) -> Column:
    """One open role if either is given; the other is Unknown."""
    role = record(ROLES, company=F.coalesce(company, F.lit("Unknown")), title=F.coalesce(title, F.lit("Unknown")), is_current=F.lit(True))
    return F.when(company.isNotNull() | title.isNotNull(), F.array(role)).otherwise(F.array().cast(ROLES))


def links(found: list[tuple[Column, str | None]]) -> Column:
    """Profiles of links in order, without trailing slashes; of equal links the first. Without a platform, by domain."""
    made = [F.when(contact.clean_url(u) != "", record(PROFILES, platform=contact.platform(u) if p is None else F.lit(p), url=contact.clean_url(u))) for u, p in found]
    every = F.array_compact(F.array(*made))
    return first_by(every, lambda x: x["url"])


def rows(df: DataFrame, custom: dict[str, str] | None = None, entity_key: Column | None = None, src_ord: Column | None = None) -> DataFrame:
    """One extracted record a row; source_id is a hash of its cells."""
    source_id = row_hash({c: F.col(f"`{c}`") for c in df.columns})
    key = source_id if entity_key is None else entity_key
    return extracted(df, entity_key=key, src_ord=F.lit(0) if src_ord is None else src_ord, source_type=F.lit("csv"), source_id=source_id, **fields(canonical(df, custom)))


def _cell(df: DataFrame, *names: str) -> Column:
    cells = [blank_to_null(F.col(f"`{c}`")) for c in df.columns if c.strip().lower() in names]
    return F.coalesce(*cells) if cells else F.lit(None).cast("string")


def typed_row(df: DataFrame) -> dict[str, Column]:
    """What a typed row adds to its person: a struct each for education, skills, projects, and (name, issuer) for certifications; else null."""
    kind = F.lower(_cell(df, "record_type"))
    institution, tech, project, cert = (_cell(df, *n) for n in (("institutionname",), ("technology", "skill"), ("projectname",), ("certificatename",)))
    scale = F.coalesce(_cell(df, "gradingscale").try_cast("double"), F.lit(4.0))
    study = record(EDUCATION, institution=institution, degree=_cell(df, "degreename"), field=_cell(df, "major"), gpa=_cell(df, "cgpa").try_cast("double"), gpa_scale=scale, raw_start=_cell(df, "startyear"), raw_end=_cell(df, "graduationyear"))
    skill = record(SKILLS, name=tech, source_context=F.concat(F.lit("csv:technology:"), tech), is_inferred=F.lit(False), github_occurrence_count=F.lit(1))
    stack = F.coalesce(F.filter(F.transform(F.split(_cell(df, "stack"), ";"), trim_ws), lambda x: x != ""), F.array().cast("array<string>"))
    role = record(ROLES, company=F.lit("Personal Project"), title=project, description=_cell(df, "overview"), is_current=F.coalesce(F.lower(_cell(df, "ongoing")).isin("true", "1", "yes"), F.lit(False)), technologies=stack)
    certificate = F.struct(cert.alias("name"), F.coalesce(_cell(df, "issuer"), F.lit("Unknown")).alias("issuer"))
    pick = lambda name, value, c: F.when((kind == name) & value.isNotNull(), c)
    return {"education": pick("education", institution, study), "skills": pick("skill", tech, skill), "projects": pick("project", project, role), "certifications": pick("certification", cert, certificate)}


def grouped(df: DataFrame, order: Column | None = None, custom: dict[str, str] | None = None, compat_grouping: bool = False) -> DataFrame:
    """One extracted record for each uid, with its typed rows; certifications are JSON in its metadata.

    Rows without a uid stand alone. Scalars are the first that are not blank, lists keep first items,
    addresses and numbers without repeats. `order` places rows; the default numbers them as they are scanned, so it (and
    the keys of rows without a uid) depends on how the input is split: give an order where that matters. Rows whose GPA
    is above its scale get a warning and add no education. compat_grouping leaves out the skills
    column, the current role and the links of grouped rows.
    """
    ordered = df.withColumn("__ord", F.monotonically_increasing_id() if order is None else order)
    uid = F.coalesce(_cell(df, *UID_HEADERS), F.concat(F.lit("row_"), F.col("__ord").cast("string")))
    own, typed = fields(canonical(df, custom)), typed_row(df)
    gpa_bad = F.coalesce(typed["education"]["gpa"] > typed["education"]["gpa_scale"], F.lit(False))
    warn = F.when(gpa_bad, F.array(F.struct(F.lit("education").alias("field"), F.lit("GPA is above its scale").alias("message"), typed["education"]["gpa"].cast("string").alias("raw"))))
    own["warnings"] = F.concat(own["warnings"], F.coalesce(warn, F.array().cast(WARNINGS)))
    typed["education"] = F.when(~gpa_bad, typed["education"])
    wide = ordered.select(uid.alias("__uid"), "__ord", *[c.alias(f"o_{n}") for n, c in own.items()], *[c.alias(f"t_{n}") for n, c in typed.items()])
    first = lambda n: F.min_by(n, F.when(F.col(n).isNotNull(), F.col("__ord")))
    inner = lambda n: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col("__ord").alias("o"), F.col(n).alias("v")))), lambda x: x["v"]))
    listed = lambda n: F.transform(F.sort_array(F.collect_list(F.when(F.col(n).isNotNull(), F.struct(F.col("__ord").alias("o"), F.col(n).alias("v"))))), lambda x: x["v"])
    scalars = ("first_name", "middle_name", "last_name", "full_name", "summary", "location")
    aggregates = [first(f"o_{n}").alias(n) for n in scalars] + [inner(f"o_{n}").alias(n) for n in ("emails", "phones", "skills", "experience", "profiles", "warnings")]
    out = wide.groupBy("__uid").agg(F.min("__ord").alias("__ord"), *aggregates, *[listed(f"t_{n}").alias(f"t_{n}") for n in typed])
    distinct = lambda c, k: first_by(F.col(c), lambda x: x[k])
    none = F.array()
    given = {n: F.col(n) for n in (*scalars, "warnings")} | {"emails": distinct("emails", "address"), "phones": distinct("phones", "raw")}
    given["skills"] = F.col("t_skills") if compat_grouping else F.concat("skills", "t_skills")
    given |= {"experience": none if compat_grouping else F.col("experience"), "profiles": none if compat_grouping else F.col("profiles"), "education": F.col("t_education"), "projects": F.col("t_projects")}
    source = F.concat(F.lit("csv:"), F.col("__uid"))
    given["metadata"] = F.create_map(F.lit("certifications"), F.to_json(F.array_distinct("t_certifications")))
    return extracted(out, entity_key=F.col("__uid"), src_ord=F.col("__ord"), source_type=F.lit("csv"), source_id=source, **given)

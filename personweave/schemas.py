"""Schemas of extracted records: one wide row for each source document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATION = "struct<raw:string,city:string,state:string,state_code:string,country:string,country_code:string,postal_code:string>"
EMAILS = "array<struct<address:string,type:string,is_primary:boolean,domain:string>>"
PHONES = "array<struct<raw:string,normalized:string,country_code:string,national_number:string,extension:string,type:string,is_primary:boolean,is_valid:boolean>>"
SKILLS = "array<struct<name:string,category:string,source_context:string,is_inferred:boolean,github_occurrence_count:bigint>>"
ROLES = "array<struct<company:string,title:string,raw_start:string,raw_end:string,start_date:date,end_date:date,is_current:boolean,duration_months:int,description:string,responsibilities:array<string>,achievements:array<string>,technologies:array<string>>>"
EDUCATION = "array<struct<institution:string,degree:string,degree_level:string,field:string,raw_start:string,raw_end:string,start_date:date,end_date:date,gpa:double,gpa_scale:double>>"
PROFILES = "array<struct<platform:string,url:string,username:string>>"
WARNINGS = "array<struct<field:string,message:string,raw:string>>"
LOGS = "array<struct<field:string,normalizer:string,original_value:string,normalized_value:string,success:boolean>>"

#: Columns of an extracted record, in order. entity_key says whose record it is, src_ord its place among them.
EXTRACTED = {
    "entity_key": "string",
    "src_ord": "bigint",
    "source_type": "string",
    "source_id": "string",
    "first_name": "string",
    "middle_name": "string",
    "last_name": "string",
    "full_name": "string",
    "summary": "string",
    "location": LOCATION,
    "emails": EMAILS,
    "phones": PHONES,
    "skills": SKILLS,
    "experience": ROLES,
    "projects": ROLES,
    "education": EDUCATION,
    "profiles": PROFILES,
    "warnings": WARNINGS,
    "raw_text": "string",
    "metadata": "map<string,string>",
}

#: Platforms of profiles.
SOURCE_PLATFORMS = ("github", "linkedin", "twitter", "stackoverflow", "portfolio", "blog", "dribbble", "behance", "kaggle", "leetcode", "other")
SOURCE_TYPES = ("resume", "csv", "ats_json", "github", "linkedin", "recruiter_notes", "manual")


def extracted(df: DataFrame, **columns: Column | str) -> DataFrame:
    """A frame of extracted records: the given columns, all others null or empty lists."""
    out = []
    for name, kind in EXTRACTED.items():
        c = columns.get(name)
        if c is None:
            c = F.array() if kind.startswith("array") else F.lit(None)
        out.append((F.col(c) if isinstance(c, str) else c).cast(kind).alias(name))
    return df.select(*out)


def record(kind: str, **fields: Column) -> Column:
    """A struct of a list's element type: the given fields, all others null."""
    element = kind[len("array<") : -1] if kind.startswith("array<") else kind
    body = element[len("struct<") : -1]
    names, depth, part = [], 0, ""
    for c in body + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            names.append(part.split(":", 1))
            part = ""
        else:
            part += c
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])

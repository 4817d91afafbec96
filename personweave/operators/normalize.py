"""Normalisation of extracted records: one projection of Catalyst expressions.

The order is phones, e-mails, names, companies, skills, dates, education, location. A custom set of
normalisers may be given by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contact, dates, profile, text
from ..schemas import EDUCATION, LOGS


def _log(field: Column, normalizer: str, original: Column, result: Column, success: Column) -> Column:
    return F.struct(field.alias("field"), F.lit(normalizer).alias("normalizer"), original.alias("original_value"), result.alias("normalized_value"), success.alias("success"))


def _indexed(field: str, i: Column, tail: str = "") -> Column:
    return F.concat(F.lit(f"{field}["), i.cast("string"), F.lit(f"]{tail}"))


def phones(items: Column) -> Column:
    """E.164, codes and validity from the raw text; a number that cannot be read keeps its fields."""

    def one(p: Column) -> Column:
        def filled(found: Column) -> Column:
            out = p
            for name in ("normalized", "country_code", "national_number", "extension", "is_valid"):
                out = out.withField(name, F.when(found["national_number"].isNotNull(), found[name]).otherwise(p[name]))
            return out

        return text.let(contact.phone_parts(p["raw"]), filled)

    return F.transform(items, one)


def emails(items: Column) -> Column:
    """Valid addresses only, lower case, with their domain."""
    kept = F.filter(items, lambda e: contact.is_email(e["address"]))
    return F.transform(kept, lambda e: e.withField("address", contact.address(e["address"])).withField("domain", contact.email_domain(contact.address(e["address"]))))


def names(first: Column, middle: Column, last: Column, full: Column) -> dict[str, Column]:
    """Parts from the full name if both first and last are empty; every word capitalised."""
    part = F.split(text.title_words(full), " ")
    n = F.when(full.isNull() | (text.trim_ws(full) == ""), 0).otherwise(F.size(part))
    split = (F.coalesce(first, F.lit("")) == "") & (F.coalesce(last, F.lit("")) == "") & (n > 0)
    inner = F.array_join(F.slice(part, 2, F.greatest(n - 2, F.lit(0))), " ")
    title = lambda c: F.when(c == "", c).otherwise(text.title_words(c))
    return {
        "first_name": F.when(split, F.get(part, 0)).otherwise(title(first)),
        "middle_name": F.when(split & (n > 2), inner).otherwise(title(middle)),
        "last_name": F.when(split & (n > 1), F.get(part, n - 1)).otherwise(title(last)),
        "full_name": title(full),
    }


def roles(items: Column, as_of: Column) -> Column:
    """Companies without legal suffixes, dates from their raw text, open roles and durations."""

    def one(r: Column) -> Column:
        has_start, has_end = F.coalesce(r["raw_start"] != "", F.lit(False)), F.coalesce(r["raw_end"] != "", F.lit(False))
        closed = has_end & ~F.lower(r["raw_end"]).isin(*dates.OPEN_ENDED)
        found = F.struct(
            F.when(has_start, dates.parse_date(r["raw_start"])).otherwise(r["start_date"]).alias("start"),
            F.when(closed, dates.parse_date(r["raw_end"])).otherwise(r["end_date"]).alias("end"),
            (F.coalesce(r["is_current"], F.lit(False)) | (has_end & dates.is_current(r["raw_end"]))).alias("current"),
        )

        def filled(x: Column) -> Column:
            months = F.coalesce(r["duration_months"], dates.duration_months(x["start"], x["end"], x["current"], as_of))
            out = r.withField("company", profile.company(r["company"])).withField("start_date", x["start"]).withField("end_date", x["end"])
            return out.withField("is_current", x["current"]).withField("duration_months", months)

        return text.let(found, filled)

    return F.transform(items, one)


def skills(items: Column) -> Column:
    """Canonical names; of equal ones the first stays."""
    named = F.transform(items, lambda s: s.withField("name", profile.skill_name(s["name"])))
    return text.first_by(named, lambda s: F.lower(s["name"]))


def education(items: Column) -> Column:
    """Dates from their raw text, and the level of the degree."""

    def one(e: Column) -> Column:
        fill = lambda raw, c: F.when(F.coalesce(e[raw] != "", F.lit(False)), dates.parse_date(e[raw])).otherwise(e[c])
        return e.withField("start_date", fill("raw_start", "start_date")).withField("end_date", fill("raw_end", "end_date")).withField("degree_level", profile.degree_level(e["degree"]))

    return F.transform(items, one)


def location(loc: Column) -> Column:
    """City, state and country from the raw text, if there is any."""

    def filled(x: Column) -> Column:
        parsed, n = x["parsed"], x["n"]
        out = loc.withField("city", parsed["city"])
        for at, names_ in ((2, ("state", "state_code")), (3, ("country", "country_code"))):
            for name in names_:
                out = out.withField(name, F.when(n >= at, parsed[name]).otherwise(loc[name]))
        return out

    found = F.struct(profile.parse_location(loc["raw"]).alias("parsed"), F.size(F.split(loc["raw"], ",")).alias("n"))
    return F.when(F.coalesce(loc["raw"], F.lit("")) == "", loc).otherwise(text.let(found, filled))


def logs(df_cols: dict[str, Column], before: dict[str, str]) -> Column:
    """A log entry for each value that a normaliser read: its field, old and new value, success."""
    ok = F.lit(True)
    phone = F.transform(F.col(before["phones"]), lambda p, i: text.let(contact.phone_parts(p["raw"]), lambda x: _log(_indexed("phones", i), "PhoneNormalizer", p["raw"], x["normalized"], x["is_valid"])))
    email = F.transform(F.col(before["emails"]), lambda e, i: _log(_indexed("emails", i), "EmailNormalizer", e["address"], F.when(contact.is_email(e["address"]), contact.address(e["address"])), contact.is_email(e["address"])))
    shown = lambda first, last, full: F.nullif(F.coalesce(F.nullif(full, F.lit("")), F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))), F.lit(""))
    old = shown(F.col(before["first_name"]), F.col(before["last_name"]), F.col(before["full_name"]))
    new = shown(df_cols["first_name"], df_cols["last_name"], df_cols["full_name"])
    name = F.array(_log(F.lit("name"), "NameNormalizer", old, new, ok))
    role = lambda field: F.transform(F.col(before[field]), lambda r, i: _log(_indexed(field, i, ".company"), "CompanyNormalizer", r["company"], profile.company(r["company"]), ok))
    degree = F.transform(F.col(before["education"]), lambda e, i: _log(_indexed("education", i, ".degree_level"), "EducationNormalizer", e["degree"], profile.degree_level(e["degree"]), ok))
    skill = F.transform(F.col(before["skills"]), lambda s: _log(F.lit("skills"), "SkillNormalizer", s["name"], profile.skill_name(s["name"]), ok))
    place = F.when(F.coalesce(F.col(before["location"])["raw"], F.lit("")) != "", F.array(_log(F.lit("location"), "LocationNormalizer", F.col(before["location"])["raw"], profile.location_display(df_cols["location"]), ok))).otherwise(F.array())
    return F.concat(*[c.cast(LOGS) for c in (phone, email, name, role("experience"), role("projects"), skill, degree, place)])


def normalize(records: DataFrame, as_of: str, only: tuple[str, ...] | None = None, extra: dict[str, Callable[[Column], Column]] | None = None, with_logs: bool = True) -> DataFrame:
    """Normalised records, with normalization_logs. as_of (a date) ends open roles.

    only: the fields to normalise; extra: a further expression by field, applied last.
    """
    day = F.lit(as_of).cast("date")
    made = names(*[F.col(n) for n in ("first_name", "middle_name", "last_name", "full_name")]) | {
        "phones": phones(F.col("phones")),
        "emails": emails(F.col("emails")),
        "skills": skills(F.col("skills")),
        "experience": roles(F.col("experience"), day),
        "projects": roles(F.col("projects"), day),
        "education": education(F.col("education")),
        "location": location(F.col("location")),
    }
    if only is not None:
        made = {k: v for k, v in made.items() if k in only}
    out = {k: extra[k](v) if extra and k in extra else v for k, v in made.items()}
    columns = [out[n].alias(n) if n in out else F.col(n) for n in records.columns]
    if with_logs and only is None:
        columns.append(logs(made, {n: n for n in records.columns}).alias("normalization_logs"))
    return records.select(*columns)


def failed(logs_col: Column) -> Column:
    return F.filter(logs_col, lambda x: ~x["success"])


def check_gpa(items: Column) -> tuple[Column, Column]:
    """(records whose GPA is at most its scale, warnings for the others)."""
    bad = lambda e: F.coalesce(e["gpa"] > F.coalesce(e["gpa_scale"], F.lit(4.0)), F.lit(False))
    warn = F.transform(F.filter(items, bad), lambda e: F.struct(F.lit("education").alias("field"), F.lit("GPA is above its scale").alias("message"), e["gpa"].cast("string").alias("raw")))
    return F.filter(items, lambda e: ~bad(e)).cast(EDUCATION), warn

"""Skills, degrees, companies, places, bullets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import title_letters, trim_ws

#: Canonical names of skills, and those that the projection knows besides.
SKILL_ALIASES = {
    "js": "JavaScript",
    "javascript": "JavaScript",
    "ts": "TypeScript",
    "typescript": "TypeScript",
    "reactjs": "React",
    "nodejs": "Node.js",
    "postgres": "PostgreSQL",
    "tailwindcss": "Tailwind CSS",
}
MORE_SKILL_ALIASES = SKILL_ALIASES | {"react.js": "React", "fastapi": "FastAPI", "mongodb": "MongoDB"}
#: Country names.
COUNTRIES = {
    "india": "IN",
    "united states": "US",
    "united states of america": "US",
    "usa": "US",
    "united kingdom": "GB",
    "uk": "GB",
    "canada": "CA",
    "germany": "DE",
    "france": "FR",
    "australia": "AU",
}
#: Levels by substrings of the degree, in order.
LEVELS = {
    "doctorate": ("phd", "doctor"),
    "master": ("master", "m.s", "ms ", "mba"),
    "bachelor": ("bachelor", "b.s", "bs ", "btech", "b.tech"),
    "associate": ("associate",),
    "certificate": ("certificate",),
}
#: The finer levels of sectioned text, looked for in the text between spaces.
TEXT_LEVELS = {
    "doctorate": ("ph.d", "phd", "doctor of philosophy", "doctorate", "d.phil", "doctor of science", "sc.d", "d.sc"),
    "master": ("m.s.", "m.s", " ms ", "msc", "m.sc", "master of science", "m.a.", "m.a", " ma ", "master of arts", "mba", "m.b.a", "master of business", "meng", "m.eng", "master of engineering", "master of", "master's", "masters"),
    "bachelor": ("b.s.", "b.s ", " bs ", "bsc", "b.sc", "bachelor of science", "b.a.", "b.a ", " ba ", "bachelor of arts", "b.e.", " be ", "b.tech", "btech", "bachelor of engineering", "bachelor of technology", "bachelor of", "bachelor's", "bachelors"),
    "associate": ("associate", "a.s.", "a.a.", "a.a.s."),
    "bootcamp": ("bootcamp", "boot camp", "coding bootcamp", "coding school"),
    "certificate": ("certificate", "diploma", "nanodegree", "professional certificate"),
    "high_school": ("high school", "secondary school", "ged", "high school diploma"),
}
#: Fixed patterns: suffixes of company names, and what makes a bullet quantified.
LEGAL_SUFFIX = r"(?i)\b(inc|llc|ltd|corp|corporation|pvt|private|limited)\b\.?"
QUANTIFIED = r"(?i)\d+\s*%|\d+x|\$[\d,]+|\d+\s*(?:million|billion|thousand|k)\b|\d+\s*(?:engineers?|developers?|members?|users?)"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def skill_name(c: Column, aliases: dict[str, str] = SKILL_ALIASES) -> Column:
    """The canonical name: by alias, else _ and - as spaces and every run of letters capitalised."""
    s = trim_ws(c)
    return F.coalesce(_lookup(aliases, F.lower(s)), title_letters(F.regexp_replace(s, "[_-]", " ")))


def country_code(c: Column) -> Column:
    """Two letters in upper case, else the code of a known name, else the value as it is."""
    s = F.lower(trim_ws(c))
    return F.when(F.length(s) == 2, F.upper(s)).otherwise(F.coalesce(_lookup(COUNTRIES, s), c))


def company(c: Column) -> Column:
    """Without legal suffixes, and without spaces and commas at either end."""
    return F.btrim(F.regexp_replace(c, LEGAL_SUFFIX, ""), F.lit(" ,"))


def _by_substring(text: Column, levels: dict[str, tuple[str, ...]]) -> Column:
    out = F
    for level, parts in levels.items():
        hit = F.contains(text, F.lit(parts[0]))
        for p in parts[1:]:
            hit = hit | F.contains(text, F.lit(p))
        out = out.when(hit, level)
    return out.otherwise("unknown")


def degree_level(c: Column) -> Column:
    return _by_substring(F.coalesce(F.lower(c), F.lit("")), LEVELS)


def text_degree_level(c: Column) -> Column:
    return _by_substring(F.concat(F.lit(" "), F.coalesce(F.lower(c), F.lit("")), F.lit(" ")), TEXT_LEVELS)


def is_achievement(line: Column) -> Column:
    """Whether a bullet is quantified: per cent, a factor, money, a magnitude, a headcount."""
    return line.rlike(QUANTIFIED)


def parse_location(raw: Column) -> Column:
    """struct(city, state, state_code, country, country_code) of "city, state, country".

    A second part of at most three letters is a state code, a third of two a country code.
    """
    p = F.transform(F.split(raw, ","), trim_ws)
    second, third = F.get(p, 1), F.get(p, 2)
    return F.struct(
        F.get(p, 0).alias("city"),
        F.when(F.length(second) > 3, second).alias("state"),
        F.when(F.length(second) <= 3, F.upper(second)).alias("state_code"),
        F.when(F.length(third) != 2, third).alias("country"),
        F.when(F.length(third) == 2, F.upper(third)).alias("country_code"),
    )


#: Weights of levels of skill.
PROFICIENCY = {"beginner": 0.25, "intermediate": 0.5, "advanced": 0.75, "expert": 1.0, "unknown": 0.0}


def proficiency_weight(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PROFICIENCY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(c)), F.lit(0.0))


def location_is_empty(loc: Column) -> Column:
    """Whether a place says nothing at all."""
    return F.coalesce(*[loc[n] for n in ("raw", "city", "state", "state_code", "country", "country_code", "postal_code")]).isNull()


def location_display(loc: Column) -> Column:
    """city, state code or state, country code or country; else the raw text. Empty parts are left out."""
    part = lambda c: F.nullif(c, F.lit(""))
    parts = F.array_compact(F.array(part(loc["city"]), F.coalesce(part(loc["state_code"]), part(loc["state"])), F.coalesce(part(loc["country_code"]), part(loc["country"]))))
    return F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), loc["raw"], F.lit(""))

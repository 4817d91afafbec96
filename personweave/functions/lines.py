"""Expressions over the lines of sectioned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import contact, profile
from .text import dedupe_ci, trim_ws

#: Headings of each section.
HEADINGS: dict[str, tuple[str, ...]] = {
    "header": ("contact", "contact information", "personal information", "profile information", "personal details"),
    "summary": ("summary", "professional summary", "career summary", "executive summary", "profile", "professional profile", "career profile", "objective", "career objective", "professional objective", "about", "about me", "overview", "introduction", "bio", "career overview"),
    "experience": ("experience", "work experience", "professional experience", "employment", "employment history", "career history", "work history", "industry experience", "internships", "internship", "internship experience", "professional background", "relevant experience"),
    "projects": ("projects", "project", "personal projects", "academic projects", "professional projects", "selected projects", "featured projects", "research projects", "software projects", "major projects", "key projects", "capstone project", "capstone projects"),
    "education": ("education", "academic background", "educational background", "education and training", "qualifications", "academic qualifications", "education qualification", "degrees", "degree", "schooling", "academics", "academic details"),
    "skills": ("skills", "skill", "technical skills", "technical skill", "technical expertise", "technical competencies", "technologies", "technology stack", "tech stack", "core competencies", "competencies", "areas of expertise", "expertise", "professional skills", "programming languages", "languages", "frameworks", "libraries", "tools", "developer tools", "software", "software skills", "database", "databases", "platforms", "cloud", "cloud technologies", "operating systems"),
    "certifications": ("certifications", "certification", "licenses", "license", "professional certifications", "courses", "coursework", "online courses", "certificates", "credentials"),
    "achievements": ("achievements", "achievement", "awards", "award", "honors", "honours", "recognition", "accomplishments", "highlights", "milestones", "distinctions"),
    "publications": ("publications", "publication", "research", "research publications", "papers", "journal papers", "conference papers", "articles", "patents", "books", "thesis", "dissertation"),
    "leadership": ("leadership", "leadership experience", "positions of responsibility", "position of responsibility", "por", "leadership roles", "student leadership", "organizational experience"),
    "volunteering": ("volunteer", "volunteering", "volunteer experience", "community service", "social work", "extracurricular activities", "activities", "clubs", "organizations"),
    "languages_spoken": ("languages spoken", "spoken languages", "language proficiency", "language", "linguistic skills"),
    "interests": ("interests", "hobbies", "personal interests", "activities and interests", "extracurricular interests"),
    "references": ("references", "reference", "professional references", "referees"),
}
#: Headings that stay inside a skills section.
SKILL_GROUPS = ("languages", "frameworks", "tools", "databases", "cloud", "operating systems", "language", "libraries", "software", "platforms", "database")
#: Words of job titles.
TITLE_WORDS = ("engineer", "developer", "architect", "manager", "director", "analyst", "designer", "consultant", "specialist", "coordinator", "administrator", "scientist", "researcher", "officer", "lead", "head", "principal", "staff", "senior", "junior", "associate", "intern", "vp", "cto", "ceo", "cfo", "coo", "president", "founder", "co-founder")
#: Fixed patterns: bullets, decorations at either end of a heading, punctuation at its end, grades.
BULLET = r"^[•·▪◦○●\-*+]\s+"
DECOR = r"[=\-_*•·|▬▪◦\s]+"
TAIL = r"[:\-|\s]+$"
GPA = r"(?i)GPA[:\s]*(\d\.\d+)\s*(?:/\s*(\d+(?:\.\d+)?))?"


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def normalize_line(line: Column) -> Column:
    """Lower case, without decorations at either end and punctuation at the end, single spaces."""
    s = F.regexp_replace(F.lower(trim_ws(line)), f"^{DECOR}|{DECOR}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, TAIL, ""), r"\s+", " "))


def heading_section(line: Column) -> Column:
    """The section whose heading the line is, without its context; null if it is none."""
    norm = normalize_line(line)
    first: dict[str, str] = {}
    for section, names in HEADINGS.items():
        for n in names:
            first.setdefault(n, section)
    out = F.try_element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), norm)
    return F.when(F.size(F.split(norm, " ")) <= 4, out)


def name_line(text: Column) -> Column:
    """The line among the first 12 that are not blank that looks like a name; null if none does.

    It has 2 to 5 words, all but one of them (two at least) with a capital, and no address, number,
    link, four digits, bar, title word or heading. Words all in capitals are recased.
    """
    first = F.slice(F.filter(F.transform(lines_of(text), trim_ws), lambda x: x != ""), 1, 12)

    def good(x: Column) -> Column:
        words = F.split(x, r"\s+")
        n, capitals = F.size(words), F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        bad = x.rlike(contact.EMAIL_IN_TEXT) | x.rlike(contact.PHONE_IN_TEXT) | x.rlike(contact.URL_IN_TEXT) | x.rlike(r"\d{4}|\|")
        titled = F.arrays_overlap(F.split(F.lower(x), r"\s+"), F.array(*[F.lit(w) for w in TITLE_WORDS]))
        return ~bad & ~titled & heading_section(x).isNull() & n.between(2, 5) & (capitals >= F.greatest(F.lit(2), n - 1))

    found = F.get(F.filter(first, good), 0)
    recased = F.transform(F.split(found, r"\s+"), lambda w: F.when(w.rlike(r"\p{L}") & (w == F.upper(w)), F.initcap(F.lower(w))).otherwise(w))
    return F.when(found.isNotNull(), F.array_join(recased, " "))


def header_summary(text: Column) -> Column:
    """The first run of header lines of eight words or more, joined; lines with contact data do not count. Null if none."""
    state = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("done"))

    def step(a: Column, line: Column) -> Column:
        s = trim_ws(line)
        blank = s == ""
        contacts = s.rlike(contact.EMAIL_IN_TEXT) | s.rlike(contact.PHONE_IN_TEXT) | s.rlike(contact.URL_IN_TEXT)
        take = ~a["done"] & ~blank & ~contacts & (F.size(F.split(s, r"\s+")) >= 8)
        return F.struct(F.when(take, F.array_append(a["p"], s)).otherwise(a["p"]).alias("p"), (a["done"] | (blank & (F.size(a["p"]) > 0))).alias("done"))

    joined = F.aggregate(lines_of(text), state, step, lambda a: F.array_join(a["p"], " "))
    return F.nullif(joined, F.lit(""))


def skill_names(section: Column) -> Column:
    """Skills of a section's lines: without labels and bullets, split at separators, 2 to 60 letters, no bare numbers."""
    lines = F.filter(F.transform(lines_of(section), trim_ws), lambda x: x != "")
    bare = F.transform(lines, lambda x: F.regexp_replace(F.when(F.contains(x, F.lit(":")), F.substr(x, F.instr(x, ":") + 1)).otherwise(x), BULLET, ""))
    parts = F.flatten(F.transform(bare, lambda x: F.split(x, "[,;|•·▪◦○●]")))
    names = F.transform(parts, lambda x: F.btrim(F.btrim(trim_ws(x), F.lit('"')), F.lit("'")))
    return dedupe_ci(F.filter(names, lambda x: F.length(x).between(2, 60) & ~x.rlike(r"^\d+$")))


def bullets(lines: Column) -> Column:
    """struct(responsibilities, achievements): lines without bullets, by whether they are quantified."""
    clean = F.filter(F.transform(lines, lambda x: F.regexp_replace(trim_ws(x), BULLET, "")), lambda x: x != "")
    return F.struct(F.filter(clean, lambda x: ~profile.is_achievement(x)).alias("responsibilities"), F.filter(clean, profile.is_achievement).alias("achievements"))


def gpa(line: Column) -> Column:
    """struct(gpa, gpa_scale) of a line, the scale 4 unless it says; null without a GPA."""
    value = F.regexp_extract(line, GPA, 1).try_cast("double")
    return F.when(value.isNotNull(), F.struct(value.alias("gpa"), F.coalesce(F.regexp_extract(line, GPA, 2).try_cast("double"), F.lit(4.0)).alias("gpa_scale")))


def courses(line: Column) -> Column:
    """Courses of a coursework line; null for other lines."""
    text = F.regexp_replace(line, r"(?i)^.*?coursework[:\s]*", "")
    return F.when(line.rlike("(?i)course|curriculum"), F.filter(F.transform(F.split(text, "[,;]"), trim_ws), lambda x: x != ""))


def study_field(line: Column) -> Column:
    """What follows the word `in`; null without it."""
    return F.nullif(trim_ws(F.regexp_extract(line, r"(?i)\bin\b\s+(.+)", 1)), F.lit(""))

"""E-mail addresses, phone numbers, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws

#: Fixed patterns: an address, and addresses, numbers and links in a text.
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
EMAIL_IN_TEXT = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_IN_TEXT = (
    r"(?<!\d)(?:(?:\+?1[\s.\-]?)?(?:\([2-9]\d{2}\)|[2-9]\d{2})[\s.\-]?[2-9]\d{2}[\s.\-]?\d{4}"
    r"|\+\d{1,3}[\s.\-]?[\d\s.\-]{6,20})(?!\d)"
)
URL_IN_TEXT = r"(?i)https?://[^\s<>\"'()]+|(?:github|linkedin|twitter|gitlab|kaggle|leetcode|behance|dribbble)\.com/[^\s<>\"'()]+"

#: The platform of the first domain that a link contains.
PLATFORM_DOMAINS = {
    "github.com": "github",
    "linkedin.com": "linkedin",
    "twitter.com": "twitter",
    "x.com": "twitter",
    "stackoverflow.com": "stackoverflow",
    "kaggle.com": "kaggle",
    "leetcode.com": "leetcode",
    "dribbble.com": "dribbble",
    "behance.net": "behance",
}
#: Labels of typed contacts.
EMAIL_TYPES = {"work": "work", "personal": "personal", "home": "personal", "school": "school", "other": "other"}
PHONE_TYPES = {"mobile": "mobile", "cell": "mobile", "work": "work", "office": "work", "home": "home", "fax": "fax", "other": "other"}
#: National lengths of some calling codes besides 1, longest code first where one begins another. A number is valid if
#: it is North American (area code and exchange start with 2 to 9) or has one of these codes and lengths; all other
#: codes, number ranges inside a country, and extensions without x, ext or # are not known and count as invalid.
CALLING_CODES = {"44": (9, 10), "49": (6, 11), "33": (9, 9), "91": (10, 10), "61": (9, 9), "81": (9, 10), "86": (11, 11), "34": (9, 9), "39": (8, 11), "31": (9, 9)}


def address(c: Column) -> Column:
    """The address as compared: trimmed, lower case."""
    return F.lower(trim_ws(c))


def is_email(c: Column) -> Column:
    return F.coalesce(address(c).rlike(EMAIL), F.lit(False))


def email_domain(c: Column) -> Column:
    """What follows the first @."""
    return F.substring_index(F.substr(c, F.instr(c, "@") + 1), "@", -1)


def label_type(c: Column, types: dict[str, str]) -> Column:
    """The type that a label names, else unknown."""
    table = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(trim_ws(c))), F.lit("unknown"))


def phone_parts(raw: Column) -> Column:
    """struct(normalized, country_code, national_number, extension, is_valid) of a number, region US unless it has a +.

    Numbers of the North American plan are valid if area and exchange begin with 2 to 9 and ten digits
    remain; of the codes in CALLING_CODES, if the national length fits. normalized is null for all
    others. A cell without seven digits has no parts: its codes are null too.
    """
    ext = F.nullif(F.regexp_extract(raw, r"(?i)(?:ext\.?|x|#)\s*(\d{1,7})\s*$", 1), F.lit(""))
    body = F.regexp_replace(raw, r"(?i)(?:ext\.?|x|#)\s*\d{1,7}\s*$", "")
    digits = F.regexp_replace(body, r"\D", "")
    plus = F.coalesce(body.rlike(r"^\s*\+"), F.lit(False))
    nanp = r"^1?[2-9]\d{2}[2-9]\d{6}$"
    north = F.when(plus, digits.rlike(r"^1")).otherwise(F.lit(True))
    national = F.when(north, F.regexp_replace(digits, r"^1(?=\d{10}$)", ""))
    valid = F.when(north, F.when(plus, digits.rlike(r"^1[2-9]\d{2}[2-9]\d{6}$")).otherwise(digits.rlike(nanp)))
    code = F.when(north, F.lit("1"))
    for cc, (low, high) in CALLING_CODES.items():
        mine = plus & ~north & digits.startswith(cc)
        rest = F.regexp_replace(F.substr(digits, F.lit(len(cc) + 1)), r"^0", "")
        code = F.coalesce(code, F.when(mine, F.lit(cc)))
        national = F.coalesce(national, F.when(mine, rest))
        valid = F.coalesce(valid, F.when(mine, F.length(rest).between(low, high)))
    found = F.length(digits) >= 7
    valid = F.coalesce(valid, F.lit(False)) & found
    return F.struct(
        F.when(valid, F.concat(F.lit("+"), code, national)).alias("normalized"),
        F.when(found, code).alias("country_code"),
        F.when(found, national).alias("national_number"),
        ext.alias("extension"),
        valid.alias("is_valid"),
    )


def platform(url: Column) -> Column:
    """The platform of the first listed domain that the link contains, else other."""
    low, out = F.lower(url), F
    for domain, name in PLATFORM_DOMAINS.items():
        out = out.when(F.contains(low, F.lit(domain)), name)
    return out.otherwise("other")


def clean_url(url: Column) -> Column:
    """Trimmed, without slashes at the end."""
    return F.regexp_replace(trim_ws(url), "/+$", "")


def username(source: Column) -> Column:
    """The user of a handle (@name) or of a link (first part of its path); null if there is none."""
    s = trim_ws(source)
    path = F.regexp_replace(s, r"(?i)^(?:https?://)?(?:www\.)?[a-z0-9.-]+\.[a-z]{2,}/?", "")
    linked = s.rlike(r"(?i)^(?:https?://|(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}/)")
    first = F.regexp_extract(path, r"^/*([^/?#]+)", 1)
    return F.nullif(F.when(linked, first).otherwise(F.regexp_replace(s, "^@|/+$", "")), F.lit(""))


def find_emails(text: Column) -> Column:
    """Addresses in a text, lower case, in order, without repeats."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({EMAIL_IN_TEXT})"), F.lit(1)), lambda x: F.lower(x)))


def find_phones(text: Column) -> Column:
    """Numbers in a text as written, in order, without repeats."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({PHONE_IN_TEXT})"), F.lit(1)), trim_ws))


def find_urls(text: Column) -> Column:
    """Links in a text without trailing punctuation; of those that differ in case alone the first."""
    from .text import dedupe_ci

    return dedupe_ci(F.transform(F.regexp_extract_all(text, F.lit(f"({URL_IN_TEXT})"), F.lit(1)), lambda x: F.regexp_replace(x, r"[.,;:!?)\]}]+$", "")))

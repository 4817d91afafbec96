"""JSON sources: nested vendor exports read by path mappings over VARIANT values."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contact
from ..functions.text import first_by, split_multi, trim_ws
from ..schemas import EMAILS, LOCATION, PHONES, SKILLS, extracted, record
from .csv import current_role, links

#: Paths of two vendors' exports and of a flat one, and the fields they fill.
NESTED_VENDOR = {
    "first_name": "first_name",
    "last_name": "last_name",
    "email_addresses.0.value": "email",
    "email_addresses.1.value": "email_secondary",
    "phone_numbers.0.value": "phone",
    "addresses.0.value": "location",
    "website_addresses.0.value": "website_url_0",
    "website_addresses.1.value": "website_url_1",
    "social_media_addresses.0.value": "website_url_2",
    "tags": "skills",
    "application.current_employer": "current_company",
    "application.current_title": "current_title",
    "application.resume_text": "summary",
}
LISTING_VENDOR = {
    "name": "full_name",
    "emails.0": "email",
    "phones.0.value": "phone",
    "location": "location",
    "headline": "current_title",
    "summary": "summary",
    "links.0": "website_url_0",
    "links.1": "website_url_1",
    "tags": "skills",
    "origin": "source_label",
}
FLAT = {n: n for n in ("first_name", "last_name", "email", "phone", "location", "summary", "skills", "current_company", "current_title", "linkedin_url", "github_url", "portfolio_url")}


def parse_text(text: Column, fallback: str) -> Column:
    """JSON text as a VARIANT; the fallback, JSON text too, where it is null, blank or unreadable."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit(fallback)))


def json_paths(path: str) -> list[str]:
    """A dotted path as JSON paths: a number is an index, or a key of an object."""
    choices = [(f"[{p}]", f"['{p}']") if p.isdigit() else (f"['{p}']",) for p in path.split(".")]
    return ["$" + "".join(c) for c in product(*choices)]


def value_at(v: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path, null on any miss."""
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in json_paths(path)])


def scalar_at(v: Column, path: str) -> Column:
    """Trimmed text of a scalar; null for a list, an object or a blank."""
    found = value_at(v, path, "variant")
    plain = ~F.schema_of_variant(found).rlike("^(ARRAY|OBJECT)")
    return F.nullif(F.when(plain, trim_ws(value_at(v, path))), F.lit(""))


def strings_at(v: Column, path: str) -> Column:
    """Texts of a list, or of a delimited string; blanks dropped."""
    listed = F.filter(F.transform(value_at(v, path, "array<string>"), trim_ws), lambda x: x != "")
    return F.coalesce(listed, split_multi(scalar_at(v, path)))


def typed_contacts(v: Column, path: str) -> Column:
    """Entries (value, type) of a list of objects or of strings; null entries are left out."""
    kind = "array<struct<value:string,type:string>>"
    entries = F.coalesce(F.try_variant_get(v, json_paths(path)[0], kind), F.array().cast(kind))
    return F.filter(entries, lambda e: F.coalesce(trim_ws(e["value"]), F.lit("")) != "")


def _contacts(mapped: list[Column], typed: Column, key, types: dict[str, str]) -> Column:
    """Mapped values first, of unknown type, then typed ones; of equal ones the first."""
    plain = F.array_compact(F.array(*mapped)) if mapped else F.array().cast("array<string>")
    entry = "array<struct<value:string,type:string>>"
    every = F.concat(F.transform(plain, lambda x: F.struct(x.alias("value"), F.lit("unknown").alias("type"))).cast(entry), F.transform(typed, lambda e: F.struct(trim_ws(e["value"]).alias("value"), contact.label_type(e["type"], types).alias("type"))).cast(entry))
    return first_by(every, lambda e: key(e["value"]))


def read(df: DataFrame, payload: Column, paths: dict[str, str], label: str = "ats", id_path: str = "id", entity_key: Column | None = None, src_ord: Column | None = None, email_arrays: tuple[str, ...] = ("email_addresses",), phone_arrays: tuple[str, ...] = ("phone_numbers", "phones")) -> DataFrame:
    """One extracted record for each JSON payload (text or VARIANT). Unreadable payloads give empty records."""
    df = df.withColumn("__v", F.try_parse_json(payload))
    v = F.col("__v")
    by_field: dict[str, list[str]] = {}
    for path, name in paths.items():
        by_field.setdefault(name, []).append(path)
    null = F.lit(None).cast("string")
    get = lambda n: scalar_at(v, by_field[n][0]) if len(by_field.get(n, ())) == 1 else null
    all_of = lambda *names: [scalar_at(v, p) for n in names for p in by_field.get(n, ())]
    typed_mail = F.concat(*[typed_contacts(v, p) for p in email_arrays])
    typed_phone = F.concat(*[typed_contacts(v, p) for p in phone_arrays])
    mails = _contacts(all_of("email", "email_secondary"), typed_mail, contact.address, contact.EMAIL_TYPES)
    good = F.filter(mails, lambda e: contact.is_email(e["value"]))
    emails = F.transform(good, lambda e, i: record(EMAILS, address=contact.address(e["value"]), type=e["type"], is_primary=i == 0, domain=contact.email_domain(contact.address(e["value"]))))
    bad = F.transform(F.filter(mails, lambda e: ~contact.is_email(e["value"])), lambda e: F.struct(F.lit("email").alias("field"), F.lit("Could not parse email").alias("message"), e["value"].alias("raw")))
    numbers = _contacts(all_of("phone"), typed_phone, lambda x: x, contact.PHONE_TYPES)
    phones = F.transform(numbers, lambda e, i: record(PHONES, raw=e["value"], type=e["type"], is_primary=i == 0, is_valid=F.lit(False)))
    names = F.concat(F.array().cast("array<string>"), *[strings_at(v, p) for p in by_field.get("skills", ())])
    skills = F.transform(names, lambda s: record(SKILLS, name=s, source_context=F.lit(f"ats:{label}:tag"), is_inferred=F.lit(False), github_occurrence_count=F.lit(1)))
    raw = get("location")
    urls = [(get("linkedin_url"), "linkedin"), (get("github_url"), "github"), (get("portfolio_url"), "portfolio"), *[(get(f"website_url_{i}"), None) for i in range(5)]]
    source_id = F.concat(F.lit(f"{label}:"), F.coalesce(scalar_at(v, id_path), F.lit("unknown")))
    return extracted(
        df,
        entity_key=source_id if entity_key is None else entity_key,
        src_ord=F.lit(0) if src_ord is None else src_ord,
        source_type=F.lit("ats_json"),
        source_id=source_id,
        **{n: get(n) for n in ("first_name", "middle_name", "last_name", "full_name", "summary")},
        location=F.when(raw.isNotNull(), record(LOCATION, raw=raw)),
        emails=emails,
        phones=phones,
        skills=skills,
        experience=current_role(get("current_company"), get("current_title")),
        profiles=links(urls),
        warnings=bad,
        metadata=F.create_map(F.lit("source_label"), F.lit(label), F.lit("ats_id"), scalar_at(v, id_path)),
    )

"""Merging the records of each entity.

merge() reads every record once: it becomes one entry for each value, of whatever family, and the group-bys on
(entity, family, key) and on (entity) share one exchange by entity_key. merge_list, merge_scalars and
merge_locations are the same for one family alone, of which only the columns are read. Lists keep the
first item seen of each key, scalars the last; all contributions stay as provenance, in source order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contact import clean_url
from ..functions.ids import uuid5
from ..functions.profile import location_display
from ..functions.text import key_of, let
from ..schemas import EXTRACTED

STRUCTURED = ("csv", "ats_json", "linkedin")


def method_of(source_type: Column) -> Column:
    """How a source's values were found."""
    return F.when(source_type.isin(*STRUCTURED), "structured_field").when(source_type == "github", "api_response").when(source_type == "manual", "manual").otherwise("nlp_heuristic")


def provenance(field: str, raw: Column, method: Column | None = None, item_ord: Column | None = None) -> Column:
    """One contribution of the current row's source."""
    return F.struct(
        F.col("src_ord").alias("src_ord"),
        (F.col("item_ord") if item_ord is None else item_ord).alias("item_ord"),
        F.col("source_type"),
        F.col("source_id"),
        (method_of(F.col("source_type")) if method is None else method).alias("method"),
        F.lit(field).alias("field"),
        raw.alias("raw_value"),
        F.lit(0.0).alias("confidence"),
    )


def _role_key(r: Column) -> Column:
    start = F.coalesce(r["start_date"].cast("string"), F.nullif(r["raw_start"], F.lit("")), F.lit("None"))
    return key_of(F.concat_ws("|", F.coalesce(r["company"], F.lit("")), F.coalesce(r["title"], F.lit("")), start))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


#: For each list family: the key of an item, and its text as provenance shows it.
FAMILIES: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "emails": (lambda e: key_of(e["address"]), lambda e: e["address"]),
    "phones": (lambda p: F.coalesce(F.nullif(p["normalized"], F.lit("")), _digits(p["raw"])), lambda p: p["raw"]),
    "skills": (lambda s: key_of(s["name"]), lambda s: s["name"]),
    "experience": (_role_key, lambda r: F.concat_ws(" at ", r["title"], r["company"])),
    "projects": (_role_key, lambda r: F.concat_ws(" at ", r["title"], r["company"])),
    "education": (lambda e: key_of(F.concat_ws("|", F.coalesce(e["institution"], F.lit("")), F.coalesce(e["degree"], F.lit("")), F.coalesce(e["field"], F.lit("")))), lambda e: e["institution"]),
    "profiles": (lambda p: F.lower(F.concat_ws(":", p["platform"], F.coalesce(F.nullif(p["username"], F.lit("")), clean_url(p["url"])))), lambda p: p["url"]),
}
SCALARS = ("first_name", "middle_name", "last_name", "summary")


def spread(records: DataFrame) -> DataFrame:
    """The records partitioned by entity, which all families then share.

    By number, since adaptive execution would put raw rows together by their size, while each costs far
    more to parse and normalise than to move.
    """
    return records.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity_key")


def merge_list(records: DataFrame, family: str) -> DataFrame:
    """(entity_key, item_key, item, provenance): the distinct items of each entity. Blank keys are left out."""
    key, raw = FAMILIES[family]
    # outer, since for an inner one the planner adds a filter on the list below the exchange, where the list is made once more
    items = records.select("entity_key", "src_ord", "source_type", "source_id", F.posexplode_outer(family).alias("item_ord", "item")).where("item IS NOT NULL")
    method = F.when(F.coalesce(F.col("item.is_inferred"), F.lit(False)), "inferred").otherwise(method_of(F.col("source_type"))) if family == "skills" else None
    rows = items.select("entity_key", key(F.col("item")).alias("item_key"), "item", F.struct("src_ord", "item_ord").alias("ord"), provenance(family, raw(F.col("item")), method).alias("p"))
    rows = rows.where(F.coalesce(F.col("item_key"), F.lit("")) != "")
    more = [F.max("item.github_occurrence_count").alias("n")] if family == "skills" else []
    out = rows.groupBy("entity_key", "item_key").agg(F.min_by("item", "ord").alias("item"), F.sort_array(F.collect_list("p")).alias("provenance"), *more)
    if more:
        out = out.withColumn("item", F.col("item").withField("github_occurrence_count", F.coalesce("n", F.lit(1)).cast("bigint"))).drop("n")
    return out


def merge_scalars(records: DataFrame, fields: tuple[str, ...] = SCALARS) -> DataFrame:
    """(entity_key, field, item_key, value, provenance): the distinct values; of equal ones the last seen shows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    rows = records.select("entity_key", "src_ord", F.lit(0).alias("item_ord"), "source_type", "source_id", pairs.alias("x")).select("*", "x.field", "x.value").drop("x")
    rows = rows.where(F.coalesce(F.col("value"), F.lit("")) != "").withColumn("item_key", key_of(F.col("value")))
    p = provenance("", F.col("value")).withField("field", F.col("field"))
    return rows.groupBy("entity_key", "field", "item_key").agg(F.max_by("value", "src_ord").alias("value"), F.sort_array(F.collect_list(p)).alias("provenance"))


def merge_locations(records: DataFrame) -> DataFrame:
    """(entity_key, field, item_key, value, provenance) of places, by how they are displayed; empty ones are left out."""
    named = F.transform(F.array("location"), lambda x: F.struct(x.alias("location"), location_display(x).alias("shown")))
    keyed = F.transform(named, lambda x: F.struct(x["location"].alias("location"), x["shown"].alias("shown"), key_of(x["shown"]).alias("item_key")))
    rows = records.select("entity_key", "src_ord", F.lit(0).alias("item_ord"), "source_type", "source_id", F.explode_outer(keyed).alias("x")).select("*", "x.*").drop("x")
    rows = rows.where(F.coalesce(F.col("item_key"), F.lit("")) != "")
    p = provenance("location", F.col("shown"))
    return rows.groupBy("entity_key", F.lit("location").alias("field"), "item_key").agg(F.max_by("location", "src_ord").alias("value"), F.sort_array(F.collect_list(p)).alias("provenance"))


def candidate_ids(records: DataFrame) -> DataFrame:
    """(entity_key, candidate_id, merged_from): a UUID of the first address, else first link, else the source ids."""
    place = F.when(F.size("emails") > 0, F.col("src_ord"))
    first_email = F.min_by(F.get(F.col("emails"), 0)["address"], place)
    first_url = F.min_by(F.get(F.col("profiles"), 0)["url"], F.when(F.size("profiles") > 0, F.col("src_ord")))
    ids = F.array_join(F.sort_array(F.collect_list("source_id")), "|")
    merged = F.transform(F.sort_array(F.collect_list(F.struct("src_ord", "source_id"))), lambda x: x["source_id"])
    return records.groupBy("entity_key").agg(uuid5(F.coalesce(first_email, first_url, ids)).alias("candidate_id"), merged.alias("merged_from"))


def _listed(rows: DataFrame, name: str) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("item_key", "item", "provenance")))
    return rows.groupBy("entity_key").agg(items.alias(name))


#: Fields of a merged entity, and the types of their values.
FIELDS = (*SCALARS, "location", *FAMILIES)
_TYPES = {f: "string" for f in SCALARS} | {f: EXTRACTED[f].removeprefix("array<")[: -1 if EXTRACTED[f].startswith("array<") else None] for f in ("location", *FAMILIES)}


def _entries(fields: tuple[str, ...]) -> Column:
    """All values of a record as one list of (family, item_key, ord, x, p), x holding the value in the family's field.

    The smallest ord of a key shows: the first of a list's items, the last of a scalar's sources. What is
    blank is a null entry. Three more families, one entry each, carry what candidate_id and merged_from need.
    """
    src = F.col("src_ord").cast("bigint")

    def entry(family: str, key: Column, order: Column, at: Column, p: Column, value: Column | None = None) -> Column:
        x = F.struct(*[(value if n == family else F.lit(None)).cast(_TYPES[n]).alias(n) for n in fields])
        return F.struct(F.lit(family).alias("family"), key.alias("item_key"), F.struct(order.alias("src"), at.cast("int").alias("at")).alias("ord"), x.alias("x"), p.alias("p"))

    def listed(family: str) -> Column:
        key, raw = FAMILIES[family]

        def one(item: Column, i: Column) -> Column:
            method = F.when(F.coalesce(item["is_inferred"], F.lit(False)), "inferred").otherwise(method_of(F.col("source_type"))) if family == "skills" else None
            return let(key(item), lambda k: F.when(F.coalesce(k, F.lit("")) != "", entry(family, k, src, i, provenance(family, raw(item), method, i.cast("int")), item)))

        return F.transform(F.col(family), one)

    zero = F.lit(0)
    own = [entry("__source", F.lit(""), src, zero, provenance("", F.lit(None).cast("string"), item_ord=zero))]
    if "emails" in fields:
        own.append(F.when(F.size("emails") > 0, entry("__email", F.lit(""), src, zero, provenance("", F.get(F.col("emails"), 0)["address"], item_ord=zero))))
    if "profiles" in fields:
        own.append(F.when(F.size("profiles") > 0, entry("__url", F.lit(""), src, zero, provenance("", F.get(F.col("profiles"), 0)["url"], item_ord=zero))))
    for n in SCALARS:
        if n in fields:
            own.append(F.when(F.coalesce(F.col(n), F.lit("")) != "", entry(n, key_of(F.col(n)), -src, zero, provenance(n, F.col(n), item_ord=zero), F.col(n))))
    parts = [F.array(*own)]
    if "location" in fields:
        shown = F.struct(location_display(F.col("location")).alias("shown"))
        keyed = lambda x: F.struct(x["shown"].alias("shown"), key_of(x["shown"]).alias("key"))
        placed = lambda x: F.array(F.when(F.coalesce(x["key"], F.lit("")) != "", entry("location", x["key"], -src, zero, provenance("location", x["shown"], item_ord=zero), F.col("location"))))
        parts.append(let(shown, lambda x: let(keyed(x), placed)))
    parts += [F.coalesce(listed(f), F.array()) for f in FAMILIES if f in fields]
    return F.concat(*parts)


def merge(records: DataFrame, co_partition: bool = True, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row for each entity: candidate_id, merged_from, and each field as the list of its distinct values.

    Lists hold structs (item_key, item, provenance), scalars and location (item_key, value, provenance),
    sorted by key; resolve() picks the scalars' winners. fields: those that are merged; without emails or
    profiles candidate_id falls back on what is left.

    co_partition deals the records by entity first, after which no group-by needs an exchange. Without it
    the group-by on (entity, family, key) combines before it shuffles: for few entities with very many
    records each.
    """
    own = spread(records) if co_partition else records
    # outer, since for an inner one the planner adds a filter on the list, which then is made twice
    rows = own.select("entity_key", F.explode_outer(_entries(fields)).alias("e")).where("e IS NOT NULL").select("entity_key", "e.*")
    more = [F.max("x.skills.github_occurrence_count").alias("n")] if "skills" in fields else []
    keyed = rows.groupBy("entity_key", "family", "item_key").agg(F.min_by("x", "ord").alias("x"), F.sort_array(F.collect_list("p")).alias("provenance"), *more)
    of = lambda family, c: F.collect_list(F.when(F.col("family") == family, c))

    def merged(n: str) -> Column:
        value = F.col("x")[n]
        if n == "skills":
            value = value.withField("github_occurrence_count", F.coalesce("n", F.lit(1)).cast("bigint"))
        return F.sort_array(of(n, F.struct("item_key", value.alias("item" if n in FAMILIES else "value"), "provenance"))).alias(n)

    out = keyed.groupBy("entity_key").agg(*[merged(n) for n in fields], *[F.flatten(of(f, F.col("provenance"))).alias(f) for f in ("__source", "__email", "__url")])
    first = lambda f: F.get(F.col(f), 0)["raw_value"]
    ids = F.array_join(F.sort_array(F.transform("__source", lambda x: x["source_id"])), "|")
    sources = F.sort_array(F.transform("__source", lambda x: F.struct(x["src_ord"], x["source_id"])))
    return out.select(
        "entity_key",
        uuid5(F.coalesce(first("__email"), first("__url"), ids)).alias("candidate_id"),
        F.transform(sources, lambda x: x["source_id"]).alias("merged_from"),
        *fields,
    )


def flat_provenance(canonical: DataFrame, fields: tuple[str, ...] | None = None) -> Column:
    """A map from each field that has any to its contributions."""
    names = fields or FIELDS
    entries = [F.struct(F.lit(n).alias("key"), F.flatten(F.transform(F.col(n), lambda x: x["provenance"])).alias("value")) for n in names]
    return F.map_filter(F.map_from_entries(F.array(*entries)), lambda k, v: F.size(v) > 0)

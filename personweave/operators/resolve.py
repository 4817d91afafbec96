"""Conflict resolution: rank and pick."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profile import location_display
from ..functions.text import let
from .merge import SCALARS

STRUCTURED = ("ats_json", "csv", "linkedin", "github", "manual")


def _rank(option: Column, shown: Callable[[Column], Column]) -> Column:
    """Structured source, highest confidence, newest source, then the largest text."""
    p = option["provenance"]
    structured = F.exists(p, lambda x: x["source_type"].isin(*STRUCTURED)).cast("int")
    return F.struct(
        structured.alias("structured"),
        F.array_max(F.transform(p, lambda x: x["confidence"])).alias("confidence"),
        F.array_max(F.transform(p, lambda x: x["src_ord"])).alias("newest"),
        F.lit(0).alias("company_length"),
        F.lower(shown(option["value"])).alias("text"),
    )


def resolve_field(options: Column, shown: Callable[[Column], Column] = lambda v: v) -> Column:
    """struct(value, provenance, conflicts) of the option that ranks highest; null if there is none."""
    ranked = F.transform(options, lambda o: F.struct(_rank(o, shown).alias("rank"), o["item_key"].alias("item_key"), o["value"].alias("value"), o["provenance"].alias("provenance")))

    def settled(best: Column) -> Column:
        losers = F.filter(options, lambda o: F.lower(shown(o["value"])) != best["rank"]["text"])
        return F.struct(best["value"].alias("value"), best["provenance"].alias("provenance"), losers.alias("conflicts"))

    return F.when(F.size(options) > 0, let(F.array_max(ranked), settled))


def order_roles(items: Column) -> Column:
    """Undated roles first, then the newest; ties by company and title in lower case, descending, then in the list's order."""
    keyed = F.transform(
        items,
        lambda x, i: F.struct(
            x["item"]["start_date"].isNull().alias("undated"),
            F.coalesce(x["item"]["start_date"].cast("string"), x["item"]["raw_start"], F.lit("")).alias("start"),
            F.lower(F.coalesce(x["item"]["company"], F.lit(""))).alias("company"),
            F.lower(F.coalesce(x["item"]["title"], F.lit(""))).alias("title"),
            (-i).alias("place"),
            x.alias("x"),
        ),
    )
    return F.transform(F.sort_array(keyed, asc=False), lambda k: k["x"])


def resolve(merged: DataFrame) -> DataFrame:
    """Merged entities with one value a scalar, its conflicts kept, and roles in order, of the fields that were merged."""
    out = {n: resolve_field(F.col(n)) for n in SCALARS}
    out["location"] = resolve_field(F.col("location"), location_display)
    out["experience"] = order_roles(F.col("experience"))
    return merged.withColumns({n: c for n, c in out.items() if n in merged.columns})

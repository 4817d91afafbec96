"""Confidence scoring.

Votes (source weight x method weight x quality, rounded to four places) are computed once in Python and
embedded as a literal map, so that decimal ties round as they do there; all later steps add and clamp
numbers of four places.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profile import location_display
from ..functions.text import let
from .merge import FAMILIES, SCALARS

DEFAULT_WEIGHT = 0.50


@dataclass(frozen=True)
class Formula:
    """Weights, bonuses and penalties; the defaults are fixed values."""

    sources: dict[str, float] = field(default_factory=lambda: {"ats_json": 0.95, "csv": 0.90, "linkedin": 0.88, "github": 0.82, "manual": 0.80, "resume": 0.80, "recruiter_notes": 0.62})
    methods: dict[str, float] = field(default_factory=lambda: {"api_response": 0.98, "structured_field": 0.95, "manual": 0.90, "regex": 0.78, "nlp_heuristic": 0.70, "inferred": 0.62})
    importance: dict[str, float] = field(
        default_factory=lambda: {"emails": 1.00, "phones": 0.85, "first_name": 0.75, "last_name": 0.75, "location": 0.55, "summary": 0.40, "skills": 0.80, "experience": 0.90, "projects": 0.70, "education": 0.60, "profiles": 0.45}
    )
    other_importance: float = 0.25
    github_skill: float = 0.95
    invalid_phone: float = 0.65
    agreement: float = 0.04
    most_agreement: float = 0.12
    conflict: float = 0.08
    inferred_ceiling: float = 0.70
    both_attest: float = 0.10
    repeated_skill: float = 0.05

    def vote(self, source: str, method: str, quality: float = 1.0, is_skill: bool = False) -> float:
        weight = self.github_skill if is_skill and source == "github" else self.sources.get(source, DEFAULT_WEIGHT)
        return min(1.0, max(0.0, round(weight * self.methods.get(method, DEFAULT_WEIGHT) * quality, 4)))

    def votes(self, is_skill: bool = False) -> list[tuple[str, str, float, float]]:
        """(source, method, vote, vote of an invalid phone), with "" for any other name."""
        return [(s, m, self.vote(s, m, 1.0, is_skill), self.vote(s, m, self.invalid_phone, is_skill)) for s in (*self.sources, "") for m in (*self.methods, "")]


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(c, 4)))


def field_confidence(p: Column, formula: Formula, conflicts: Column | None = None, quality_ok: Column | None = None, inferred: Column | None = None, is_skill: bool = False, evidence: Column | None = None) -> Column:
    """The confidence of a value from its provenance; 0 without any."""
    table = F.create_map(*[F.lit(x) for s, m, v, w in formula.votes(is_skill) for x in (f"{s}|{m}|1", v, f"{s}|{m}|0", w)])
    known = lambda c, names: F.when(c.isin(*names), c).otherwise("")
    ok = F.lit("1") if quality_ok is None else F.when(quality_ok, "1").otherwise("0")
    votes = F.transform(p, lambda x: F.element_at(table, F.concat_ws("|", known(x["source_type"], formula.sources), known(x["method"], formula.methods), ok)))
    sources = F.size(F.array_distinct(F.transform(p, lambda x: F.struct(x["source_type"], x["source_id"]))))
    bonus = F.least((sources - 1) * F.lit(formula.agreement), F.lit(formula.most_agreement))
    penalty = (F.lit(0) if conflicts is None else conflicts) * F.lit(formula.conflict)
    github = F.exists(p, lambda x: x["source_type"] == "github")
    both = github & F.exists(p, lambda x: x["source_type"] != "github")
    found = F.struct(clamp(F.array_max(votes) + bonus - penalty).alias("c"), github.alias("github"), both.alias("both"))

    def adjusted(x: Column) -> Column:
        out = x["c"]
        if inferred is not None:
            ceiling = F.when(F.coalesce(inferred, F.lit(False)) & ~x["both"], formula.inferred_ceiling).otherwise(1.0)
            out = F.least(out, ceiling)
        out = clamp(out + F.when(x["both"], formula.both_attest).otherwise(0.0))
        if is_skill and evidence is not None:
            out = clamp(out + F.when(x["github"] & (evidence > 1), formula.repeated_skill).otherwise(0.0))
        return out

    return F.when(F.size(p) > 0, let(found, adjusted)).otherwise(0.0)


def item_confidence(family: str, item: Column, p: Column, formula: Formula) -> Column:
    """The confidence of a list's item."""
    if family == "phones":
        return field_confidence(p, formula, quality_ok=F.coalesce(item["is_valid"], F.lit(False)))
    if family == "skills":
        return field_confidence(p, formula, inferred=item["is_inferred"], is_skill=True, evidence=item["github_occurrence_count"])
    return field_confidence(p, formula)


def _scored_list(family: str, formula: Formula) -> Column:
    return F.transform(F.col(family), lambda x: F.struct(x["item_key"].alias("item_key"), x["item"].alias("item"), x["provenance"].alias("provenance"), item_confidence(family, x["item"], x["provenance"], formula).alias("confidence")))


def _scored_scalar(name: str, formula: Formula) -> Column:
    c = F.col(name)
    p = F.filter(c["provenance"], lambda x: x["source_type"] != "github") if name.endswith("_name") else c["provenance"]
    return F.when(c.isNotNull(), c.withField("confidence", field_confidence(p, formula, conflicts=F.size(c["conflicts"]))))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def overall(fields: dict[str, Column], formula: Formula) -> Column:
    """The mean of the fields that are present, weighted by importance, added up in the fields' order."""
    top = bottom = F.lit(0.0)
    for name, c in fields.items():
        weight = formula.importance.get(name, formula.other_importance)
        top = top + F.when(c.isNotNull(), c * weight).otherwise(0.0)
        bottom = bottom + F.when(c.isNotNull(), F.lit(weight)).otherwise(0.0)
    return F.when(bottom > 0, clamp(top / bottom)).otherwise(0.0)


def score(resolved: DataFrame, formula: Formula | None = None) -> DataFrame:
    """Resolved entities with a confidence on every value, field_confidences and overall_confidence.

    Every item has its own; a field has the highest of addresses and numbers, the mean of other lists.
    """
    formula = formula or Formula()
    scalars = (*SCALARS, "location")
    scored = resolved.withColumns({n: _scored_scalar(n, formula) for n in scalars} | {f: _scored_list(f, formula) for f in FAMILIES})
    of = {n: F.col(n)["confidence"] for n in scalars}
    for f in FAMILIES:
        each = F.transform(F.col(f), lambda x: x["confidence"])
        of[f] = F.when(F.size(f) > 0, F.array_max(each) if f in ("emails", "phones") else _mean(each))
    parts = scored.withColumns({f"__c_{n}": c for n, c in of.items()})
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"__c_{n}").alias("value")) for n in of])
    confidences = F.map_filter(F.map_from_entries(entries), lambda k, v: v.isNotNull())
    return parts.withColumns({"field_confidences": confidences, "overall_confidence": overall({n: F.col(f"__c_{n}") for n in of}, formula)}).drop(*[f"__c_{n}" for n in of])


def needs_review(threshold: float = 0.70) -> Column:
    return F.col("overall_confidence") < threshold


def ranked_skills(skills: Column) -> Column:
    """Names by confidence, highest first, ties in the list's order."""
    placed = F.transform(skills, lambda x, i: F.struct((-x["confidence"]).alias("c"), i.alias("i"), x["item"]["name"].alias("name")))
    return F.transform(F.sort_array(placed), lambda x: x["name"])


def primary(items: Column, flag: str = "is_primary") -> Column:
    """The first flagged item, else the first."""
    flagged = F.filter(items, lambda x: F.coalesce(x["item"][flag], F.lit(False)))
    return F.coalesce(F.get(flagged, 0), F.get(items, 0))["item"]


def with_derived(scored: DataFrame) -> DataFrame:
    """Scored entities with display_name, primary_email, primary_phone and location_display."""
    name = F.concat_ws(" ", F.col("first_name.value"), F.col("last_name.value"))
    phone = primary(F.col("phones"))
    return scored.withColumns(
        {
            "display_name": F.nullif(name, F.lit("")),
            "primary_email": primary(F.col("emails"))["address"],
            "primary_phone": F.coalesce(phone["normalized"], phone["raw"]),
            "location_display": F.when(F.col("location").isNotNull(), location_display(F.col("location.value"))),
        }
    )

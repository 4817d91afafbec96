"""Lineage builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def record(field: str, value: Column, source_type: str, source_id: Column, raw_value: Column | None = None, confidence: float = 1.0, method: str = "structured_field") -> Column:
    """A struct of lineage for a value; null if the value is. The confidence is clamped to [0, 1]."""
    out = F.struct(
        F.lit(field).alias("field"),
        value.cast("string").alias("value"),
        F.lit(source_type).alias("source_type"),
        source_id.alias("source_id"),
        F.lit(method).alias("method"),
        (value if raw_value is None else raw_value).cast("string").alias("raw_value"),
        F.lit(min(1.0, max(0.0, confidence))).alias("confidence"),
    )
    return F.when(value.isNotNull(), out)


def confidence_field(value: Column, lineage: Column) -> Column:
    """A value with its confidence, its lineage and no conflicts."""
    return F.struct(value.alias("value"), lineage["confidence"].alias("confidence"), F.array_compact(F.array(lineage)).alias("provenance"))


def batch(lineages: list[Column]) -> Column:
    """All lineages that are not null."""
    return F.array_compact(F.array(*lineages))

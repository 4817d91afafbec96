"""The whole fusion: records of all sources -> one scored entity each -> its output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..operators.merge import merge
from ..operators.normalize import normalize
from ..operators.resolve import resolve
from ..operators.score import Formula, score, with_derived
from .projection import project
from .validation import validate


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources' records in one frame; src_ord says which comes first."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def fuse(sources: list[DataFrame], as_of: str, formula: Formula | None = None, staged: str | None = None, co_partition: bool = True) -> DataFrame:
    """One scored entity for each entity_key.

    staged: a shared path where the normalised records are written once, so that the families, each of
    which reads its own columns, scan columnar files instead of parsing the sources again.
    """
    records = normalize(union_sources(sources), as_of, with_logs=False)
    if staged:
        records.write.mode("overwrite").parquet(staged)
        records = records.sparkSession.read.schema(records.schema).parquet(staged)
    return with_derived(score(resolve(merge(records, co_partition)), formula))


def generate_output(canonical: DataFrame, config: dict, schema: dict | None = None, strict: bool = False) -> DataFrame:
    """Entities projected by a configuration and, if a schema is given, validated."""
    out = project(canonical, config, strict)
    return validate(out, "output", schema, strict) if schema else out

"""Texts read by a language model: its answers are landed once, then read, with the rules as fallback.

The model is a function of the caller's, text -> JSON text, so any client fits in, and none is needed here.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, NumericType, StructType

from ..functions.text import content_hash
from ..schemas import EXTRACTED, WARNINGS, extracted
from ..session import importable
from . import sectioned
from .coerce import coercer

ATTEMPTS, WAIT = 2, 1.0
#: What the record says itself, not the model.
OWN = ("entity_key", "src_ord", "source_type", "source_id", "warnings", "raw_text", "metadata")


class Temporary(Exception):
    """What a model function raises for a failure that is worth another attempt."""


def _json_schema(kind: DataType) -> dict:
    if isinstance(kind, StructType):
        return {"type": ["object", "null"], "properties": {f.name: _json_schema(f.dataType) for f in kind.fields}}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": _json_schema(kind.elementType)}
    if isinstance(kind, MapType):
        return {"type": ["object", "null"]}
    name = "boolean" if isinstance(kind, BooleanType) else "integer" if isinstance(kind, IntegralType) else "number" if isinstance(kind, NumericType) else "string"
    return {"type": [name, "null"]}


def answer_schema(df: DataFrame) -> dict:
    """The JSON Schema of a model's answer: the fields of an extracted record that are read from a text."""
    fields = extracted(df.limit(0)).schema.fields
    return {"type": "object", "properties": {f.name: _json_schema(f.dataType) for f in fields if f.name not in OWN}}


def unfenced(text: str) -> str:
    """An answer without the code fence that some models put around it."""
    return text.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()


def land(df: DataFrame, complete: Callable[[str], str], path: str, text: str = "text", attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """The rows with `profile` (the answer's JSON, brought to the schema) and `failure`, written once to a shared path.

    Blank texts are not sent. A Temporary failure is tried again after `wait` seconds, `attempts` times in all;
    any other, an empty answer and one that is no JSON object give a null profile and say why.
    """
    importable(df.sparkSession)
    schema, at = json.dumps(answer_schema(df)), df.columns.index(text)
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    columns = [f.dataType.simpleString() for f in df.schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = coercer(json.loads(schema))

        def ask(own: str) -> str:
            for left in reversed(range(attempts)):
                try:
                    return complete(own)
                except Temporary:
                    if not left:
                        raise
                    time.sleep(wait)
            raise ValueError("no attempt")

        def one(own: str | None) -> tuple[str | None, str | None]:
            if not (own or "").strip():
                return None, None
            try:
                found = json.loads(unfenced(ask(own) or ""))
                if not isinstance(found, dict):
                    raise ValueError("not an object")
                return json.dumps(apply(found), ensure_ascii=False), None
            except Exception as error:  # noqa: BLE001  whatever the model's client raises ends in the rules
                return None, f"{type(error).__name__}: {error}"

        for batch in batches:
            found = [one(t) for t in batch.column(at).to_pylist()]
            made = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "profile", "failure"])

    kind = ", ".join([*(f"c{k} {t}" for k, t in enumerate(columns)), "profile string, failure string"])
    plain.mapInArrow(run, kind).toDF(*df.columns, "profile", "failure").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read(landed: DataFrame, text: str = "text", entity_key: Column | None = None, src_ord: Column | None = None) -> DataFrame:
    """One extracted record for each landed row: from its profile, else by the rules, with a warning if the model failed."""
    t = F.col(text)
    fields = ", ".join(f"{n}: {k}" for n, k in EXTRACTED.items() if n not in OWN)
    answered = landed.where("profile IS NOT NULL").withColumn("__p", F.from_json("profile", f"struct<{fields}>"))
    source_id = F.concat(F.lit("resume:"), content_hash(F.coalesce(t, F.lit("")), 12))
    made = {n: F.coalesce(F.col("__p")[n], F.array()) if k.startswith("array") else F.col("__p")[n] for n, k in EXTRACTED.items() if n not in OWN}
    own = extracted(
        answered,
        entity_key=source_id if entity_key is None else entity_key,
        src_ord=F.lit(0) if src_ord is None else src_ord,
        source_type=F.lit("resume"),
        source_id=source_id,
        raw_text=t,
        **made,
    )
    said = F.struct(F.lit("raw_text").alias("field"), F.concat(F.lit("The model failed, read by rules: "), F.col("failure")).alias("message"), F.lit(None).cast("string").alias("raw"))
    others = landed.where("profile IS NULL").withColumn("warnings", F.when(F.col("failure").isNotNull(), F.array(said)).otherwise(F.array()).cast(WARNINGS))
    return own.unionByName(sectioned.read(others, text, entity_key, src_ord))

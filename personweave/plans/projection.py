"""Projection: a run-time configuration compiled once into Catalyst expressions.

Every rule becomes a node: a typed column or a JSON text, with an error text (null if none) and a flag
that leaves the field out. Paths are resolved against the schema while compiling, so unknown ones cost
nothing; objects are assembled as JSON text, which keeps null and absent fields apart at any depth.
"""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import contact, profile

HIDDEN_CONFIDENCE = ("confidence", "field_confidences", "overall_confidence")


@dataclass
class Config:
    """What a configuration says, and warnings about it."""

    fields: list | dict = field(default_factory=list)
    hide_confidence: bool = False
    hide_provenance: bool = False
    include_confidence: bool = True
    include_provenance: bool = True
    on_missing: str = "null"
    missing_value: Any = None
    confidence_range: dict | None = None
    warnings: list[str] = field(default_factory=list)
    asked: frozenset[str] = frozenset()

    @classmethod
    def load(cls, given: Config | dict | str | Path) -> Config:
        """From a dict or a JSON file; an invalid confidence range becomes [0, 1] with a warning."""
        if isinstance(given, Config):
            return given
        data = dict(given) if isinstance(given, dict) else json.loads(Path(given).read_text(encoding="utf-8"))
        known = {k: v for k, v in data.items() if k in cls.__dataclass_fields__ and k not in ("warnings", "asked")}
        out = cls(**known, asked=frozenset(data))
        if "confidence_range" in data:
            r = data["confidence_range"]
            low, high = (r.get("min"), r.get("max")) if isinstance(r, dict) else (None, None)
            number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
            if not (number(low) and number(high) and low < high):
                # fixed text
                out.warnings = [f"Invalid confidence range (min={low}, max={high}). Falling back to default range [0.0, 1.0]."]
                out.confidence_range = {"min": 0.0, "max": 1.0}
        return out

    def hidden(self) -> set[str]:
        out = set(HIDDEN_CONFIDENCE) if self.hide_confidence or not self.include_confidence else set()
        return out | ({"provenance"} if self.hide_provenance or not self.include_provenance else set())

    def injected(self) -> list[str]:
        """Metadata that the configuration includes explicitly."""
        return [n for n in ("confidence", "provenance") if f"include_{n}" in self.asked and getattr(self, f"include_{n}") and not getattr(self, f"hide_{n}")]


@dataclass
class Node:
    """A compiled value: a typed column (kind) or a JSON text (kind None, and whether it is a list)."""

    column: Column
    kind: T.DataType | None
    is_list: bool = False
    error: Column | None = None
    omit: Column | None = None
    present: Column | None = None  # whether a JSON text stands for a value; always if None


def null() -> Column:
    return F.lit(None).cast("string")


def inject(fields: list | dict, config: Config) -> list | dict:
    """The rules with confidence and provenance added where they are included explicitly and absent."""
    out = copy.deepcopy(fields)
    if isinstance(out, list):
        for d in out:
            if isinstance(d, dict) and "fields" in d:
                d["fields"] = inject(d["fields"], config)
        names = {x for d in out if isinstance(d, dict) for x in (d.get("path"), d.get("from"))}
        return out + [{"path": n, "from": n} for n in config.injected() if n not in {x for d in fields if isinstance(d, dict) for x in (d.get("path"), d.get("from"))} and n not in names]
    if isinstance(out, dict):
        for rule in out.values():
            if not isinstance(rule, dict):
                continue
            if "fields" in rule:
                rule["fields"] = inject(rule["fields"], config)
            elif isinstance(rule.get("array"), dict) and "fields" in rule["array"]:
                rule["array"]["fields"] = inject(rule["array"]["fields"], config)
        return out | {n: n for n in config.injected() if n not in out}
    return out


def _prune(column: Column, kind: T.DataType, hidden: set[str]) -> tuple[Column, T.DataType]:
    """The column without hidden struct fields and map keys, at any depth."""
    if not hidden:
        return column, kind
    if isinstance(kind, T.StructType):
        parts = [(f.name, *_prune(column[f.name], f.dataType, hidden)) for f in kind.fields if f.name not in hidden]
        out = T.StructType([T.StructField(n, k) for n, _, k in parts])
        return (F.when(column.isNotNull(), F.struct(*[c.alias(n) for n, c, _ in parts])) if parts else null()), out
    if isinstance(kind, T.ArrayType):
        inner: list[T.DataType] = []

        def one(x: Column) -> Column:
            c, k = _prune(x, kind.elementType, hidden)
            inner.append(k)
            return c

        return F.transform(column, one), T.ArrayType(inner[0])
    if isinstance(kind, T.MapType):
        return F.map_filter(column, lambda k, v: ~k.isin(*hidden)), kind
    return column, kind


def to_text(node: Node, hidden: set[str]) -> Column:
    """The JSON text of a node."""
    if node.kind is None:
        return F.coalesce(node.column, F.lit("null"))
    column, _ = _prune(node.column, node.kind, hidden)
    whole = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _object(parts: list[tuple[str, Node]], hidden: set[str]) -> Column:
    """An object's JSON text; fields that are left out are absent."""
    texts = []
    for name, node in parts:
        if name in hidden:
            continue
        text = F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), to_text(node, hidden))
        texts.append(text if node.omit is None else F.when(~node.omit, text))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>"), ","), F.lit("}"))


def _first_error(nodes: list[Node]) -> Column | None:
    errors = [n.error for n in nodes if n.error is not None]
    return F.coalesce(*errors) if errors else None


class Compiler:
    """Compiles rules against one schema."""

    def __init__(self, config: Config):
        self.config, self.hidden = config, config.hidden()

    def lookup(self, source: Node, path: str | None) -> Node:
        """The value at a dotted path through structs and maps; null if there is none. Lists are not entered."""
        node = source
        for part in path.split(".") if path else []:
            kind = node.kind
            if isinstance(kind, T.StructType):
                names = kind.fieldNames()
                part = "overall_confidence" if part == "confidence" and "overall_confidence" in names else part
                if part not in names:
                    return Node(null(), T.StringType())
                node = Node(node.column[part], kind[part].dataType)
            elif isinstance(kind, T.MapType):
                node = Node(F.try_element_at(node.column, F.lit(part)), kind.valueType)
            else:
                return Node(null(), T.StringType())
        return node

    def rescale(self, node: Node) -> Node:
        r = self.config.confidence_range
        if r is None or not isinstance(node.kind, T.NumericType):
            return node
        low, high = float(r["min"]), float(r["max"])
        return Node(F.round(F.lit(low) + node.column * F.lit(high - low), 4), T.DoubleType())

    # the list form

    def descriptor(self, source: Node, desc: dict, label: str) -> Node:
        """from or path, then rescale, missing, normalize, nested fields or array, type."""
        path = desc.get("from") or desc.get("path")
        node = self.lookup(source, path) if path else source
        if label == "confidence" or (path and path.split(".")[-1] in ("confidence", "overall_confidence")):
            node = self.rescale(node)
        missing, policy = node.column.isNull(), self.config.on_missing
        error = omit = None
        if desc.get("required") or policy == "error":
            # fixed text, as are those below that name a field
            error = F.when(missing, f"Required field '{label or path or 'unknown'}' (from '{path}') could not be resolved.")
        elif policy == "omit":
            omit = missing
        if desc.get("normalize"):
            node = self.normalized(node, desc["normalize"].lower())
        inner = None
        if isinstance(node.kind, T.ArrayType) and "fields" in desc:
            inner = self.mapped(node, desc["fields"])
        elif "array" in desc:
            inner = self.mapped(node, (desc["array"] or {}).get("fields"))
        elif "fields" in desc:
            inner = self.nested(node, desc["fields"])
        if inner is not None:
            nested_error = inner.error
            node = Node(F.when(~missing, inner.column), None, inner.is_list)
            if nested_error is not None:
                nested_error = F.when(~missing, nested_error)
                error = nested_error if error is None else F.coalesce(error, nested_error)
        if desc.get("type"):
            node = self.coerced(node, desc["type"].lower(), missing)
        node.error, node.omit = error, omit
        return node

    def parts(self, source: Node, fields: list | dict) -> list[tuple[str, Node]]:
        if isinstance(fields, dict):
            return [(name, self.rule(source, rule)) for name, rule in fields.items()]
        named = [(d.get("path"), d) for d in fields if isinstance(d, dict)]
        return [(name, self.descriptor(source, d, name or "")) for name, d in named if name]

    def nested(self, source: Node, fields: list | dict) -> Node:
        parts = self.parts(source, fields)
        return Node(_object(parts, self.hidden), None, error=_first_error([n for _, n in parts]))

    def mapped(self, node: Node, fields: list | dict | None) -> Node:
        """A list with each item mapped; a value that is no list counts as a list of it."""
        if not isinstance(node.kind, T.ArrayType):
            node = Node(F.array(node.column), T.ArrayType(node.kind))
        if not fields:
            return Node(to_text(node, self.hidden), None, True)
        element = node.kind.elementType
        has_error = self.nested(Node(F.lit(None).cast(element), element), fields).error is not None
        texts = F.transform(node.column, lambda x: self.nested(Node(x, element), fields).column)
        error = None
        if has_error:
            error = F.get(F.filter(F.transform(node.column, lambda x: self.nested(Node(x, element), fields).error), lambda e: e.isNotNull()), 0)
        return Node(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")), None, True, error)

    def normalized(self, node: Node, how: str) -> Node:
        """e164, iso3166, canonical; other names change nothing."""
        if how not in ("e164", "iso3166", "canonical") or isinstance(node.kind, (T.ArrayType, T.StructType, T.MapType)):
            return node
        text = node.column.cast("string")
        made = {
            "e164": lambda: F.coalesce(contact.phone_parts(text)["normalized"], text),
            "iso3166": lambda: profile.country_code(text),
            "canonical": lambda: profile.skill_name(text, profile.MORE_SKILL_ALIASES),
        }[how]()
        return Node(made, T.StringType())

    def coerced(self, node: Node, to: str, missing: Column) -> Node:
        """string, integer, number, boolean, array or object; null stays null."""
        plain = node.kind is not None and not isinstance(node.kind, (T.ArrayType, T.StructType, T.MapType))
        text = node.column.cast("string") if plain else to_text(node, self.hidden)
        if to in ("string", "str"):
            if isinstance(node.kind, T.ArrayType):
                items = F.transform(node.column, lambda x: x.cast("string"))
                return Node(F.when(~missing, F.array_join(items, "\n", "None")), T.StringType())
            if isinstance(node.kind, T.BooleanType):
                text = F.initcap(text)
            return Node(F.when(~missing, text), T.StringType())
        if to in ("integer", "int"):
            return Node(F.when(~missing, F.coalesce(text.try_cast("double").try_cast("bigint"), F.lit(0)).cast("bigint")), T.LongType())
        if to in ("number", "float"):
            return Node(F.when(~missing, F.coalesce(text.try_cast("double"), F.lit(0.0))), T.DoubleType())
        if to in ("boolean", "bool"):
            if isinstance(node.kind, T.StringType):
                return Node(F.lower(node.column).isin("true", "1", "yes"), T.BooleanType())
            if isinstance(node.kind, (T.ArrayType, T.MapType)):
                return Node(F.when(~missing, F.size(node.column) > 0), T.BooleanType())
            if plain:
                return Node(node.column.cast("boolean"), T.BooleanType())
            return Node(F.when(~missing, ~node.column.isin("{}", "[]") if node.kind is None else F.lit(True)), T.BooleanType())
        if to == "array" and not (node.is_list or isinstance(node.kind, T.ArrayType)):
            return Node(F.when(~missing, F.concat(F.lit("["), to_text(node, self.hidden), F.lit("]"))), None, True)
        is_object = isinstance(node.kind, (T.StructType, T.MapType)) or node.kind is None and not node.is_list
        if to == "object" and not is_object:
            return Node(F.when(~missing, F.concat(F.lit('{"value":'), to_text(node, self.hidden), F.lit("}"))), None)
        return node

    # the dict form

    def rule(self, source: Node, rule: Any) -> Node:
        """A path, a literal, or path with array, flatten or fields; `missing` stands for what is not found."""
        if isinstance(rule, str):
            return self.or_missing(self.lookup(source, rule), self.config.missing_value)
        if not isinstance(rule, dict):
            return self.literal(rule)
        missing = rule.get("missing", self.config.missing_value)
        node = self.lookup(source, rule["path"]) if rule.get("path") else source
        if "array" in rule:
            inner = self.mapped(node, (rule["array"] or {}).get("fields"))
            return self.or_missing(Node(F.when(node.column.isNotNull(), inner.column), None, True, inner.error), missing)
        if rule.get("flatten"):
            flat = [(n, x) for n, x in self.flattened(node, rule.get("prefix", ""))]
            return self.or_missing(Node(F.when(node.column.isNotNull(), _object(flat, self.hidden)), None), missing)
        if "fields" in rule:
            inner = self.nested(node, rule["fields"])
            return self.or_missing(Node(F.when(node.column.isNotNull(), inner.column), None, error=inner.error), missing)
        return self.or_missing(node, missing)

    def flattened(self, node: Node, prefix: str) -> list[tuple[str, Node]]:
        """Fields of nested structs, their names joined by _."""
        if not isinstance(node.kind, T.StructType):
            return [(prefix.rstrip("_") or "value", node)]
        out = []
        for f in node.kind.fields:
            child = Node(node.column[f.name], f.dataType)
            if isinstance(f.dataType, T.StructType):
                out += self.flattened(child, f"{prefix}{f.name}_")
            else:
                out.append((f"{prefix}{f.name}", child))
        return out

    def literal(self, value: Any) -> Node:
        return Node(F.lit(json.dumps(value, ensure_ascii=False)) if value is not None else null(), None, isinstance(value, list))

    def or_missing(self, node: Node, missing: Any) -> Node:
        if missing is None:
            return node
        text = F.coalesce(F.when(node.column.isNotNull(), to_text(node, self.hidden)), F.lit(json.dumps(missing, ensure_ascii=False)))
        return Node(text, None, node.is_list, node.error)

    # both

    def top(self, source: Node) -> list[tuple[str, Node]]:
        fields, out = inject(self.config.fields, self.config), []
        if isinstance(fields, list):
            for d in fields:
                name = d.get("path") or d.get("from")
                if name:
                    out.append((name, self.descriptor(source, d, name)))
            return out
        for name, rule in fields.items():
            node = self.rule(source, rule)
            if name == "confidence":
                node = self.rescale(node) if node.kind is not None else node
            if self.config.on_missing == "error":
                node.error = F.when(node.column.isNull(), f"Required field '{name}' could not be resolved.") if node.error is None else node.error
            elif self.config.on_missing == "omit":
                node.omit = node.column.isNull()
            out.append((name, node))
        return out


def project(df: DataFrame, config: Config | dict | str | Path, strict: bool = False, output: str = "output") -> DataFrame:
    """The rows with `output` (JSON text), `errors` (of fields that could not be projected) and `warnings`.

    A field with an error is absent from the output, which keeps all others. strict: any error fails
    the query.
    """
    config = Config.load(config)
    compiler = Compiler(config)
    source = Node(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)
    parts = compiler.top(source)
    for _, node in parts:
        if node.error is not None:
            bad = node.error.isNotNull()
            node.omit = bad if node.omit is None else node.omit | bad
    errors = [F.when(n.error.isNotNull(), F.concat(F.lit(f"Field '{name}': "), n.error)) for name, n in parts if n.error is not None]
    found = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    text = _object(parts, compiler.hidden)
    if strict and errors:
        text = F.when(F.size(found) > 0, F.raise_error(F.concat(F.lit("Projection completed with errors: "), F.array_join(found, "; ")))).otherwise(text)
    warnings = F.array(*[F.lit(w) for w in config.warnings]) if config.warnings else F.array()
    return df.select("*", text.alias(output), found.alias("errors"), warnings.cast("array<string>").alias("warnings"))

"""What every source goes through: its rows are checked, then extracted, and the records are checked as well.

Errors of a whole source (a column that is missing, records of another shape) are SourceError and arise when the plan
is made; errors of single rows are warnings of their records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..schemas import EXTRACTED, SOURCE_TYPES


class SourceError(RuntimeError):
    """A source that cannot be read at all."""


@dataclass(frozen=True)
class Source:
    """A kind of source: `extract` takes rows (and options) to extracted records, `needs` names columns that the rows must have."""

    name: str
    source_type: str
    extract: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.source_type not in SOURCE_TYPES:
            raise ValueError(f"{self.source_type} is no type of source")

    def validate(self, rows: DataFrame) -> None:
        """SourceError if the rows lack a column of that very name."""
        missing = [c for c in self.needs if c not in rows.columns]
        if missing:
            raise SourceError(f"{self.name}: no column {', '.join(missing)}")

    def read(self, rows: DataFrame, **options) -> DataFrame:
        """The extracted records of rows that pass validate(); SourceError if their columns are not those of EXTRACTED."""
        self.validate(rows)
        records = self.extract(rows, **options)
        if records.columns != list(EXTRACTED):
            raise SourceError(f"{self.name}: records have the columns {', '.join(records.columns)}")
        return records


class Registry:
    """Sources by name."""

    def __init__(self) -> None:
        self.sources: dict[str, Source] = {}

    def add(self, source: Source) -> Source:
        """Keeps a source; ValueError for a name that is taken."""
        if source.name in self.sources:
            raise ValueError(f"{source.name} is taken")
        self.sources[source.name] = source
        return source

    def read(self, name: str, rows: DataFrame, **options) -> DataFrame:
        """The records of the named source; SourceError for an unknown one."""
        if name not in self.sources:
            raise SourceError(f"{name}: unknown source, one of {', '.join(sorted(self.sources))} is needed")
        return self.sources[name].read(rows, **options)


def builtin() -> Registry:
    """The sources of this package that read one frame of rows."""
    from . import csv, notes, sectioned

    registry = Registry()
    registry.add(Source("csv", "csv", csv.rows))
    registry.add(Source("csv_grouped", "csv", csv.grouped))
    registry.add(Source("resume", "resume", sectioned.read, ("text",)))
    registry.add(Source("recruiter_notes", "recruiter_notes", notes.read, ("text",)))
    return registry

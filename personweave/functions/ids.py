"""Identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8)).cast("bigint")))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def row_hash(columns: dict[str, Column], prefix: str = "csv:", n: int = 16) -> Column:
    """An id from a row's cells, whatever their order; null cells are empty."""
    pairs = F.array_sort(F.array(*[F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit(""))) for k, c in columns.items()]))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("&", pairs), 256), 1, n))

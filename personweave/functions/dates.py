"""Dates of free-form cells, and spans of months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim_ws

OPEN_ENDED = ("present", "current", "now", "ongoing")
#: What an end may say besides for the role to be current.
CURRENT = (*OPEN_ENDED, "-", "–", "—", "")
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH = f"(?:{'|'.join(m[:3] + f'(?:{m[3:]})?' * (len(m) > 3) for m in _MONTHS)})"
DATE_RANGE = rf"(?i)(?:{MONTH}\.?\s+)?\d{{4}}\s*(?:[^a-zA-Z0-9\s]+|to|\s+)\s*(?:(?:{MONTH}\.?\s+)?\d{{4}}|Present|Current|Now|Ongoing)"
PATTERNS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM", "yyyy/MM", "MM/yyyy", "M/d/yyyy", "MMM yyyy", "MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy")


def parse_date(c: Column, default_year: int = 1900) -> Column:
    """The date that the cell names; parts it lacks are 1 (month, day) or default_year. Null if none."""
    text = F.initcap(F.regexp_replace(F.regexp_replace(trim_ws(c), r"[.,]", ""), r"(?i)\bsept\b", "Sep"))
    whole = F.when(text.rlike(r"^[A-Za-z]{3,9}$"), F.concat(text, F.lit(f" {default_year:04d}"))).otherwise(text)
    return let(whole, lambda t: F.coalesce(*[F.try_to_timestamp(t, F.lit(p)).cast("date") for p in PATTERNS]))


def find_range(line: Column) -> Column:
    """The first date range of a line; null if there is none."""
    return F.nullif(F.regexp_extract(line, f"({DATE_RANGE})", 1), F.lit(""))


def split_range(c: Column, split_to: bool = False) -> Column:
    """struct(raw_start, raw_end, start_date, end_date, is_current) of a date range.

    It is split at the first dash. Ranges written with "to" are split only if split_to; else they are
    one start that names no date.
    """
    parts = F.transform(F.split(c, r"(?i)\s*(?:[-–—]|\bto\b)\s*" if split_to else r"\s*[-–—]\s*", 2), trim_ws)

    def made(p: Column) -> Column:
        start, end = F.get(p, 0), F.get(p, 1)
        open_end = F.lower(end).isin(*OPEN_ENDED)
        return F.struct(
            start.alias("raw_start"),
            end.alias("raw_end"),
            parse_date(start, 2000).alias("start_date"),
            F.when(~open_end, parse_date(end, 2000)).alias("end_date"),
            F.coalesce(open_end, F.lit(False)).alias("is_current"),
        )

    return let(parts, made)


def is_current(raw_end: Column) -> Column:
    """Whether an end that is present names an open role."""
    return F.coalesce(F.lower(trim_ws(raw_end)).isin(*CURRENT), F.lit(False))


def duration_months(start: Column, end: Column, current: Column, as_of: Column) -> Column:
    """Whole months from start to end, at least 0; open roles end at as_of. Null without a start or an end."""
    last = F.coalesce(end, F.when(current, as_of))
    return F.greatest(F.lit(0), (F.year(last) - F.year(start)) * 12 + F.month(last) - F.month(start))

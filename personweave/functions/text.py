"""Text expressions. All are Catalyst expressions; none runs Python on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value c, which is made once however often f names it."""
    return F.get(F.transform(F.array(c), f), 0)


def first_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """Of items with equal keys the first, in order. The keys are made once; null keys are left out."""
    keyed = F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("x")))

    def firsts(pairs: Column) -> Column:
        return let(F.transform(pairs, lambda p: p["k"]), lambda keys: F.transform(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1), lambda p: p["x"]))

    return let(keyed, firsts)


def trim_ws(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    """Trimmed, inner runs of white space as one space."""
    return F.regexp_replace(trim_ws(c), r"(?U)\s+", " ")


def blank_to_null(c: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(trim_ws(c), F.lit(""))


def key_of(c: Column) -> Column:
    """The key by which values are the same: lower case, white space collapsed."""
    return collapse_ws(F.lower(c))


def title_letters(c: Column) -> Column:
    """Each run of letters capitalised, whatever separates the runs: node.js becomes Node.Js."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def title_words(c: Column) -> Column:
    """Each word that white space delimits capitalised, the rest lower."""
    return F.initcap(collapse_ws(c))


def split_multi(c: Column) -> Column:
    """Values of a cell: split at |, else at ;, else at comma, whichever occurs first in this order; trimmed, blanks dropped. Null gives none."""
    parts = F.when(F.contains(c, F.lit("|")), F.split(c, "[|]")).when(F.contains(c, F.lit(";")), F.split(c, ";")).otherwise(F.split(c, ","))
    return F.coalesce(F.filter(F.transform(parts, trim_ws), lambda x: x != ""), F.array().cast("array<string>"))


def dedupe_ci(values: Column, most: int | None = None) -> Column:
    """Trimmed values, blanks dropped; of those that differ in case alone the first stays, in order; of these the first `most`, if given."""

    def firsts(kept: Column, low: Column) -> Column:
        keys = F.array_distinct(low)
        return F.transform(keys if most is None else F.slice(keys, 1, most), lambda k: F.get(kept, F.array_position(low, k).cast("int") - 1))

    return let(F.filter(F.transform(values, trim_ws), lambda x: x != ""), lambda kept: let(F.transform(kept, F.lower), lambda low: firsts(kept, low)))


def words(text: Column) -> Column:
    """Tokens that begin with a letter and hold at least two of letters, digits and + # . -."""
    return F.regexp_extract_all(text, F.lit(r"\b([A-Za-z][A-Za-z0-9+#.-]+)\b"), F.lit(1))


def sentences(text: Column) -> Column:
    """Split after . ! or ? where white space follows."""
    return F.filter(F.split(collapse_ws(text), r"(?<=[.!?])\s+"), lambda x: x != "")


def labelled_block(text: Column, label: str) -> Column:
    """What stands after `label:` at the start of a line, up to the next such label; empty if absent."""
    pattern = rf"(?ims)^\s*{label}\s*:\s*(.+?)(?=^\s*[A-Za-z ]{{2,32}}\s*:|\z)"
    return collapse_ws(F.regexp_extract(text, pattern, 1))


def content_hash(c: Column, n: int) -> Column:
    """The first n hex digits of the SHA-256."""
    return F.substring(F.sha2(c, 256), 1, n)


def decode_base64(c: Column) -> Column:
    """Text of a base-64 cell that may hold white space; bytes that are no UTF-8 are replaced."""
    return F.make_valid_utf8(F.try_to_binary(F.regexp_replace(c, r"\s+", ""), F.lit("base64")).cast("string"))

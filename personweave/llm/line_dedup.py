"""Line dedup: repeated windows of three consecutive lines, found over the whole corpus.

Native plan, no Python on the executors. Each line becomes a 64-bit hash inside its document; a
window is the triple of its lines' hashes (192 bits), so only 48 bytes a window are shuffled and no
text. The first occurrence of each repeated window comes from a map-side combined minimum, and later
ones from an equi-join against repeated windows only, which adaptive execution may split where a
window is frequent. Covered positions are merged into runs with array functions in linear time, and
the text is joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import free_names, quoted

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __th, __pos, __a, __b, __c): every window with a line that is not empty."""
    blank = F.xxhash64(F.lit(""))
    hashed = docs.select(
        F.col(quoted(id_col)).alias("__id"),
        F.xxhash64(F.col(quoted(text_col))).alias("__th"),
        F.transform(_lines(F.col(quoted(text_col))), lambda x: F.xxhash64(x)).alias("__h"),
    ).where(F.size("__h") >= WINDOW)
    count = F.size("__h") - (WINDOW - 1)
    zipped = F.arrays_zip(*[F.slice("__h", k + 1, count).alias(n) for k, n in enumerate("abc")])
    return (
        hashed.select("__id", "__th", F.posexplode(zipped).alias("__pos", "__w"))
        .select("__id", "__th", "__pos", *[F.col(f"__w.{n}").alias(f"__{n}") for n in "abc"])
        .where(~((F.col("__a") == blank) & (F.col("__b") == blank) & (F.col("__c") == blank)))
    )


def covered_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __th, __starts, __ends) for documents with a later occurrence of some window.

    __starts and __ends are the merged runs of covered lines, 0-based, end exclusive.
    """
    windows = _windows(docs, id_col, text_col)
    place = F.struct("__id", "__th", "__pos")
    first = windows.groupBy("__a", "__b", "__c").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    later = windows.join(first, ["__a", "__b", "__c"]).where(place > F.col("__first"))
    found = later.groupBy("__id", "__th").agg(F.array_sort(F.collect_set("__pos")).alias("__p"))
    p = F.col("__p")
    starts = F.filter(p, lambda x, i: (i == 0) | (x - F.get(p, i - 1) > WINDOW))
    ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) - x > WINDOW))
    return found.select("__id", "__th", starts.alias("__starts"), F.transform(ends, lambda x: x + WINDOW).alias("__ends"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """The documents with every later occurrence of a three-line window taken out of their text.

    Lines are what stands between newlines, compared exactly. Occurrences are ordered by document id,
    then by position; all lines of an occurrence but the first are removed. In a run of equal lines
    the first line stays. Of every removed line an equal one stays at an earlier place.

    Null text stays null; a text of fewer than three lines has no window and stays; windows of three
    empty lines are ignored. A null id sorts first. Rows with equal id and text are one document: they
    get equal results. Rows with equal id and other texts are ordered by the text's hash. An empty
    table gives an empty one. All other columns pass through, whatever their names.

    counts: names of two more columns, the number of lines and of those removed (0 for null text);
    columns of these names are replaced.
    """
    i, h, th, starts, ends = free_names([*docs.columns, *(counts or ())], "__id", "__text_hash", "__th", "__starts", "__ends")
    # the built side holds a few numbers a document, the other one its row
    runs = covered_runs(docs, id_col, text_col).toDF(i, th, starts, ends).hint("shuffle_hash")
    text = F.col(quoted(text_col))
    joined = docs.withColumn(h, F.xxhash64(text)).join(runs, F.col(quoted(id_col)).eqNullSafe(F.col(i)) & (F.col(h) == F.col(th)), "left")
    lines, zero = _lines(text), F.array(F.lit(0))
    segments = F.arrays_zip(F.concat(zero, ends).alias("s"), F.concat(F.col(starts), F.array(F.size(lines))).alias("e"))
    kept = F.array_join(F.flatten(F.transform(segments, lambda x: F.slice(lines, x["s"] + 1, x["e"] - x["s"]))), "\n")
    out = {text_col: F.when(F.col(starts).isNull(), text).otherwise(kept)}
    names = list(docs.columns)
    if counts:
        removed = F.aggregate(F.zip_with(starts, ends, lambda s, e: e - s), F.lit(0), lambda a, x: a + x)
        out |= {counts[0]: F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"), counts[1]: F.coalesce(removed, F.lit(0)).cast("long")}
        names += [n for n in counts if n not in names]
    return joined.select(*[out[n].alias(n) if n in out else F.col(quoted(n)) for n in names])


ORACLE_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(len(x))) AS i FROM l WHERE x IS NOT NULL),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x[i + 1], x[i + 2], x[i + 3] ORDER BY doc_id, i) AS r
      FROM p WHERE i + 2 < len(x) AND NOT (x[i + 1] = '' AND x[i + 2] = '' AND x[i + 3] = '')),
c AS (SELECT DISTINCT doc_id, i + o.k AS i FROM w, (SELECT unnest([0, 1, 2]) AS k) o WHERE r > 1),
k AS (SELECT p.doc_id, string_agg(p.x[p.i + 1], chr(10) ORDER BY p.i) FILTER (WHERE c.i IS NULL) AS kept, count(c.i) AS n
      FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT l.doc_id, CASE WHEN l.x IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text,
       coalesce(len(l.x), 0)::BIGINT AS n_lines, coalesce(k.n, 0)::BIGINT AS n_removed
FROM l LEFT JOIN k USING (doc_id)
"""

"""Language identification by compression with zstandard raw-content dictionaries.

A dictionary a language is filled from a bounded sample of labelled rows. A text, lower-cased
and reduced to its letters, is compressed in chunks with each dictionary; the language whose sum is
smallest wins. Where the two smallest are close, they are measured again in finer chunks at a higher
level, and texts whose margin then stays narrow are rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import checkpointed, importable, map_rows, map_texts, quoted, slices

#: Bounds of the sample: documents a language, letters of each, bytes of a dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 200, 4096, 131_072
#: Pieces, spread evenly, that make up the letters of a longer document.
PIECES = 8
#: (level, bytes of a chunk), for all texts and for close ones.
COARSE, FINE = (9, 2048), (19, 256)
#: Margins, as parts of the second smallest size: below CLOSE it is measured again, below NARROW rejected.
CLOSE, NARROW = 0.01, 0.001
FOLDS = 5

_OTHER = re.compile(r"[\W\d_]+")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by FOLDS; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def letters(text: str) -> bytes:
    return (" " + _OTHER.sub(" ", text.lower()) + " ").encode()


@dataclass
class LanguageModel:
    """A dictionary for each language, in order of their names."""

    dictionaries: dict[str, bytes]

    def __post_init__(self) -> None:
        self.compressors: dict[tuple[int, int], dict] = {}

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["dictionaries"])

    def _ready(self, grain: tuple[int, int]) -> dict:
        if grain not in self.compressors:
            import zstandard

            bare = zstandard.ZstdCompressionParameters.from_level(grain[0], write_content_size=0, write_checksum=0, write_dict_id=0)
            self.compressors[grain] = out = {}
            for lang, content in sorted(self.dictionaries.items()):
                own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(compression_params=bare)
                out[lang] = zstandard.ZstdCompressor(dict_data=own, compression_params=bare).compress
        return self.compressors[grain]

    def sizes(self, data: bytes, grain: tuple[int, int]) -> dict[str, int]:
        chunks = [data[a : a + grain[1]] for a in range(0, len(data), grain[1])]
        return {lang: sum([len(compress(c)) for c in chunks]) for lang, compress in self._ready(grain).items()}

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, margin): und and 0 for null, for text without letters and for an empty model."""
        if not text or not self.dictionaries or not any(map(str.isalpha, text)):
            return "und", 0.0
        data = letters(text)
        sizes = self.sizes(data, COARSE)
        (lang, margin) = self._best(sizes)
        if margin < CLOSE and len(sizes) > 1:
            fine = self.sizes(data, FINE)
            lang, margin = self._best({k: v + fine[k] for k, v in sizes.items()})
        return lang, margin

    @staticmethod
    def _best(sizes: dict[str, int]) -> tuple[str, float]:
        order = sorted(sizes, key=lambda k: (sizes[k], k))
        return order[0], (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]] if len(order) > 1 else 1.0


def _spread(text: Column, chars: int) -> Column:
    """A text of up to `chars` letters whole, of a longer one PIECES pieces spread evenly from its start to its end."""
    size, n = chars // PIECES, F.length(text)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring(text, F.floor(k * (n - size) / (PIECES - 1)).cast("int") + 1, F.lit(size)))
    return F.when(n > chars, F.array_join(pieces, " ")).otherwise(text)


def _sample(rows: DataFrame, docs: int, chars: int | None) -> DataFrame:
    """(lang, h, text): of each language the `docs` rows that come first by h, or all if there are fewer.

    rows: (lang, h, text), h a hash of the row. Only rows below a bound on h, set from the counts so that about
    four times the wanted number pass, are shuffled; languages that fall short (rows repeat) get a higher
    bound, up to all rows, so the result is that of ranking everything.
    """
    wanted, bounds, parts = docs, {r["lang"]: 4 * docs / r["count"] for r in rows.groupBy("lang").count().collect()}, []
    spark = rows.sparkSession
    while bounds:
        limits = [(lang, int(max(-1.0, min(1.0, 2 * part - 1)) * (1 << 63)) if part < 1 else (1 << 63) - 1) for lang, part in sorted(bounds.items())]
        # one number a language, of which the model itself holds a whole dictionary
        bounded = rows.join(F.broadcast(spark.createDataFrame(limits, "lang string, bound long")), "lang").where("h <= bound")
        if chars:
            bounded = bounded.withColumn("text", _spread(F.col("text"), chars))
        # rows that repeat become one before they are dealt by language
        distinct = bounded.groupBy("lang", "h").agg(F.min("text").alias("text"))
        first = checkpointed(distinct.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= wanted).drop("r"))
        found = {r["lang"]: r["count"] for r in first.groupBy("lang").count().collect()}
        short = {lang for lang, part in bounds.items() if part < 1 and found.get(lang, 0) < wanted}
        parts.append(first.where(~F.col("lang").isin(sorted(short))) if short else first)
        bounds = {lang: 16 * bounds[lang] for lang in short}
    return reduce(DataFrame.unionByName, parts) if parts else rows.limit(0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int | None = SAMPLE_CHARS, dictionary_bytes: int | None = None) -> LanguageModel:
    """Learns every language of the documents that are not held out and whose text and language are not null.

    The sample is a bounded number of labelled rows: of each language the `sample_docs` documents that come first by
    a hash of id and text, repeated rows once. Each gives `sample_chars` letters from all over its text, or, if None, its
    whole text; together, without repeats, they fill a dictionary up to `dictionary_bytes` (None: DICTIONARY_BYTES). The dictionaries
    are made by the executors, and only they reach the driver. The rows that are shuffled for them are
    about 4 `sample_docs` a language, however many rows and partitions there are.
    """
    ident, text, lang = (F.col(quoted(c)) for c in (id_col, text_col, lang_col))
    kept = docs.where(text.isNotNull() & lang.isNotNull() & ~held_out(id_col))
    rows = kept.select(lang.cast("string").alias("lang"), F.xxhash64(ident.cast("long"), text).alias("h"), text.alias("text"))
    importable(docs.sparkSession)
    most = dictionary_bytes or DICTIONARY_BYTES

    def fill(table: pa.Table) -> pa.Table:
        texts = dict.fromkeys(table.sort_by("h").column("text").to_pylist())
        content, size = [], 0
        for own in texts:
            content.append(letters(own))
            size += len(content[-1])
            if size >= most:
                break
        return pa.table({"lang": table.column("lang")[:1], "content": pa.array([b"".join(content)[:most]], pa.binary())})

    made = _sample(rows, sample_docs, sample_chars).groupBy("lang").applyInArrow(fill, "lang string, content binary").collect()
    return LanguageModel({r["lang"]: bytes(r["content"]) for r in made if r["content"].strip()})


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, margin, score, accepted): one row for each document.

    lang_pred is und, with score 0 and not accepted, for null text, text without letters and an empty
    model. score is 1 - exp(-20 margin). Ties go to the first name and are not accepted. Repeated rows
    and null ids stay. An empty table gives an empty one. Other columns are not read.
    """

    def make() -> Callable:
        def work(ids: list, texts: list) -> list:
            found = [model.classify(t) for t in texts]
            margins = [m for _, m in found]
            return [ids, [lang for lang, _ in found], margins, [1 - math.exp(-20 * m) for m in margins], [lang != "und" and m >= NARROW for lang, m in found]]

        return work

    names = ["doc_id", "lang_pred", "margin", "score", "accepted"]
    return map_texts(docs, make, "doc_id long, lang_pred string, margin double, score double, accepted boolean", names, [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()], id_col, text_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The documents whose language is accepted; all columns stay, whatever their names.

    Null text, text without letters and any text of an empty model go. Rows that repeat stay or go together.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                found = [model.classify(t) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([lang != "und" and margin >= NARROW for lang, margin in found], pa.bool_()))

    return map_rows(docs, run)

"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, secret scans, best-fit packing.

Each stage works on all that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from personweave.llm import language_id, line_dedup, packing, secret_scan, simhash
from personweave.llm.batches import exists, free_names, quoted, remove, scratch, shared_folder


#: Near duplicates in the pipeline: shingles of five words, and bits that differ at most. Six is the largest radius at
#: which unrelated documents do not link by chance at 100 TB (5e10 documents: 0.2 such links a document).
SHINGLE, RADIUS = 5, 6


def _with_length(docs: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, n_chars, if it is one, made anew from the text."""
    length = F.length("text").cast("long").alias("n_chars")
    return docs.select(*[length if n == "n_chars" else F.col(quoted(n)) for n in names])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: null text, no letters, or too narrow a margin.

    Rows that repeat get the same decision; a null id or lang is no reason to go (a null lang is not learned
    from). Without any label all documents go. An empty table gives an empty one. All columns stay.
    """
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows leave the texts; a document that loses all its lines goes.

    Null text stays. Rows of equal id and text are one document and get equal results. n_chars is counted
    anew. An empty table gives an empty one. All columns stay, whatever their names.
    """
    lines, removed = free_names(docs.columns, "__n_lines", "__n_removed")
    counted = line_dedup.dedup_lines(docs, counts=(lines, removed))
    return _with_length(counted.where((F.col(removed) == 0) | (F.col(removed) < F.col(lines))), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of equal rows one.

    Documents without words are copies of each other. A null id stays only where no other is in its
    group. An empty table gives an empty one. All columns stay, whatever their names.
    """
    return simhash.keep_one(docs, RADIUS, shingle=SHINGLE)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay.

    Null text stays null; rows that repeat are redacted alike. n_chars is counted anew. An empty table
    gives an empty one. All columns stay, whatever their names.
    """
    return _with_length(secret_scan.redact_secrets(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, as token pieces in sequences: null text as one piece, rows that repeat each on their own."""
    return packing.pack_documents(docs, packing.word_file())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express compression sizes or fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages one after another, over all of documents.

    Each stage's rows are in the shared folder until the next one's are, and what it staged on its way goes when it is
    done; the last but one's rows stay, since the result reads them. With a `folder` of the caller's own, a run
    that failed goes on after its last finished stage.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    paths = [f"{folder}/{name}" for name, _ in STAGES[:-1]]
    done = max((k for k, path in enumerate(paths) if exists(spark, f"{path}/_SUCCESS")), default=-1)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        if k > done:
            with scratch(spark, f"{folder}/staged-{name}"):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        if k >= done:
            docs = spark.read.parquet(paths[k])
            if before:
                remove(spark, before)
            before = paths[k]
    return STAGES[-1][1](spark, docs, sf_dir)

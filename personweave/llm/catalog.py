"""Queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, language_id, line_dedup, media, packing, pii, secret_scan, simhash, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, counts=("n_lines", "n_removed"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), packing.word_file())


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_digests(_table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    both = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(messages.unionByName(own), parts=chat.illustrated))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), *byte_bpe.rank_file())


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_best_fit_packing, op3_media_columns, op4_chat_formatting, op5_byte_bpe, op6_secret_scans, op7_exact_topk, op8_pii, op9_simhash_near_dedup, op10_language_id)
}

#: Only where SQL can express the operator; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE_SQL, "op4_chat_formatting": chat.ORACLE_SQL, "op7_exact_topk": topk.ORACLE_SQL}


# Of operators that SQL cannot express as a whole, the columns that it can.


def _columns(of: Callable[[SparkSession, str], DataFrame], name: str, columns: list[str], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: of(spark, sf_dir).select(*columns)
    ORACLE_SQL[name] = sql


_columns(op3_media_columns, "media_payloads", ["doc_id", "n_bytes", "payload_bytes", "payload_sha256"], media.PAYLOAD_SQL)
_columns(op5_byte_bpe, "bpe_decoded", ["doc_id", "decoded_sha256"], "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents")
_columns(op6_secret_scans, "secret_base_counts", ["doc_id", "n_assign", "n_access", "n_hex"], secret_scan.COUNTS_SQL)
_columns(op8_pii, "pii_base_counts", ["doc_id", "n_email", "n_ip", "n_card", "n_phone"], pii.COUNTS_SQL)

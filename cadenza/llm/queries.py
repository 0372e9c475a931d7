"""The queries that apply each operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffixes, superkmers
from .audio import audio_digests
from .filter_audit import audit, audit_sql
from .hmm import hmm_scores
from .minmax import near_groups
from .neighbours import nearest
from .packing import pack
from .prefix_trie import prefix_trie, trie_sql
from .quality import fit_quality, quality_scores
from .secrets import report_sql, secret_report
from .shared import scratch
from .tiling import contaminated
from .token_counts import token_counts

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string")) % modulus


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is empty at first, so that every distinct text is encoded; a later run over the same folder would find all of them."""
    counts = token_counts(table(spark, sf_dir, "documents"), TOKENIZER, scratch(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_digest(suffixes.remove_substrings(table(spark, sf_dir, "documents"), 100))


def op3_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"), crc_of("doc_id", 7) == 2)


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digests(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = fit_quality(docs, table(spark, sf_dir, "labels"), crc_of("doc_id", 5) != 0)
    return quality_scores(docs, ranker).select("doc_id", (crc_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.removal_digest(superkmers.remove_substrings(table(spark, sf_dir, "documents"), 50))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark passage, each with the item's id; clean documents have no row."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER, 2048, 1, with_ids=False)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_hmm_scores, op4_audio, op5_near_duplicates, op6_quality, op7_substring_dedup, op8_decontamination, op9_secrets, op10_packing, op11_prefix_trie, op12_nearest_neighbours, op13_filter_audit)}
ORACLE_SQL: dict[str, str] = {"op9_secrets": report_sql(), "op11_prefix_trie": trie_sql(), "op13_filter_audit": audit_sql()}

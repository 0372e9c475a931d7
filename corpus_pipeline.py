"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import minmax, packing, quality, secrets, tiling
from cadenza.llm.queries import TOKENIZER, crc_of, table
from cadenza.llm.shared import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking rejects go."""
    ranker = quality.fit_quality(docs, table(spark, sf_dir, "labels"), crc_of("doc_id", 5) != 0)
    return quality.keep_quality(docs, ranker)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return minmax.keep_one(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays. n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, TOKENIZER, 2048, 1)


STAGES = [("quality classifier", keep_good), ("near duplicates", keep_first), ("decontamination", keep_unseen), ("secret scan", hide_secrets), ("packing", pack_tokens)]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = stored(docs, name.replace(" ", "-"))
    return docs

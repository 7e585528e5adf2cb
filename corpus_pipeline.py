"""The corpus pipeline: five stages, each over all documents that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.functions.storage import materialize
from tendril.llm import bpe, decontaminate, line_dedup, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return quality.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks go, and documents of which only blank lines are left; n_chars follows the text."""
    return line_dedup.keep(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays; links are near copies by 5-word shingles."""
    return simhash.keep_near(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "documents")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What training reads: doc_id, source, lang, n_tokens, ids, and a digest of the ids decoded again."""
    found = bpe.encode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return found.select("row.doc_id", "row.source", "row.lang", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding", encoded),
]

#: Quality references, SimHash components and BPE have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k + 1}")
    return docs

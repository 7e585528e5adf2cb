"""The registered queries of this subpackage, each over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_bpe, centroids, decontaminate, langid, licenses, line_dedup, lm, quality, simhash, substrings, variants, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_js", "word_js")
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("row.doc_id", *columns)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A replica with planted faults, by the MD5 of the id: of 256 pages one has the first character of its body replaced,
    one is lost, and one has a second record beside it."""
    drawn = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    hurt = F.when(drawn == "00", F.concat(F.lit("~"), F.substr(F.col("html"), F.lit(2)))).otherwise(F.col("html"))
    whole = pages.where(drawn != "01").select(*[hurt.alias(c) if c == "html" else F.col(f"`{c}`") for c in pages.columns])
    return whole.unionByName(pages.where(drawn == "02").withColumn("html", F.lit("extra")))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.report(pages, damaged_replica(pages))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.report(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lm_score": op2_lm_score,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_warc_fixity": op6_warc_fixity,
    "op7_simhash": op7_simhash,
    "op8_langid": op8_langid,
    "op9_substrings": op9_substrings,
    "op10_licenses": op10_licenses,
    "op11_centroids": op11_centroids,
    "op12_variants": op12_variants,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": decontaminate.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op6_warc_fixity": warc.ORACLE, "op11_centroids": centroids.ORACLE}

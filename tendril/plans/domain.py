"""The domain's tables, drawn from the tables at hand, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordinals import numbered

TOPICS = ("en", "fr")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("notice_id"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderpriority").alias("domain_code"),
        F.nullif("o_orderstatus", F.lit("P")).alias("joint_venture_method"),
        F.floor("o_totalprice").alias("budget_krw"),
        F.col("o_orderdate").alias("bid_deadline"),
    )


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = True, indexed: bool = False) -> DataFrame:
    """(chunk_id, notice_id, l_topic, content[, embedding][, chunk_index]); the index is counted without the texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("notice_id"), F.col("lang").alias("l_topic"), F.col("text").alias("content"))
    if indexed:
        places = numbered(docs.select("notice_id", "chunk_id"), ["chunk_id"], "place", "notice_id")
        docs = docs.join(places.select("chunk_id", (F.col("place") - 1).cast("int").alias("chunk_index")), "chunk_id")
    if vectors:
        docs = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")
    return docs


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile and two projects: (ordinal, source, id, text, embedding)."""
    items = table(spark, sf_dir, "benchmark").where("item_id <= 2")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    kind = F.when(F.col("item_id") == 0, "profile").otherwise("project")
    return items.join(vectors, "item_id").select(F.col("item_id").alias("ordinal"), kind.alias("source"), F.col("item_id").alias("id"), "text", "embedding")


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(notice_id, chunk_id, grade 0..3)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("notice_id"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("notice_id", F.col("doc_id").alias("chunk_id"), (F.col("quality") * 2 + 1 - F.col("toxic")).alias("grade"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, ts, event_id, status, current)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("set_id"), "ts", "event_id", F.col("event_type").alias("status"), F.floor("value").cast("int").alias("current"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))


def tok(x: str) -> str:
    """The SQL of ``functions.text.tokens``."""
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


SQL = {
    "notices": "SELECT o_orderkey AS notice_id, o_custkey AS company_id, o_orderpriority AS domain_code, nullif(o_orderstatus, 'P') AS joint_venture_method, floor(o_totalprice)::BIGINT AS budget_krw, o_orderdate AS bid_deadline FROM orders",
    "chunks": "SELECT doc_id AS chunk_id, source AS notice_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS chunk_index, lang AS l_topic, text AS content, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
    "targets": "SELECT item_id AS ordinal, CASE item_id WHEN 0 THEN 'profile' ELSE 'project' END AS source, item_id AS id, text, embedding FROM benchmark JOIN embeddings ON item_id = vec_id WHERE item_id <= 2",
    "relevance": "SELECT source AS notice_id, doc_id AS chunk_id, quality * 2 + 1 - toxic AS grade FROM labels JOIN documents USING (doc_id)",
    "progress": "SELECT user_id AS set_id, ts, event_id, event_type AS status, floor(value)::INT AS current FROM events",
    "messages": "SELECT conv_id AS session_id, turn AS id, role, text AS content FROM conversations",
}


def with_(*names: str, **more: str) -> str:
    """``WITH`` of the named domain tables and of further ones."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in {**{n: SQL[n] for n in names}, **more}.items()) + "\n"

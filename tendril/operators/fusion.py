"""Reciprocal Rank Fusion, hybrid search and the second filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinals import numbered
from ..functions.storage import materialize
from ..functions.text import preview
from . import dense, lexical
from .lexical import top

RRF_K, CANDIDATE_K, FINAL_K, PREVIEW = 60, 50, 10, 120
METHODS = ("dense", "bm25", "rrf")


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(notice_id, chunk_id, fused) of ranked lists (list, notice_id, chunk_id, rank from 1)."""
    return lists.groupBy("notice_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("fused"))


def dense_lists(found: DataFrame, fetch: int) -> DataFrame:
    """(list, notice_id, chunk_id, rank): of each target and notice the closest chunks."""
    ranked = top(found, fetch, ["notice_id", "ordinal"], "distance", largest=False)
    return ranked.select(F.concat(F.lit("d"), "ordinal").alias("list"), "notice_id", "chunk_id", "rank")


def lexical_lists(scored: DataFrame, fetch: int) -> DataFrame:
    ranked = top(scored, fetch, ["notice_id", "query_id"])
    return ranked.select(F.concat(F.lit("b"), "query_id").alias("list"), "notice_id", "chunk_id", "rank")


def dedupe_targets(targets: DataFrame) -> DataFrame:
    """The first of projects with one text; profiles all stay."""
    order = Window.partitionBy("source", "text").orderBy("ordinal")
    return targets.withColumn("_n", F.row_number().over(order)).where("source = 'profile' or _n = 1").drop("_n")


def load_targets(profiles: DataFrame, projects: DataFrame) -> DataFrame:
    """(ordinal, source, id, text, embedding): embedded profiles, then embedded projects by id, without repeated texts."""
    both = profiles.select(F.lit("profile").alias("source"), "id", "text", "embedding").unionByName(projects.select(F.lit("project").alias("source"), "id", "text", "embedding"))
    both = numbered(both.where("embedding is not null"), ["source", "id"], "ordinal")
    return dedupe_targets(both.withColumn("ordinal", (F.col("ordinal") - 1).cast("int")))


def query_texts(targets: DataFrame, message: str | None = None) -> DataFrame:
    """(query_id, text): the distinct texts that aren't blank, and the message."""
    texts = targets.select("text")
    if message:
        texts = texts.unionByName(texts.sparkSession.createDataFrame([(message,)], "text string"))
    return texts.where(F.trim("text") != "").distinct().select(F.md5("text").alias("query_id"), "text")


@dataclass
class Lists:
    """What the methods share: each chunk's nearest target, and the ranked lists by distance and by BM25."""

    near: DataFrame
    dense: DataFrame
    bm25: DataFrame | None


def ranked_lists(chunks: DataFrame, targets: DataFrame, message: str | None = None, topics: tuple[str, ...] | None = None, fetch: int = 2 * CANDIDATE_K, index: lexical.Index | None = None, with_bm25: bool = True) -> Lists:
    """Vectors and texts are read once each; what is written holds no vector and no text."""
    found = materialize(dense.scan(chunks, targets, topics, fetch), "distances")
    near = dense.nearest(found).select("notice_id", "chunk_id", "ordinal")
    bm25 = None
    if with_bm25:
        scored = lexical.search(index or lexical.build_index(chunks), query_texts(targets, message), topics=topics)
        bm25 = materialize(lexical_lists(scored, fetch), "lists")
    return Lists(near, dense_lists(dense.pairs(found), fetch), bm25)


def fuse(lists: Lists, method: str = "rrf", candidate_k: int = CANDIDATE_K, k: int = RRF_K) -> DataFrame:
    """(notice_id, chunk_id, rank, score, ordinal) by the lists of a method."""
    if method not in METHODS:
        raise ValueError(f"method: {method!r}")
    own = {"dense": lists.dense, "bm25": lists.bm25}.get(method)
    fused = rrf(lists.dense.unionByName(lists.bm25) if own is None else own, k)
    return top(fused.join(lists.near, ["notice_id", "chunk_id"]), candidate_k, ["notice_id"], "fused").select("notice_id", "chunk_id", "rank", F.round("fused", 6).alias("score"), "ordinal")


def rank_chunks(chunks: DataFrame, targets: DataFrame, message: str | None = None, method: str = "rrf", topics: tuple[str, ...] | None = None, candidate_k: int = CANDIDATE_K, k: int = RRF_K, index: lexical.Index | None = None) -> DataFrame:
    """(notice_id, chunk_id, rank, score, ordinal): the ranked chunks of each notice, each with its nearest target.

    For each target a list by distance and one by BM25, for the message one by BM25; fused, without chunks that have no
    vector, cut to ``candidate_k``. ``method`` takes the lists of one kind alone.
    """
    if method not in METHODS:
        raise ValueError(f"method: {method!r}")
    return fuse(ranked_lists(chunks, targets, message, topics, 2 * candidate_k, index, method != "dense"), method, candidate_k, k)


def hydrate(ranked: DataFrame, chunks: DataFrame, targets: DataFrame, n: int = PREVIEW) -> DataFrame:
    """Ranked chunks with target, topic and preview; texts meet the ranking only now."""
    texts = chunks.select("chunk_id", "l_topic", preview(F.col("content"), n).alias("preview"))
    named = targets.select("ordinal", F.col("source").alias("matched_source"), F.col("id").alias("matched_id"))
    if named.limit(dense.MAX_TARGETS + 1).count() <= dense.MAX_TARGETS:
        named = F.broadcast(named)
    return ranked.join(named, "ordinal").join(texts, "chunk_id").drop("ordinal")


def second_filter(notices: DataFrame, chunks: DataFrame, targets: DataFrame, message: str | None = None, topics: tuple[str, ...] | None = None, candidate_k: int = CANDIDATE_K, final_k: int = FINAL_K, k: int = RRF_K) -> DataFrame:
    """(notice_id, aggregate_score, n_chunks): the sum of the best ``final_k`` chunk scores of every notice, 0 without any."""
    if not 0 < final_k <= candidate_k:
        raise ValueError("0 < final_k <= candidate_k")
    ranked = rank_chunks(chunks, targets, message, "rrf", topics, candidate_k, k).where(F.col("rank") <= final_k)
    summed = ranked.groupBy("notice_id").agg(F.round(F.sum("score"), 6).alias("aggregate_score"), F.count("*").alias("n_chunks"))
    return notices.join(summed, "notice_id", "left").select("notice_id", F.coalesce("aggregate_score", F.lit(0.0)).alias("aggregate_score"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def hybrid(chunks: DataFrame, targets: DataFrame, limit: int = 5, k: int = RRF_K) -> DataFrame:
    """(notice_id, chunk_id, rank, fused): distance and BM25 fused; equal sums keep the dense list's order, then BM25's."""
    both = dense_lists(dense.distances(chunks, targets, fetch=2 * limit), 2 * limit).withColumn("kind", F.lit(0)).unionByName(lexical_lists(lexical.search(lexical.build_index(chunks), query_texts(targets)), 2 * limit).withColumn("kind", F.lit(1)))
    fused = both.groupBy("notice_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("fused"), F.min(F.struct("kind", "rank")).alias("seen"))
    order = Window.partitionBy("notice_id").orderBy(F.desc("fused"), "seen", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("notice_id", "chunk_id", "rank", "fused")


def reference_fallback(chunks: DataFrame, references: DataFrame, limit: int = 5, k: int = RRF_K) -> DataFrame:
    """(notice_id, chunk_id, rank, fused): the dense lists of all references fused."""
    return top(rrf(dense_lists(dense.distances(chunks, references, fetch=2 * limit), 2 * limit), k), limit, ["notice_id"], "fused").select("notice_id", "chunk_id", "rank", "fused")

"""BM25 over an inverted index held in DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialize
from ..functions.text import tokens

K1, B = 1.2, 0.75
#: Rows of query terms that are sent to every task; more are joined by term instead.
MAX_SENT_TERMS = 10_000


@dataclass
class Index:
    """words (chunk_id, notice_id, l_topic, words, dl): the chunks' tokens, not yet read; or, if stored, postings (term,
    notice_id, chunk_id, l_topic, dl, tf) by term with the statistics of the corpus."""

    words: DataFrame
    postings: DataFrame
    stored: bool = False
    n_chunks: int = 0
    mean_length: float = 0.0

    @property
    def terms(self) -> DataFrame:
        """(term, n): the chunks that hold each term. Where no chunk comes twice, which ids alone tell, each counts its own
        terms, and no posting is dealt."""
        if not self.stored:
            ids = ["chunk_id", "notice_id", "l_topic"]
            if self.words.groupBy(*ids).count().where("count > 1").isEmpty():
                return self.words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        return self.postings.groupBy("term").agg(F.count("*").alias("n"))


def _postings(rows: DataFrame, words: str) -> DataFrame:
    return rows.select("chunk_id", "notice_id", "l_topic", "dl", F.explode(words).alias("term")).groupBy("term", "notice_id", "chunk_id", "l_topic", "dl").agg(F.count("*").alias("tf"))


def _statistics(rows: DataFrame) -> tuple[int, float]:
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("mean")).first()
    return size.n, size.mean


def build_index(chunks: DataFrame, chunk: str = "chunk_id", group: str = "notice_id", text: str = "content", topic: str = "l_topic", stored: bool = False) -> Index:
    """Index all chunks; ``stored`` writes the postings, by term, for many searches."""
    words = chunks.select(F.col(chunk).alias("chunk_id"), F.col(group).alias("notice_id"), F.col(topic).alias("l_topic"), tokens(F.col(text)).alias("words")).withColumn("dl", F.size("words"))
    postings = _postings(words, "words")
    if not stored:
        return Index(words, postings)
    return Index(words, materialize(postings.repartition("term"), "postings"), True, *_statistics(words))


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text", tokens: Callable[[Column], Column] = tokens) -> DataFrame:
    return queries.select(F.col(query).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def search(index: Index, queries: DataFrame, query: str = "query_id", text: str = "text", topics: tuple[str, ...] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, notice_id, chunk_id, score): chunks that hold any term of a query, statistics over the whole corpus.

    Only postings of the queries' terms are counted and scored. Without a stored index one pass over the texts finds them
    and the lengths of all chunks. A query without terms finds nothing.
    """
    asked = query_terms(queries, query, text)
    terms = [r.term for r in asked.select("term").distinct().limit(MAX_SENT_TERMS + 1).collect()]
    few = len(terms) <= MAX_SENT_TERMS
    # Many queries may share few terms: what is sent is bounded by its rows.
    sent = (lambda df: F.broadcast(df)) if few and asked.limit(MAX_SENT_TERMS + 1).count() <= MAX_SENT_TERMS else (lambda df: df)
    if few and not index.stored:
        held = index.words.select("chunk_id", "notice_id", "l_topic", "dl", F.filter("words", lambda w: w.isin(terms)).alias("held"))
        held = materialize(held, "held")
        n_chunks, mean = _statistics(held)
        own = _postings(held, "held")
    else:
        n_chunks, mean = (index.n_chunks, index.mean_length) if index.stored else _statistics(index.words)
        own = index.postings.join(sent(asked.select("term").distinct()), "term", "left_semi")
    n = own.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.log(1 + (n_chunks - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean)))
    if topics is not None:
        own = own.where(F.col("l_topic").isin(*topics))
    scored = own.join(sent(asked.join(n, "term")), "term")
    return scored.groupBy("query_id", "notice_id", "chunk_id").agg(F.round(F.sum(idf * weight), 6).alias("score"))


def top(scored: DataFrame, limit: int, by: list[str], score: str = "score", largest: bool = True) -> DataFrame:
    """The first ``limit`` rows of each group, with their rank from 1; equal scores by chunk id."""
    order = F.desc(score) if largest else F.asc(score)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "chunk_id")))
    return ranked.where(F.col("rank") <= limit)

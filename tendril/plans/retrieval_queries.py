"""Lexical, dense and fused retrieval, the filters built on them, and their quality."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ordinals import numbered
from ..functions.storage import shared_dir
from ..operators import aggregate, dense, fusion, labels, lexical, metrics, retry
from ..operators.kept_index import KeptIndex
from ..operators.kept_vectors import KeptVectors
from . import domain
from .domain import TOPICS, tok, with_
from .registry import ORACLE_SQL, query

_IN = "('en', 'fr')"
_QUERIES = "SELECT md5(text) AS query_id, text FROM (SELECT DISTINCT text FROM targets WHERE trim(text) <> '')"
_BM25 = {
    "queries": _QUERIES,
    "toks": f"SELECT chunk_id, notice_id, l_topic, unnest({tok('content')}) AS term FROM chunks",
    "stats": f"SELECT count(*) AS n_chunks, avg(len({tok('content')})) AS mean FROM chunks",
    "dl": "SELECT chunk_id, count(*) AS dl FROM toks GROUP BY 1",
    "tf": "SELECT chunk_id, notice_id, l_topic, term, count(*) AS tf FROM toks GROUP BY ALL",
    "df": "SELECT term, count(*) AS n FROM tf GROUP BY 1",
    "q": f"SELECT query_id, unnest(list_distinct({tok('text')})) AS term FROM queries",
    "bm_all": "SELECT query_id, notice_id, chunk_id, l_topic, round(sum(ln(1 + (n_chunks - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (chunk_id), stats GROUP BY ALL",
}
_DENSE = {
    "dist_all": "SELECT notice_id, chunk_id, l_topic, ordinal, round(CASE WHEN list_sum(list_transform(c.embedding, lambda x: x::DOUBLE * x::DOUBLE)) = 0 OR list_sum(list_transform(t.embedding, lambda x: x::DOUBLE * x::DOUBLE)) = 0 THEN 1 ELSE 1 - list_cosine_similarity(c.embedding::DOUBLE[], t.embedding::DOUBLE[]) END, 6) AS distance FROM chunks c, targets t WHERE c.embedding IS NOT NULL AND t.embedding IS NOT NULL",
}
_SCOPED = {"bm": f"SELECT * FROM bm_all WHERE l_topic IN {_IN}", "dist": f"SELECT * FROM dist_all WHERE l_topic IN {_IN}"}
_LISTS = {
    "dlists": "SELECT notice_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY notice_id, ordinal ORDER BY distance, chunk_id) AS rank FROM dist) WHERE rank <= 100",
    "blists": "SELECT notice_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY notice_id, query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 100",
    "near": "SELECT notice_id, chunk_id, min_by(ordinal, (distance, ordinal)) AS ordinal FROM dist GROUP BY ALL",
}


def _ranked(lists: str, candidates: int = 50) -> dict[str, str]:
    return {
        "fused": f"SELECT notice_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused FROM ({lists}) GROUP BY ALL",
        "ranked": f"SELECT notice_id, chunk_id, rank, round(fused, 6) AS score, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY fused DESC, chunk_id) AS rank FROM fused JOIN near USING (notice_id, chunk_id)) WHERE rank <= {candidates}",
    }


_BOTH = "SELECT * FROM dlists UNION ALL SELECT * FROM blists"
_ALL = {**_BM25, **_DENSE, **_SCOPED, **_LISTS}


def _sql(select: str, *parts: dict[str, str], names: tuple[str, ...] = ("chunks", "targets")) -> str:
    return with_(*names, **{k: v for p in parts for k, v in p.items()}) + select


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.dedupe_targets(domain.targets(spark, sf_dir))


def _chunks_targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return domain.chunks(spark, sf_dir), _targets(spark, sf_dir)


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "documents").select(F.col("source").alias("notice_id")).distinct()


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query("bm25_topk", _sql("SELECT query_id, notice_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm_all) WHERE rank <= 10", _BM25))
def bm25_topk(spark, sf_dir):
    chunks, targets = domain.chunks(spark, sf_dir, vectors=False), _targets(spark, sf_dir)
    scored = lexical.search(lexical.build_index(chunks), fusion.query_texts(targets))
    return _long(lexical.top(scored, 10, ["query_id"]), "rank").select("query_id", "notice_id", "chunk_id", "score", "rank")


@query("bm25_topn_per_notice", _sql("SELECT query_id, notice_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, notice_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 100", _BM25, {"bm": _SCOPED["bm"]}))
def bm25_topn_per_notice(spark, sf_dir):
    chunks, targets = domain.chunks(spark, sf_dir, vectors=False), _targets(spark, sf_dir)
    scored = lexical.search(lexical.build_index(chunks), fusion.query_texts(targets), topics=TOPICS)
    return _long(lexical.top(scored, 100, ["query_id", "notice_id"]), "rank").select("query_id", "notice_id", "chunk_id", "score", "rank")


def _kept(spark: SparkSession, sf_dir: str) -> KeptIndex:
    """An index of all chunks, in two appends."""
    index = KeptIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    chunks = domain.chunks(spark, sf_dir, vectors=False)
    for half in (0, 1):
        index.append(chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == half))
    return index


@query("kept_bm25_topk", ORACLE_SQL["bm25_topk"])
def kept_bm25_topk(spark, sf_dir):
    """``bm25_topk`` by a kept index, which leaves out blocks of postings that can't be among the best."""
    found, _ = _kept(spark, sf_dir).best(fusion.query_texts(_targets(spark, sf_dir)), 10)
    return _long(found, "rank").select("query_id", "notice_id", "chunk_id", "score", "rank")


@query("kept_bm25_topn_per_notice", _sql("SELECT query_id, notice_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, notice_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 3", _BM25, {"bm": _SCOPED["bm"]}))
def kept_bm25_topn_per_notice(spark, sf_dir):
    found, _ = _kept(spark, sf_dir).best(fusion.query_texts(_targets(spark, sf_dir)), 3, by_notice=True, topics=TOPICS)
    return _long(found, "rank").select("query_id", "notice_id", "chunk_id", "score", "rank")


@query("bm25_terms", _sql("SELECT term, n FROM df", {k: _BM25[k] for k in ("toks", "tf", "df")}, names=("chunks",)))
def bm25_terms(spark, sf_dir):
    return lexical.build_index(domain.chunks(spark, sf_dir, vectors=False)).terms


@query("cosine_similarity", _sql("SELECT chunk_id, ordinal, distance FROM dist_all", _DENSE))
def cosine_similarity(spark, sf_dir):
    return dense.distances(*_chunks_targets(spark, sf_dir)).select("chunk_id", "ordinal", "distance")


@query("dense_topk", _sql("SELECT chunk_id, distance, rank FROM (SELECT *, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM dist_all WHERE ordinal = 0) WHERE rank <= 10", _DENSE))
def dense_topk(spark, sf_dir):
    chunks, targets = _chunks_targets(spark, sf_dir)
    best = dense.distances(chunks, targets.where("ordinal = 0")).orderBy("distance", "chunk_id").limit(10)
    return _long(lexical.top(best, 10, ["ordinal"], "distance", largest=False), "rank").select("chunk_id", "distance", "rank")


@query("dense_topk_multi", _sql("SELECT notice_id, ordinal, chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY notice_id, ordinal ORDER BY distance, chunk_id) AS rank FROM dist) WHERE rank <= 20", _DENSE, {"dist": _SCOPED["dist"]}))
def dense_topk_multi(spark, sf_dir):
    found = dense.distances(*_chunks_targets(spark, sf_dir), TOPICS, fetch=20)
    return _long(lexical.top(found, 20, ["notice_id", "ordinal"], "distance", largest=False), "rank").select("notice_id", "ordinal", "chunk_id", "distance", "rank")


@query("kept_dense_topk_multi", ORACLE_SQL["dense_topk_multi"])
def kept_dense_topk_multi(spark, sf_dir):
    """``dense_topk_multi`` by kept lists of vectors, of which those that are too far are skipped."""
    chunks, targets = _chunks_targets(spark, sf_dir)
    index = KeptVectors(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    index.create(chunks)
    index.append(chunks)
    found, _ = index.best(targets, 20, TOPICS)
    return _long(found, "rank")


_ASKED = {
    "words": f"SELECT item_id, {tok('text')} AS w FROM benchmark",
    "held": f"SELECT DISTINCT doc_id, unnest({tok('text')}) AS query FROM documents",
    "hits": "SELECT query, (list(doc_id ORDER BY doc_id))[1:20] AS results FROM held GROUP BY 1",
    "q": "SELECT item_id, 1 AS attempt, w[1] AS query FROM words UNION ALL SELECT DISTINCT item_id, 2, unnest(w[2:4]) FROM words",
    "r": "SELECT item_id, attempt, query, results FROM q LEFT JOIN hits USING (query) WHERE query IS NOT NULL",
    "one": "SELECT item_id, coalesce(sum(len(results)), 0) AS n FROM r WHERE attempt = 1 GROUP BY 1",
    "more": "SELECT item_id, coalesce(n, 0) >= 20 AS fine FROM benchmark LEFT JOIN one USING (item_id)",
    "kept": "SELECT r.* FROM r JOIN more USING (item_id) WHERE attempt = 1 OR NOT fine",
}


@query("search_again", with_(**_ASKED) + "SELECT m.item_id, CASE WHEN fine THEN 1 ELSE 2 END AS attempts, count(query) AS n_queries, count(query) FILTER (results IS NULL) AS n_failed, coalesce(sum(len(results)), 0)::BIGINT AS n_results, coalesce(sum(len(results)), 0) >= 20 AS sufficient FROM more m LEFT JOIN kept USING (item_id) GROUP BY m.item_id, fine")
def search_again(spark, sf_dir):
    """Documents for each benchmark item: by its first word, and where that finds fewer than 20, by the next three too. A word
    that no document holds is a search that failed."""
    words = X.tokens(F.col("text"))
    items = domain.table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    held = domain.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(words)).alias("query"))

    def ask(rows: DataFrame, attempt: int) -> DataFrame:
        return rows.select("item_id", F.explode(F.array_distinct(F.slice("w", 1, 1) if attempt == 1 else F.slice("w", 2, 3))).alias("query"))

    def search(asked: DataFrame) -> DataFrame:
        best = Window.partitionBy("query").orderBy("doc_id")
        found = held.join(asked.select("query").distinct(), "query", "left_semi").withColumn("_n", F.row_number().over(best)).where("_n <= 20")
        return asked.join(found.groupBy("query").agg(F.sort_array(F.collect_list("doc_id")).alias("results")), "query", "left")

    found = retry.until_sufficient(items, "item_id", ask, search, lambda have: have.select("item_id", (F.size("results") >= 20).alias("sufficient"), F.lit("").alias("reason")))
    return found.select("item_id", "attempts", F.size("queries").cast("long").alias("n_queries"), "n_failed", F.size("results").cast("long").alias("n_results"), "sufficient")


@query("nearest_target", _sql("SELECT notice_id, chunk_id, min_by(ordinal, (distance, ordinal)) AS ordinal, min(distance) AS distance FROM dist_all GROUP BY ALL", _DENSE))
def nearest_target(spark, sf_dir):
    return dense.nearest(dense.scan(*_chunks_targets(spark, sf_dir), fetch=1))


@query("rrf_fusion", _sql("SELECT notice_id, chunk_id, fused FROM fused", _ALL, _ranked(_BOTH)))
def rrf_fusion(spark, sf_dir):
    chunks, targets = _chunks_targets(spark, sf_dir)
    lists = fusion.ranked_lists(chunks, targets, topics=TOPICS)
    return fusion.rrf(lists.dense.unionByName(lists.bm25))


def _retrieve(name: str, method: str, lists: str) -> None:
    @query(name, _sql("SELECT notice_id, chunk_id, rank, score, ordinal FROM ranked", _ALL, _ranked(lists)))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _long(fusion.rank_chunks(*_chunks_targets(spark, sf_dir), method=method, topics=TOPICS), "rank")


_retrieve("retrieve_dense", "dense", "SELECT * FROM dlists")
_retrieve("retrieve_bm25", "bm25", "SELECT * FROM blists")
_retrieve("retrieve_rrf", "rrf", _BOTH)


@query("rank_chunks", _sql("SELECT r.notice_id, chunk_id, rank, score, t.source AS matched_source, t.id AS matched_id, l_topic, nullif(substr(content, 1, 120), '') AS preview FROM ranked r JOIN targets t USING (ordinal) JOIN chunks USING (chunk_id)", _ALL, _ranked(_BOTH)))
def rank_chunks(spark, sf_dir):
    chunks, targets = _chunks_targets(spark, sf_dir)
    return _long(fusion.hydrate(fusion.rank_chunks(chunks, targets, topics=TOPICS), chunks, targets), "rank")


_SUMMED = "SELECT n.notice_id, coalesce(round(sum(score) FILTER (rank <= 10), 6), 0) AS aggregate_score, count(score) FILTER (rank <= 10) AS n_chunks FROM (SELECT DISTINCT source AS notice_id FROM documents) n LEFT JOIN ranked USING (notice_id) GROUP BY 1"


@query("second_filter", _sql(_SUMMED, _ALL, _ranked(_BOTH)))
def second_filter(spark, sf_dir):
    return fusion.second_filter(_notices(spark, sf_dir), *_chunks_targets(spark, sf_dir), topics=TOPICS)


_MESSAGE = "the of and that with"
_WITH_MESSAGE = {**_ALL, "queries": f"SELECT md5(text) AS query_id, text FROM (SELECT text FROM targets WHERE trim(text) <> '' UNION SELECT '{_MESSAGE}')"}


@query("second_filter_message", _sql(_SUMMED, _WITH_MESSAGE, _ranked(_BOTH)))
def second_filter_message(spark, sf_dir):
    return fusion.second_filter(_notices(spark, sf_dir), *_chunks_targets(spark, sf_dir), message=_MESSAGE, topics=TOPICS)


def _aggregated(name: str, method: str, sql: str) -> None:
    @query(name, _sql(f"SELECT n.notice_id, coalesce(round({sql}, 6), 0) AS notice_score FROM (SELECT DISTINCT source AS notice_id FROM documents) n LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) USING (notice_id) GROUP BY 1", _ALL, _ranked(_BOTH)))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranked = fusion.rank_chunks(*_chunks_targets(spark, sf_dir), topics=TOPICS)
        return aggregate.rank_notices(ranked, _notices(spark, sf_dir), method)


_aggregated("notice_sum_topk", "sum_top_k", "sum(score)")
_aggregated("notice_max", "max", "max(score)")
_aggregated("notice_sum_top3", "sum_top_3", "sum(score) FILTER (rank <= 3)")
_aggregated("notice_discounted", "discounted_sum", "sum(score / log2(rank + 1))")


@query("search_items", _sql(f"SELECT s.notice_id, nullif(aggregate_score, 0) AS score, row_number() OVER (ORDER BY aggregate_score DESC, s.notice_id) AS place FROM ({_SUMMED}) s", _ALL, _ranked(_BOTH)))
def search_items(spark, sf_dir):
    found = fusion.second_filter(_notices(spark, sf_dir), *_chunks_targets(spark, sf_dir), topics=TOPICS)
    return numbered(found, [F.desc("aggregate_score"), "notice_id"], "place").select("notice_id", F.nullif("aggregate_score", F.lit(0.0)).alias("score"), "place")


_HYBRID = {
    "dl10": "SELECT notice_id, chunk_id, rank, 0 AS kind FROM (SELECT *, row_number() OVER (PARTITION BY notice_id, ordinal ORDER BY distance, chunk_id) AS rank FROM dist_all) WHERE rank <= 10",
    "bl10": "SELECT notice_id, chunk_id, rank, 1 AS kind FROM (SELECT *, row_number() OVER (PARTITION BY notice_id, query_id ORDER BY score DESC, chunk_id) AS rank FROM bm_all) WHERE rank <= 10",
    "hy": "SELECT notice_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused, min(kind * 1000 + rank) AS seen FROM (SELECT * FROM dl10 UNION ALL SELECT * FROM bl10) GROUP BY ALL",
}


@query("hybrid_topk", _sql("SELECT notice_id, chunk_id, rank, fused FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY fused DESC, seen, chunk_id) AS rank FROM hy) WHERE rank <= 5", _BM25, _DENSE, _HYBRID))
def hybrid_topk(spark, sf_dir):
    return _long(fusion.hybrid(*_chunks_targets(spark, sf_dir)), "rank")


@query("reference_fallback", _sql("SELECT notice_id, chunk_id, rank, fused FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY fused DESC, chunk_id) AS rank FROM (SELECT notice_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused FROM dl10 GROUP BY ALL)) WHERE rank <= 5", _DENSE, {"dl10": _HYBRID["dl10"]}))
def reference_fallback(spark, sf_dir):
    return _long(fusion.reference_fallback(*_chunks_targets(spark, sf_dir)), "rank")


@query("query_texts", with_("targets") + "SELECT DISTINCT md5(text) AS query_id, text FROM targets WHERE trim(text) <> ''")
def query_texts(spark, sf_dir):
    return fusion.query_texts(domain.targets(spark, sf_dir))


@query("dedupe_targets", "SELECT doc_id AS ordinal, source FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'profile' ELSE 'project' END AS source, row_number() OVER (PARTITION BY doc_id % 50 = 0, text ORDER BY doc_id) AS n FROM documents) WHERE source = 'profile' OR n = 1")
def dedupe_targets(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 50 == 0, "profile").otherwise("project")
    rows = domain.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), kind.alias("source"), "text")
    return fusion.dedupe_targets(rows).select("ordinal", "source")


@query("load_targets", "SELECT (row_number() OVER (ORDER BY item_id <> 0, item_id) - 1)::INT AS ordinal, CASE item_id WHEN 0 THEN 'profile' ELSE 'project' END AS source, item_id AS id FROM benchmark JOIN embeddings ON item_id = vec_id")
def load_targets(spark, sf_dir):
    rows = domain.table(spark, sf_dir, "benchmark").join(domain.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id", "left").select(F.col("item_id").alias("id"), "text", "embedding")
    return fusion.load_targets(rows.where("id = 0"), rows.where("id != 0")).select("ordinal", "source", "id")


@query("unembedded_chunks", with_("chunks") + "SELECT chunk_id, notice_id FROM chunks WHERE embedding IS NULL")
def unembedded_chunks(spark, sf_dir):
    return domain.chunks(spark, sf_dir).where("embedding is null").select("chunk_id", "notice_id")


@query("json_topic_filter", with_("chunks") + "SELECT chunk_id, l_topic FROM chunks WHERE l_topic IN ('en', 'fr')")
def json_topic_filter(spark, sf_dir):
    meta = domain.chunks(spark, sf_dir, vectors=False).select("chunk_id", F.to_json(F.struct("l_topic")).alias("metadata"))
    topic = F.get_json_object("metadata", "$.l_topic")
    return meta.where(topic.isin(*TOPICS)).select("chunk_id", topic.alias("l_topic"))


@query("pooled_candidates", _sql("SELECT notice_id, chunk_id, dense_rank, bm25_rank, rrf_rank, least(dense_rank, bm25_rank, rrf_rank) AS best_rank, concat_ws(',', CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END, CASE WHEN rrf_rank IS NOT NULL THEN 'rrf' END) AS retrieved_by, coalesce(grade::VARCHAR, '') AS chunk_relevance FROM (SELECT notice_id, chunk_id, min(rank) FILTER (m = 'dense') AS dense_rank, min(rank) FILTER (m = 'bm25') AS bm25_rank, min(rank) FILTER (m = 'rrf') AS rrf_rank FROM (SELECT *, 'dense' AS m FROM ranked_d UNION ALL SELECT *, 'bm25' FROM ranked_b UNION ALL SELECT *, 'rrf' FROM ranked) WHERE rank <= 20 GROUP BY ALL) LEFT JOIN relevance USING (notice_id, chunk_id)", _ALL, {k + "_d": v.replace("FROM fused", "FROM fused_d") for k, v in _ranked("SELECT * FROM dlists").items()}, {k + "_b": v.replace("FROM fused", "FROM fused_b") for k, v in _ranked("SELECT * FROM blists").items()}, _ranked(_BOTH), names=("chunks", "targets", "relevance")))
def pooled_candidates(spark, sf_dir):
    chunks, targets = _chunks_targets(spark, sf_dir)
    shared = fusion.ranked_lists(chunks, targets, topics=TOPICS)
    lists = [fusion.fuse(shared, m).select(F.lit(m).alias("method"), "notice_id", "chunk_id", "rank") for m in fusion.METHODS]
    pool = labels.reuse(labels.pooled(reduce(DataFrame.unionByName, lists), 20), domain.relevance(spark, sf_dir), ["notice_id", "chunk_id"])
    return _long(pool, "dense_rank", "bm25_rank", "rrf_rank", "best_rank")


_LABELS = {"j": "SELECT coalesce(l.notice_id, r.notice_id) AS notice_id, coalesce(l.chunk_id, r.chunk_id) AS chunk_id, rank, coalesce(grade, 0) AS grade FROM relevance l FULL JOIN ranked r ON l.notice_id = r.notice_id AND l.chunk_id = r.chunk_id", "ideal": "SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY grade DESC, chunk_id) AS ideal FROM j"}
_RECALL = "count(*) FILTER (grade >= 1 AND rank <= {k}) / count(*) FILTER (grade >= 1)"
_NDCG = "coalesce(sum(CASE WHEN rank <= {k} THEN (pow(2.0, grade) - 1) / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= {k} THEN (pow(2.0, grade) - 1) / log2(ideal + 1) ELSE 0 END), 0), 0)"


def _metric(name: str, column: str, sql: str) -> None:
    @query(name, _sql(f"SELECT notice_id, round({sql}, 6) AS {column} FROM ideal GROUP BY 1 HAVING max(grade) >= 1", _ALL, _ranked(_BOTH), _LABELS, names=("chunks", "targets", "relevance")))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranked = fusion.rank_chunks(*_chunks_targets(spark, sf_dir), topics=TOPICS)
        return metrics.per_group(ranked, domain.relevance(spark, sf_dir), ["notice_id"], "chunk_id").select("notice_id", column)


_metric("recall_at_k", "recall_10", _RECALL.format(k=10))
_metric("hit_rate_at_k", "hit_10", "max(CASE WHEN grade >= 1 AND rank <= 10 THEN 1.0 ELSE 0.0 END)::DOUBLE")
_metric("mrr", "rr", "coalesce(1.0::DOUBLE / min(rank) FILTER (grade >= 1), 0)")
_metric("ndcg_at_k", "ndcg_10", _NDCG.format(k=10))


@query("metrics_macro", _sql(f"SELECT count(*) AS groups, round(avg(recall_10), 6) AS recall_10, round(avg(recall_20), 6) AS recall_20, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(rr), 6) AS rr, NULL::DOUBLE AS recall_100 FROM (SELECT round({_RECALL.format(k=10)}, 6) AS recall_10, round({_RECALL.format(k=20)}, 6) AS recall_20, round({_NDCG.format(k=10)}, 6) AS ndcg_10, round(coalesce(1.0::DOUBLE / min(rank) FILTER (grade >= 1), 0), 6) AS rr FROM ideal GROUP BY notice_id HAVING max(grade) >= 1)", _ALL, _ranked(_BOTH), _LABELS, names=("chunks", "targets", "relevance")))
def metrics_macro(spark, sf_dir):
    ranked = fusion.rank_chunks(*_chunks_targets(spark, sf_dir), topics=TOPICS)
    found = metrics.per_group(ranked, domain.relevance(spark, sf_dir), ["notice_id"], "chunk_id", (10, 20, 100), candidate_k=50)
    return metrics.macro(found, ["notice_id"]).select("groups", "recall_10", "recall_20", "ndcg_10", "rr", "recall_100")


@query("latency_percentile", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentile(spark, sf_dir):
    return metrics.percentile(domain.table(spark, sf_dir, "events"), "value", (50, 95), ["event_type"])


@query("final_tokens", _sql(f"SELECT r.notice_id, sum(len({tok('content')}))::BIGINT AS final_token_count FROM ranked r JOIN chunks USING (chunk_id) WHERE rank <= 10 GROUP BY 1", _ALL, _ranked(_BOTH)))
def final_tokens(spark, sf_dir):
    from ..functions.text import tokens

    chunks, targets = _chunks_targets(spark, sf_dir)
    final = fusion.rank_chunks(chunks, targets, topics=TOPICS).where("rank <= 10")
    sized = chunks.select("chunk_id", F.size(tokens(F.col("content"))).alias("token_count"))
    return final.join(sized, "chunk_id").groupBy("notice_id").agg(F.sum("token_count").alias("final_token_count"))


@query("chat_context", _sql("SELECT notice_id, string_agg(content, chr(10) || chr(10) ORDER BY distance, chunk_id) AS context FROM (SELECT d.notice_id, chunk_id, content, distance, row_number() OVER (PARTITION BY d.notice_id ORDER BY distance, chunk_id) AS rank FROM dist_all d JOIN chunks USING (chunk_id) WHERE ordinal = 0) WHERE rank <= 5 GROUP BY 1", _DENSE))
def chat_context(spark, sf_dir):
    from ..operators.scoring import concat_chunks

    chunks, targets = _chunks_targets(spark, sf_dir)
    best = lexical.top(dense.distances(chunks, targets.where("ordinal = 0"), fetch=5), 5, ["notice_id"], "distance", largest=False)
    texts = best.select("chunk_id", F.col("rank").alias("chunk_index"), "notice_id").join(chunks.select("chunk_id", "content"), "chunk_id")
    return concat_chunks(texts, ["notice_id"]).select("notice_id", F.col("body").alias("context"))

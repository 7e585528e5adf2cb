"""Preparing and checking relevance labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("dense", "bm25", "rrf")


def pooled(lists: DataFrame, limit: int, by: str = "notice_id") -> DataFrame:
    """(by, chunk_id, dense_rank, bm25_rank, rrf_rank, best_rank, retrieved_by) of ranked lists (method, by, chunk_id, rank)."""
    wide = lists.where(F.col("rank") <= limit).groupBy(by, "chunk_id").pivot("method", list(METHODS)).agg(F.min("rank"))
    names = [f"{m}_rank" for m in METHODS]
    wide = wide.select(by, "chunk_id", *[F.col(m).alias(n) for m, n in zip(METHODS, names, strict=True)])
    told = F.concat_ws(",", *[F.when(F.col(n).isNotNull(), m) for m, n in zip(METHODS, names, strict=True)])
    return wide.select("*", F.least(*names).alias("best_rank"), told.alias("retrieved_by"))


def reuse(pool: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """The pool with earlier grades as text, blank where there is none."""
    return pool.join(labels.select(*keys, F.col("grade").cast("string").alias("chunk_relevance")), keys, "left").withColumn("chunk_relevance", F.coalesce("chunk_relevance", F.lit("")))


def conflicts(labels: DataFrame, by: list[str], grade: str) -> DataFrame:
    """Groups that don't have exactly one grade, or a blank one."""
    value = F.coalesce(F.trim(F.col(grade).cast("string")), F.lit(""))
    found = labels.groupBy(*by).agg(F.countDistinct(value).alias("grades"), F.max((value == "").cast("int")).alias("blank"))
    return found.where("grades != 1 or blank = 1").select(*by, "grades")


def orphans(labels: DataFrame, chunks: DataFrame, topics: tuple[str, ...]) -> DataFrame:
    """(notice_id, chunk_id, fault) of labels whose chunk is missing, belongs elsewhere or is out of scope."""
    both = labels.alias("l").join(chunks.select("chunk_id", F.col("notice_id").alias("own"), "l_topic").alias("c"), "chunk_id", "left")
    fault = F.when(F.col("own").isNull(), "missing").when(F.col("own") != F.col("notice_id"), "notice").when(~F.col("l_topic").isin(*topics), "topic")
    return both.select("notice_id", "chunk_id", fault.alias("fault")).where("fault is not null")


def case_violations(notices: DataFrame, notice_labels: DataFrame, chunk_labels: DataFrame) -> DataFrame:
    """(case_id, notice_id, fault): what a case must not have.

    notices: (case_id, notice_id), as listed; notice_labels: (case_id, notice_id, grade); chunk_labels: (case_id,
    notice_id, chunk_id, grade).
    """
    key = ["case_id", "notice_id"]
    few = notices.groupBy("case_id").agg(F.countDistinct("notice_id").alias("n")).where("n < 2").select("case_id", F.lit(None).cast(notices.schema["notice_id"].dataType).alias("notice_id"), F.lit("fewer than two").alias("fault"))
    twice = notices.groupBy(*key).count().where("count > 1").select(*key, F.lit("repeated").alias("fault"))
    bare = notices.join(notice_labels, key, "left_anti").distinct().select(*key, F.lit("unlabelled").alias("fault"))
    strange = chunk_labels.join(notices, key, "left_anti").select(*key).distinct().select(*key, F.lit("not listed").alias("fault"))
    grades = notice_labels.select(*key, "grade").unionByName(chunk_labels.select(*key, "grade"))
    off = grades.where("grade is null or grade not between 0 and 3").select(*key).distinct().select(*key, F.lit("grade").alias("fault"))
    return few.unionByName(twice).unionByName(bare).unionByName(strange).unionByName(off)


def snapshot_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Places (ordinal) where two lists (ordinal, source, id, text, embedding_sha256) differ."""
    names = ["source", "id", "text", "embedding_sha256"]
    both = stored.alias("s").join(current.alias("c"), "ordinal", "full")
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"s.{n}").eqNullSafe(F.col(f"c.{n}"))
    return both.where(~same).select("ordinal")


def build_cases(rows: DataFrame) -> DataFrame:
    """(case_id, company_id, notice_id, notice_grade, chunk_id, chunk_grade) of checked label rows.

    rows hold texts: case_id, company_id, bid_notice_id, notice_relevance, chunk_id, chunk_relevance and perhaps
    final_chunk_relevance, which then counts. Inconsistent or blank labels and grades outside 0..3 are errors.
    """
    final = "final_chunk_relevance" if "final_chunk_relevance" in rows.columns else "chunk_relevance"
    bad = conflicts(rows, ["case_id", "bid_notice_id"], "notice_relevance")
    if not bad.isEmpty():
        raise ValueError("notice_relevance must be filled consistently")
    grade = lambda c: F.trim(F.col(c)).try_cast("int")
    out = rows.select("case_id", F.col("company_id").cast("long").alias("company_id"), F.col("bid_notice_id").cast("long").alias("notice_id"), grade("notice_relevance").alias("notice_grade"), F.col("chunk_id").cast("long").alias("chunk_id"), grade(final).alias("chunk_grade"))
    off = out.where("notice_grade is null or chunk_grade is null or notice_grade not between 0 and 3 or chunk_grade not between 0 and 3")
    if not off.isEmpty():
        raise ValueError("a grade is blank or outside 0..3")
    return out


def overlay(rows: DataFrame, cases: DataFrame, suffix: str = "-notice-only") -> DataFrame:
    """Rows with the notice grades of the cases (case_id, notice_id, grade), also of cases named with the suffix."""
    both = cases.unionByName(cases.withColumn("case_id", F.regexp_replace("case_id", f"{suffix}$", ""))).distinct()
    named = both.groupBy("case_id", "notice_id").agg(F.max("grade").alias("grade"))
    return rows.join(named, ["case_id", "notice_id"], "left")

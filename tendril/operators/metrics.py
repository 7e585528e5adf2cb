"""Retrieval quality over graded labels: one row per judged group, and macro averages of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(ranked: DataFrame, labels: DataFrame, group: list[str], item: str) -> DataFrame:
    """All labels with a grade above 0 and all ranked items: (group, item, rank, grade)."""
    return labels.select(*group, item, "grade").join(ranked.select(*group, item, "rank"), [*group, item], "full").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _recall(k: int, least: int) -> Column:
    hit = F.count(F.when((F.col("grade") >= least) & (F.col("rank") <= k), 1))
    return hit / F.nullif(F.count(F.when(F.col("grade") >= least, 1)), F.lit(0))


def _hit(k: int, least: int) -> Column:
    judged = F.max((F.col("grade") >= least).cast("int")) == 1
    return F.when(judged, F.max(F.when((F.col("grade") >= least) & (F.col("rank") <= k), 1.0).otherwise(0.0)))


def _reciprocal(least: int) -> Column:
    judged = F.max((F.col("grade") >= least).cast("int")) == 1
    return F.when(judged, F.coalesce(1.0 / F.min(F.when(F.col("grade") >= least, F.col("rank"))), F.lit(0.0)))


def _gain(place: str, k: int, grade: str = "grade") -> Column:
    return F.sum(F.when(F.col(place) <= k, (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(F.col(place) + 1)).otherwise(0.0))


def per_group(ranked: DataFrame, labels: DataFrame, group: list[str], item: str, ks: tuple[int, ...] = (10,), least: int = 1, candidate_k: int | None = None) -> DataFrame:
    """Recall, hit rate, reciprocal rank and nDCG of each group that has a label of ``least`` or more.

    ranked: (group, item, rank from 1); labels: (group, item, grade). A recall at more than ``candidate_k`` is null. The ideal
    order is cut to the largest k before a group's rows meet.
    """
    both = _joined(ranked, labels, group, item)
    ideal = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("grade"), F.col(item)))
    best = both.where("grade > 0").withColumn("ideal", ideal).where(F.col("ideal") <= max(ks, default=0)).select(*group, "ideal", F.col("grade").alias("best"))
    both = both.select(*group, "rank", "grade").unionByName(best, allowMissingColumns=True)
    r = lambda c: F.round(c, 6)
    columns = []
    for k in ks:
        known = candidate_k is None or k <= candidate_k
        columns.append((r(_recall(k, least)) if known else F.lit(None).cast("double")).alias(f"recall_{k}"))
        columns.append(r(_hit(k, least)).alias(f"hit_{k}"))
        columns.append(r(F.coalesce(_gain("rank", k) / F.nullif(_gain("ideal", k, "best"), F.lit(0.0)), F.lit(0.0))).alias(f"ndcg_{k}"))
    judged = F.max("grade") >= least
    return both.groupBy(*group).agg(judged.alias("judged"), *columns, r(_reciprocal(least)).alias("rr")).where("judged").drop("judged")


def macro(found: DataFrame, group: list[str]) -> DataFrame:
    """Averages over the judged groups; null if there are none."""
    return found.agg(F.count("*").alias("groups"), *[F.round(F.avg(c), 6).alias(c) for c in found.columns if c not in group])


def percentile(rows: DataFrame, value: str, percents: tuple[float, ...], by: list[str]) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return rows.groupBy(*by).agg(*[F.round(F.percentile(value, p / 100), 6).alias(f"p{p:g}") for p in percents])

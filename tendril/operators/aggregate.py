"""From chunk scores to one score per notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _methods(final_k: int) -> dict[str, Column]:
    score, rank = F.col("score"), F.col("rank")
    cut = rank <= final_k
    return {
        "sum_top_k": F.sum(F.when(cut, score)),
        "max": F.max(F.when(cut, score)),
        "sum_top_3": F.sum(F.when(cut & (rank <= 3), score)),
        "discounted_sum": F.sum(F.when(cut, score / F.log2(rank + 1))),
    }


METHODS = ("sum_top_k", "max", "sum_top_3", "discounted_sum")


def rank_notices(ranked: DataFrame, notices: DataFrame, method: str = "sum_top_k", final_k: int = 10) -> DataFrame:
    """(notice_id, notice_score) of all notices from ranked chunks (notice_id, rank, score); 0 without chunks."""
    if method not in METHODS:
        raise ValueError(f"method: {method!r}")
    scores = ranked.groupBy("notice_id").agg(F.round(_methods(final_k)[method], 6).alias("notice_score"))
    return notices.join(scores, "notice_id", "left").select("notice_id", F.coalesce("notice_score", F.lit(0.0)).alias("notice_score"))

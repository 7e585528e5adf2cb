"""Asking again: rounds over the rows that have no sufficient answer yet, at most so many, with what was found so far kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize

ATTEMPTS = 2
#: (rows that are open, attempt from 1) -> (key, query): what each row asks in this attempt.
Ask = Callable[[DataFrame, int], DataFrame]
#: (key, query) -> (key, query, results), results: an array, null where the search failed.
Search = Callable[[DataFrame], DataFrame]
#: (rows that are open, with all their results so far) -> (key, sufficient, reason).
Judge = Callable[[DataFrame], DataFrame]


def until_sufficient(rows: DataFrame, key: str, ask: Ask, search: Search, judge: Judge, attempts: int = ATTEMPTS) -> DataFrame:
    """The rows with attempts, queries and results (of all attempts, by attempt and query), n_failed, sufficient and reason.

    Each round takes the rows that are still open, which an anti-join leaves; its searches run side by side, and one that
    fails is counted and left out. A row that asks nothing, or whose judgement is missing, is not sufficient. Rounds are
    written, so the lineage does not grow with them and a search is not made twice. ``key`` names a row.
    """
    if attempts < 1:
        raise ValueError("attempts >= 1")
    open_rows, rounds, judged = rows, [], []
    kind = None
    for attempt in range(1, attempts + 1):
        found = materialize(search(ask(open_rows, attempt)).select(key, "query", "results").withColumn("attempt", F.lit(attempt)), "searched")
        kind = kind or found.schema["results"].dataType.simpleString()
        rounds.append(found)
        seen = _gathered(reduce(DataFrame.unionByName, rounds), key)
        have = open_rows.join(seen, key, "left").withColumn("results", F.coalesce("results", F.array().cast(kind)))
        told = judge(have).select(key, F.coalesce("sufficient", F.lit(False)).alias("sufficient"), "reason")
        told = materialize(open_rows.select(key).join(told, key, "left").withColumns({"sufficient": F.coalesce("sufficient", F.lit(False)), "attempts": F.lit(attempt)}), "judged")
        judged.append(told)
        open_rows = open_rows.join(told.where("sufficient"), key, "left_anti")
    last = reduce(DataFrame.unionByName, judged).groupBy(key).agg(F.max_by(F.struct("attempts", "sufficient", "reason"), "attempts").alias("j"))
    seen = _gathered(reduce(DataFrame.unionByName, rounds), key)
    empty = {"queries": F.array().cast("array<string>"), "results": F.array().cast(kind), "n_failed": F.lit(0).cast("long")}
    whole = rows.join(last, key).join(seen, key, "left")
    return whole.select(*rows.columns, "j.attempts", *[F.coalesce(c, none).alias(c) for c, none in empty.items()], "j.sufficient", "j.reason")


def _gathered(found: DataFrame, key: str) -> DataFrame:
    """(key, queries, results, n_failed) of all searches of a row, in the order of attempts and queries."""
    each = F.sort_array(F.collect_list(F.struct("attempt", "query", "results")))
    rows = found.groupBy(key).agg(each.alias("each"), F.count(F.when(F.col("results").isNull(), 1)).alias("n_failed"))
    results = F.flatten(F.filter(F.transform("each", lambda x: x["results"]), lambda r: r.isNotNull()))
    return rows.select(key, F.transform("each", lambda x: x["query"]).alias("queries"), results.alias("results"), "n_failed")

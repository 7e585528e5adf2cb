"""Asking again against a plain loop, and the query against SQL."""

import pytest
from pyspark.sql import functions as F

from tendril.operators import retry
from tendril.plans import registry
from tests.compare import duck, same

ANSWERS = {"a": [1], "b": [2, 3], "c": None, "d": [], "e": [4, 5, 6]}
ROWS = [(1, ["e"], ["a"]), (2, ["a"], ["b", "a"]), (3, ["c"], ["c", "a"]), (4, [], ["d"]), (5, ["a", "c"], []), (6, ["b", "e"], ["a"]), (7, None, None)]


def plain(attempts):
    out = []
    for key, *asked in ROWS:
        queries, results, failed, n = [], [], 0, 0
        while n < attempts and (n == 0 or len(results) < 3):
            for q in sorted((asked[n] if n < 2 else []) or []):
                queries.append(q)
                failed += ANSWERS[q] is None
                results += ANSWERS[q] or []
            n += 1
        out.append((key, n, queries, results, failed, len(results) >= 3))
    return out


@pytest.mark.parametrize("attempts", [1, 2, 3])
def test_equals_a_plain_loop(spark, attempts):
    rows = spark.createDataFrame(ROWS, "id long, first array<string>, second array<string>")
    answers = spark.createDataFrame(list(ANSWERS.items()), "query string, results array<int>")
    met = []

    def ask(open_rows, attempt):
        met.append(sorted(r.id for r in open_rows.collect()))
        return open_rows.select("id", F.explode(("first", "second")[attempt - 1] if attempt < 3 else F.array().cast("array<string>")).alias("query"))

    got = retry.until_sufficient(rows, "id", ask, lambda asked: asked.join(answers, "query"), lambda have: have.select("id", (F.size("results") >= 3).alias("sufficient"), F.lit("size").alias("reason")), attempts)
    assert sorted((r.id, r.attempts, r.queries, r.results, r.n_failed, r.sufficient) for r in got.collect()) == plain(attempts)
    assert met[0] == [1, 2, 3, 4, 5, 6, 7] and all(m == [2, 3, 4, 5, 7] for m in met[1:2])
    assert got.columns == ["id", "first", "second", "attempts", "queries", "results", "n_failed", "sufficient", "reason"]
    assert retry.until_sufficient(rows.where("false"), "id", lambda o, k: o.select("id", F.lit("a").alias("query")), lambda asked: asked.join(answers, "query"), lambda have: have.select("id", F.lit(True).alias("sufficient"), F.lit("").alias("reason"))).count() == 0


def test_bounds(spark):
    with pytest.raises(ValueError):
        retry.until_sufficient(spark.range(1), "id", None, None, None, 0)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    same(duck(d), registry.QUERIES["search_again"](spark, d), registry.ORACLE_SQL["search_again"])
    assert registry.QUERIES["search_again"](spark, d).select("attempts").distinct().count() == 2

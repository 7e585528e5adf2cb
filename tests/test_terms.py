"""Numbers of chunks of terms, without dealing postings."""

from tendril.operators import lexical


def _index(spark, rows):
    return lexical.build_index(spark.createDataFrame(rows, "chunk_id long, notice_id string, l_topic string, content string"))


def test_terms(spark):
    """Chunks count their terms once; chunks that come twice, nulls included, count as one."""
    one = _index(spark, [(1, "a", "en", "x x y"), (2, "a", None, "x"), (3, None, "en", None)])
    assert sorted(map(tuple, one.terms.collect())) == [("x", 2), ("y", 1)]
    assert "chunk_id" not in one.terms._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    twice = _index(spark, [(1, "a", None, "x y"), (1, "a", None, "x y"), (2, "a", "en", "x")])
    assert sorted(map(tuple, twice.terms.collect())) == [("x", 2), ("y", 1)]

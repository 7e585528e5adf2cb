"""What a guarded worker hands on of its rows."""

from tendril.streaming import queues


def _one(row):
    if not row["text"]:
        raise ValueError("empty")
    return [{"n": len(row["text"])}]


def test_only_the_key(spark):
    """The worker sees whole rows, and only what is kept is written with its results."""
    df = spark.createDataFrame([(1, "abc", "s"), (2, "", None), (None, "x", "t")], "doc_id long, text string, source string")
    found = queues.guarded(df, _one, "n int", keep=["doc_id"])
    assert found.schema["row"].dataType.names == ["doc_id"]
    assert sorted(((r.row.doc_id, r.results and [x.n for x in r.results], r.error) for r in found.collect()), key=str) == [(1, [3], None), (2, None, "ValueError: empty"), (None, [1], None)]
    assert queues.guarded(df, _one, "n int").schema["row"].dataType.names == df.columns

"""Chained queues: states, rows that fail, kills between and inside the steps."""

import time

import pytest
from pyspark.sql import functions as F

from tendril.plans import registry
from tendril.streaming import queues
from tests.compare import duck, same

SCHEMA = "notice_id long, text string"


def split(row):
    if row["text"] == "bad":
        raise RuntimeError("cannot read")
    return [{"part": k, "word": w} for k, w in enumerate((row["text"] or "").split())]


def measure(row):
    if row["word"] == "x":
        raise KeyError("x")
    return [{"part": row["part"], "size": len(row["word"])}]


@pytest.fixture
def chain(spark, tmp_path):
    first = queues.Step(spark, f"{tmp_path}/first", "notice_id", split, "part int, word string", "CHUNKED")
    second = queues.Step(spark, f"{tmp_path}/second", "notice_id", measure, "part int, size int", "EMBEDDED")

    def land(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)

    def source():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    return first, second, land, source


def told(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_states_of_a_chain(spark, chain):
    first, second, land, source = chain
    land([(1, "a bb"), (2, "bad"), (3, None), (4, "a x")])
    first.start(source()).awaitTermination()
    every = spark.createDataFrame([(k,) for k in range(1, 7)], "notice_id long")
    assert told(queues.states(every, "notice_id", [first]), "notice_id", "state") == [(1, "CHUNKED"), (2, "ERROR"), (3, "ERROR"), (4, "CHUNKED"), (5, "PENDING"), (6, "PENDING")]
    first.feed(second).awaitTermination()
    land([(5, "ccc")])
    first.start(source()).awaitTermination()
    got = {r.notice_id: (r.state, r.error) for r in queues.states(every, "notice_id", [first, second]).collect()}
    assert got == {1: ("EMBEDDED", None), 2: ("ERROR", "RuntimeError: cannot read"), 3: ("ERROR", "no results"), 4: ("ERROR", "KeyError: 'x'"), 5: ("CHUNKED", None), 6: ("PENDING", None)}
    first.feed(second).awaitTermination()
    assert told(second.results(), "notice_id", "part", "size") == [(1, 0, 1), (1, 1, 2), (4, 0, 1), (5, 0, 3)]


def test_kills_repeat_nothing(spark, chain, monkeypatch):
    """The first step dies behind its results and again behind its marker, before the checkpoint; the second dies once."""
    first, second, land, source = chain
    land([(1, "a bb")])
    land([(2, "ccc")])
    real, marks = queues.Step.each, []

    def dies(when):
        def each(self, batch, number):
            real(self, batch, number)
            if (when, number) not in marks:
                marks.append((when, number))
                raise RuntimeError("killed")

        return each

    for step, run in ((first, lambda: first.start(source())), (second, lambda: first.feed(second))):
        monkeypatch.setattr(queues.Step, "each", dies(step.path))
        for _ in range(4):
            try:
                run().awaitTermination()
            except Exception as e:
                assert "killed" in str(e)
        monkeypatch.setattr(queues.Step, "each", real)
    assert len(marks) >= 3
    assert told(first.results(), "notice_id", "part", "word") == [(1, 0, "a"), (1, 1, "bb"), (2, 0, "ccc")]
    assert told(second.results(), "notice_id", "part", "size") == [(1, 0, 1), (1, 1, 2), (2, 0, 3)]


def test_results_without_a_marker_are_replaced(spark, chain, tmp_path):
    first, second, land, source = chain
    land([(1, "a bb")])
    spark.createDataFrame([(9, 0, "left behind")], "notice_id long, part int, word string").write.parquet(f"{first.path}/results/batch=0")
    first.start(source()).awaitTermination()
    first.feed(second).awaitTermination()
    assert told(second.results(), "notice_id", "part", "size") == [(1, 0, 1), (1, 1, 2)]


def test_rows_that_are_repeated(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:30"), (2, "2024-01-01 00:00:31")]
    df = spark.createDataFrame(rows, "notice_id long, ts string").select("notice_id", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = queues.distinct(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "notice_id", "ts", "1 hour")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
    q.start().awaitTermination()
    df.limit(1).write.mode("append").parquet(f"{tmp_path}/in")
    q.start().awaitTermination()
    assert told(spark.read.parquet(f"{tmp_path}/out"), "notice_id") == [(1,), (2,)]


def test_query(spark):
    d = "/root/testdata/sf0.01"
    same(duck(d), registry.QUERIES["queue_states"](spark, d), registry.ORACLE_SQL["queue_states"])
    assert registry.QUERIES["queue_states"](spark, d).groupBy("error").count().count() >= 3

"""Results are seen whole or not at all."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from tendril.sources.sinks import ManifestSink


def told(sink):
    return sorted((r.name, r.n_rows) for r in sink.manifests().collect())


def test_formats(spark, tmp_path):
    sink = ManifestSink(spark, f"{tmp_path}/s", ("json", "csv", "parquet", "events"))
    rows = spark.createDataFrame([(1, 'a "b"\nc', [1, 2]), (2, None, None)], "id long, text string, list array<int>").coalesce(1)
    assert told(sink) == []
    assert sink.write(rows, "run 1/é") and not sink.write(rows, "run 1/é")
    assert told(sink) == [("run 1/é", 2)]
    assert sorted((r.id, r.text) for r in spark.read.parquet(*sink.paths("parquet")).collect()) == [(1, 'a "b"\nc'), (2, None)]
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(sink.paths("csv")).collect()
    assert sorted((r.id, r.text, r.list) for r in csv) == [("1", 'a "b"\nc', "[1,2]"), ("2", None, None)]
    assert sorted((r.id, r.text) for r in spark.read.json(sink.paths("json")).collect()) == [(1, 'a "b"\nc'), (2, None)]
    stream = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{sink.paths('events')[0]}/part-*")))
    assert [json.loads(e.removeprefix("data: ")) for e in stream.split("\n\n") if e] == [{"id": 1, "text": 'a "b"\nc', "list": [1, 2]}, {"id": 2, "text": None, "list": None}]
    assert stream.endswith("\n\n")


def test_what_fails_is_not_seen(spark, tmp_path, monkeypatch):
    sink = ManifestSink(spark, f"{tmp_path}/s", ("json", "csv"))
    with pytest.raises(Exception, match="USER_RAISED|no luck"):
        sink.write(spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no luck"))).otherwise(F.col("id").cast("string")).alias("x")), "a")
    assert told(sink) == []
    from tendril.sources import sinks

    real = sinks.FORMATS["csv"]
    monkeypatch.setitem(sinks.FORMATS, "csv", lambda rows, path: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        sink.write(spark.range(3).toDF("x"), "a")
    assert told(sink) == [] and glob.glob(f"{tmp_path}/s/data/*/json")  # what was left behind has no manifest
    monkeypatch.setitem(sinks.FORMATS, "csv", real)
    assert sink.write(spark.range(4).toDF("x"), "a")
    assert told(sink) == [("a", 4)] and len(sink.paths("json")) == 1
    with pytest.raises(ValueError):
        ManifestSink(spark, f"{tmp_path}/s", ("xml",)).write(spark.range(1).toDF("x"), "b")


def test_stream_that_is_killed(spark, tmp_path):
    sink = ManifestSink(spark, f"{tmp_path}/s", ("parquet",))
    spark.range(5).toDF("x").coalesce(1).write.parquet(f"{tmp_path}/in")
    killed = []

    def each(batch, number):
        sink.each(batch, number)
        if not killed:
            killed.append(number)
            raise RuntimeError("killed")

    start = lambda: spark.readStream.schema("x long").parquet(f"{tmp_path}/in").writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    with pytest.raises(Exception):
        start().awaitTermination()
    start().awaitTermination()
    assert told(sink) == [("batch 0", 5)] and spark.read.parquet(*sink.paths("parquet")).count() == 5

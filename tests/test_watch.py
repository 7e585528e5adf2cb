"""Watching sets: stream, batch and SQL tell the same events."""

from datetime import datetime, timedelta

import pytest

from tendril.plans import registry
from tendril.streaming import watch
from tests.compare import duck, same

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)
SCHEMA = "set_id long, ts timestamp, seq long, status string, current int, total int"
BATCHES = [
    [(1, at(0), 1, "running", 0, 9), (1, at(5), 2, "running", 0, 9), (2, at(1), 1, "running", 1, 9), (3, at(2), 1, "completed", 9, 9), (5, at(3), 1, None, None, None), (6, at(4), 1, "failed", 0, 9)],
    [(1, at(6), 3, "running", 4, 9), (2, at(7), 2, None, None, None), (3, at(8), 2, "running", 0, 9), (6, at(9), 2, "failed", 0, 9), (6, at(9), 3, "running", None, 9), (4, at(9), 1, "running", 0, 9)],
    [(1, at(400), 4, "running", 5, 9), (2, at(401), 3, "running", 0, 9), (7, at(402), 1, "running", 2, 9)],
    [(8, at(900), 1, "completed", 1, 1), (9, at(901), 1, "running", 1, 1), (8, at(902), 2, "running", 0, 1)],
]


def plain(rows, terminal):
    out, sets, latest = [], {}, max(r[1] for r in rows)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        sets.setdefault(r[0], []).append(r)
    for i, own in sets.items():
        until, last = own[0][1] + timedelta(seconds=300), None
        for _, ts, seq, *values in own:
            if ts > until:
                out.append((i, until, None, "timeout", None, None, None))
                break
            if values != last:
                out.append((i, ts, seq, "gone" if values[0] is None else "status", *values))
            last = values
            if values[0] is None or values[0] in terminal:
                break
        else:
            if latest > until:
                out.append((i, until, None, "timeout", None, None, None))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.set_id, r.ts, r.seq, r.kind, r.status, r.current, r.total) for r in df.collect()), key=str)


@pytest.mark.parametrize("terminal", [("completed",), ("completed", "failed")])
def test_batch(spark, terminal):
    rows = [r for b in BATCHES for r in b]
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(watch.events(df, terminal=terminal)) == plain(rows, terminal)
    assert told(watch.events(df.where("false"))) == []


def test_stream_with_restarts(spark, tmp_path):
    """A query for each batch, all from one checkpoint: state and timers survive, and nothing is told twice."""
    before = spark.conf.get(watch.STORE[0], None)
    spark.conf.set(*watch.STORE)
    try:
        for k, batch in enumerate(BATCHES):
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
            q = watch.stream_events(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    finally:
        spark.conf.set(watch.STORE[0], before) if before else spark.conf.unset(watch.STORE[0])
    got = told(spark.read.parquet(f"{tmp_path}/out"))
    assert got == plain([r for b in BATCHES for r in b], ("completed",))
    assert [r[3] for r in got if r[0] == 1] == ["status", "status", "timeout"] and {r[3] for r in got if r[0] == 4} == {"status", "timeout"}


def test_query(spark):
    for sf in ("0.001", "0.01"):
        d = f"/root/testdata/sf{sf}"
        same(duck(d), registry.QUERIES["status_events"](spark, d), registry.ORACLE_SQL["status_events"])
    kinds = {r.kind for r in registry.QUERIES["status_events"](spark, d).select("kind").distinct().collect()}
    assert kinds == {"status", "gone", "timeout"}

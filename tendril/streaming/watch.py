"""Watching sets until they end: status changes, sets that vanish, and a deadline, as a stream and as its batch twin.

A set is watched from its first row on. Each row that differs from the one before is a ``status`` event. A row without a
status says that the set is gone, which is a ``gone`` event and ends the watch; so does a terminal status, behind its own
event. Which ones are terminal is a parameter: some feeds go on after ``failed``. What has not ended by the deadline ends
with a ``timeout`` event there. A set that has ended sends nothing more; the stream forgets it after ``retain`` seconds, and would watch it anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COMPLETED = ("completed",)
SECONDS, RETAIN = 300, 86_400
#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_VALUES = ["status", "current", "total"]


def events(rows: DataFrame, key: str = "set_id", seconds: int = SECONDS, terminal: tuple[str, ...] = COMPLETED) -> DataFrame:
    """(key, ts, seq, kind, status, current, total) of rows (key, ts, seq, status, current, total), taken by (ts, seq).

    A timeout has the deadline as its time and no seq; it is told once a row of any set is later than the deadline.
    """
    order = Window.partitionBy(key).orderBy("ts", "seq")
    latest = F.broadcast(rows.agg(F.max("ts").alias("_latest")))  # one row
    until = F.expr(f"timestampadd(SECOND, {seconds}, _begun)")
    rows = rows.withColumn("_begun", F.min("ts").over(Window.partitionBy(key))).withColumn("_until", until)
    ends = F.col("status").isNull() | F.col("status").isin(*terminal)
    rows = rows.withColumn("_ends", ends.cast("int")).where("ts <= _until or _begun = ts")
    rows = rows.withColumn("_over", F.coalesce(F.sum("_ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_over = 0")
    now = F.struct(*_VALUES)
    changed = (F.row_number().over(order) == 1) | ~now.eqNullSafe(F.lag(now).over(order))
    told = rows.withColumn("_changed", changed).where("_changed")
    told = told.select(key, "ts", "seq", F.when(F.col("status").isNull(), "gone").otherwise("status").alias("kind"), *_VALUES)
    left = rows.groupBy(key).agg(F.max("_ends").alias("_ended"), F.first("_until").alias("ts")).where("_ended = 0")
    left = left.join(latest, F.col("_latest") > F.col("ts"))
    return told.unionByName(left.select(key, "ts", F.lit(None).cast("long").alias("seq"), F.lit("timeout").alias("kind"), *[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in _VALUES]))


class _Watch(StatefulProcessor):
    def __init__(self, key: str, seconds: int, terminal: tuple[str, ...], retain: int):
        self.key, self.seconds, self.terminal, self.retain = key, seconds, terminal, retain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "until long, over boolean, status string, current int, total int")

    def _row(self, key, ts, seq, kind, values=(None, None, None)) -> tuple:
        return (key[0], ts, seq, kind, *values)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=[self.key, "ts", "seq", "kind", *_VALUES])
        return found.astype({"seq": "Int64", "current": "Int32", "total": "Int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until, over, *values = self.last.get() if self.last.exists() else (None, False, None, None, None)
        if over:
            return
        fresh, out = until is None, []
        whole = pd.concat(list(rows)).sort_values(["ts", "seq"])
        columns = [whole[c] for c in ("ts", "seq", *_VALUES)]
        for ts, seq, status, current, total in zip(*columns, strict=True):
            at = ts.value // 1_000
            if until is None:
                until = at + self.seconds * 1_000_000
            if at > until and not (fresh and not out):
                out.append(self._row(key, pd.Timestamp(until * 1_000), None, "timeout"))
                over = True
            else:
                now = [None if pd.isna(x) else x for x in (status, current, total)]
                now = [now[0], *(None if x is None else int(x) for x in now[1:])]
                if (fresh and not out) or now != list(values):
                    out.append(self._row(key, ts, seq, "gone" if now[0] is None else "status", now))
                values, over = now, now[0] is None or now[0] in self.terminal
            if over:
                break
        self.last.update((until, over, *values))
        self._wake(until, over)
        if out:
            yield self._frame(out)

    def _wake(self, until: int, over: bool) -> None:
        """One timer: at the deadline, or when an ended set may be forgotten."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until // 1_000 + 1 + (self.retain * 1_000 if over else 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        until, over, *values = self.last.get()
        if over:
            self.last.clear()
            return
        self.last.update((until, True, *values))
        self.handle.registerTimer(until // 1_000 + 1 + self.retain * 1_000)
        yield self._frame([self._row(key, pd.Timestamp(until * 1_000), None, "timeout")])

    def close(self) -> None:
        pass


def stream_events(rows: DataFrame, key: str = "set_id", seconds: int = SECONDS, terminal: tuple[str, ...] = COMPLETED, delay: str = "0 seconds", retain: int = RETAIN) -> DataFrame:
    """``events`` of a stream. A set's rows come in order, those of one batch in any; a deadline is met when the watermark,
    ``delay`` behind the latest row of all sets, has passed it, or a later row of the set comes. The session's state store must be ``STORE``."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, ts timestamp, seq long, kind string, status string, current int, total int"
    watched = rows.withWatermark("ts", delay).groupBy(key)
    return watched.transformWithStateInPandas(_Watch(key, seconds, terminal, retain), schema, "append", "eventTime")

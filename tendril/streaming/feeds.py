"""Change feeds and work queues: Structured Streaming, and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A set in one of these states sends nothing more.
TERMINAL = ("completed", "failed")


def changes(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Rows whose values differ from those of the row before, of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*values)
    before = F.lag(now).over(w)
    return rows.withColumn("_new", (F.row_number().over(w) == 1) | ~now.eqNullSafe(before)).where("_new").drop("_new")


def monotone(rows: DataFrame, key: str, order: list[str], value: str, out: str = "progress") -> DataFrame:
    """Adds the progress: 0 where the value is 0, else the largest value since the last 0."""
    w = Window.partitionBy(key).orderBy(*order)
    reset = rows.withColumn("_epoch", F.sum((F.col(value) == 0).cast("int")).over(w))
    top = F.max(value).over(Window.partitionBy(key, "_epoch").orderBy(*order))
    return reset.withColumn(out, F.greatest(top, F.lit(0))).drop("_epoch")


def stream_changes(rows: DataFrame, key: str = "set_id") -> DataFrame:
    """(set_id, seq, status, current): the change feed of a stream of (set_id, seq, status, current).

    The last tuple of each set is its state; a set that has ended sends nothing more. Rows of one batch are taken in the
    order of ``seq``.
    """

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            if last is not None and last[0] in TERMINAL:
                break
            if last is None or (r.status, r.current) != tuple(last):
                out.append((k[0], r.seq, r.status, r.current))
                last = (r.status, int(r.current))
        if last is not None:
            state.update(tuple(last))
        if out:
            yield pd.DataFrame(out, columns=[key, "seq", "status", "current"])

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, seq long, status string, current int", "status string, current int", "append", GroupStateTimeout.NoTimeout)


def stream_progress(rows: DataFrame, key: str = "set_id") -> DataFrame:
    """(set_id, seq, progress): the monotone progress of a stream of (set_id, seq, current)."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else 0
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            top = 0 if r.current == 0 else max(top, int(r.current))
            out.append((k[0], r.seq, top))
        state.update((top,))
        yield pd.DataFrame(out, columns=[key, "seq", "progress"])

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, seq long, progress int", "top int", "append", GroupStateTimeout.NoTimeout)


def work(source: DataFrame, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Run a step over what has landed since the last time, batch by batch, and append its results as Parquet.

    A batch that is repeated after a failure replaces its own folder, so each row counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

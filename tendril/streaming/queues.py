"""Chained work queues: what has landed is worked on once, and what one step has committed is the next step's input.

A batch's results and the states of its rows are written to folders of its number; a marker in ``commits`` is written last.
A batch that is run again after a failure finds its marker and does nothing, or finds none and replaces what it left behind.
The next step reads the markers as its stream, so it never sees a batch without one, and starts where its own checkpoint
says, however often either step was killed.

A worker gets one row and may fail: the row's state is then ``ERROR`` with the message, and no other row is touched.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from ..functions.batches import slices
from ..functions.storage import materialize

#: What a worker gives for a row: results, as many as it likes.
Worker = Callable[[dict], list[dict]]
ERROR = "ERROR"


def guarded(rows: DataFrame, worker: Worker, schema: str, keep: Sequence[str] | None = None) -> DataFrame:
    """(row, results, error): each row as a struct, of the columns in ``keep`` where it is given, the worker's results of
    that schema, and the message if it failed; a worker that gives nothing has failed too."""
    kind: StructType = _parse_datatype_string(schema)
    names = kind.names
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))

    def one(row: dict) -> tuple[list[dict] | None, str | None]:
        try:
            found = [{c: x[c] for c in names} for x in worker(row)]
        except Exception as e:  # noqa: BLE001  told in the row's state
            return None, f"{type(e).__name__}: {e}"
        return (found, None) if found else (None, "no results")

    whole = packed.schema["row"].dataType
    kept = whole if keep is None else StructType([f for f in whole.fields if f.name in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row = b.column(0)
            if keep is not None:
                columns = row.flatten()
                row = pa.StructArray.from_arrays([columns[whole.names.index(c)] for c in kept.names], kept.names)
            told = [one(x) for x in b.column(0).to_pylist()]
            results = pa.array([None if r is None else json.dumps(r) for r, _ in told], pa.string())
            yield pa.RecordBatch.from_arrays([row, results, pa.array([e for _, e in told], pa.string())], ["row", "results", "error"])

    found = packed.mapInArrow(run, StructType([StructField("row", kept), StructField("results", StringType()), StructField("error", StringType())]))
    return found.select("row", F.from_json("results", f"array<{kind.simpleString()}>").alias("results"), "error")


@dataclass
class Step:
    """One step of a chain, in a folder that the driver and all executors share.

    Its results are in ``results``, (``key``, the worker's columns), and the states of its rows in ``states``, (``key``,
    state, error).
    """

    spark: SparkSession
    path: str
    key: str
    worker: Worker
    schema: str
    state: str

    def _committed(self, number: int) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{number}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def each(self, batch: DataFrame, number: int) -> None:
        if self._committed(number):
            return
        found = materialize(guarded(batch, self.worker, self.schema, keep=[self.key]), "worked")
        key = F.col(f"row.`{self.key}`").alias(self.key)
        found.where("error is null").select(key, F.explode("results").alias("x")).select(self.key, "x.*").write.mode("overwrite").parquet(f"{self.path}/results/batch={number}")
        found.select(key, F.when(F.col("error").isNull(), self.state).otherwise(ERROR).alias("state"), "error").write.mode("overwrite").parquet(f"{self.path}/states/batch={number}")
        self.spark.range(number, number + 1).toDF("batch").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{number}")

    def start(self, source: DataFrame):
        """Work on a stream of rows with the key."""
        return source.writeStream.foreachBatch(self.each).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def _read(self, table: str, numbers: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/batch={n}" for n in numbers]).drop("batch")

    def numbers(self) -> list[int]:
        return sorted(r.batch for r in self.spark.read.schema("batch long").parquet(f"{self.path}/commits/*").collect())

    def results(self) -> DataFrame:
        return self._read("results", self.numbers())

    def states(self) -> DataFrame:
        return self._read("states", self.numbers())

    def feed(self, then: Step):
        """Start the next step on what this one has committed, and the next step's worker on its results."""
        markers = self.spark.readStream.schema("batch long").option("pathGlobFilter", "*.parquet").parquet(f"{self.path}/commits/*")

        def each(batch: DataFrame, number: int) -> None:
            numbers = [r.batch for r in batch.collect()]  # batches, not rows
            if numbers:
                then.each(self._read("results", numbers), number)

        return markers.writeStream.foreachBatch(each).option("checkpointLocation", f"{then.path}/checkpoint").trigger(availableNow=True).start()


def distinct(source: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """A stream without rows that repeat a key within the delay; what was seen longer ago is forgotten."""
    return source.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def states(rows: DataFrame, key: str, steps: list[Step], waiting: str = "PENDING") -> DataFrame:
    """(key, state, error) of all rows: that of the last step that has come to them. A row is in error if any of its parts is,
    and behind the last step when all its parts are."""
    told = rows.select(key).distinct().select(key, F.lit(waiting).alias("state"), F.lit(None).cast("string").alias("error"), F.lit(-1).alias("_step"))
    for k, step in enumerate(steps):
        parts = step.states().groupBy(key).agg(F.min(F.struct((F.col("state") != ERROR).alias("fine"), "state", "error")).alias("x"))
        told = told.unionByName(parts.select(key, "x.state", "x.error", F.lit(k).alias("_step")))
    return told.groupBy(key).agg(F.max_by(F.struct("state", "error"), "_step").alias("x")).select(key, "x.state", "x.error")

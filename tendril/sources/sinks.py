"""Sinks that show a result whole or not at all.

A write goes into a folder of its own; when all its formats are there, a manifest tells of it: one row with its name, folder,
formats and number of rows, written last. Readers take what manifests tell, so a task or driver that dies leaves nothing to
be seen. A name is written once: a batch that is repeated after a failure finds its manifest and does nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .files import flat, sse

MANIFEST = "name string, folder string, formats array<string>, n_rows long"


def _events(rows: DataFrame, path: str) -> None:
    """Server-sent events one after another; the writer puts the empty line behind each."""
    rows = sse(rows).select(F.regexp_replace("event", "\n\n$", "").alias("value"))
    rows.write.option("lineSep", "\n\n").text(path)


#: How a table is written in each format.
FORMATS: dict[str, Callable[[DataFrame, str], None]] = {
    "json": lambda rows, path: rows.write.option("ignoreNullFields", False).json(path),
    "csv": lambda rows, path: flat(rows).write.option("header", True).option("escape", '"').csv(path),
    "parquet": lambda rows, path: rows.write.parquet(path),
    "events": _events,
}


@dataclass
class ManifestSink:
    """Results by name, in a folder that the driver and all executors share."""

    spark: SparkSession
    path: str
    formats: tuple[str, ...] = ("json", "csv")

    def _manifest(self, name: str) -> str:
        """Names may hold any character; a manifest's folder has its digest."""
        return f"{self.path}/manifests/{hashlib.sha256(name.encode()).hexdigest()}"

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def write(self, rows: DataFrame, name: str) -> bool:
        """Write the rows under a name; False if the name is there already."""
        if unknown := [f for f in self.formats if f not in FORMATS]:
            raise ValueError(f"formats: {unknown}")
        manifest = self._manifest(name)
        if self._exists(f"{manifest}/_SUCCESS"):
            return False
        rows = materialize(rows, "results")  # computed once, whatever the number of formats
        folder = uuid.uuid4().hex
        for f in self.formats:
            FORMATS[f](rows, f"{self.path}/data/{folder}/{f}")
        told = self.spark.createDataFrame([(name, folder, list(self.formats), rows.count())], MANIFEST)
        told.coalesce(1).write.mode("overwrite").json(manifest)
        return True

    def each(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``: a batch under its number."""
        self.write(batch, f"batch {number}")

    def manifests(self) -> DataFrame:
        """(name, folder, formats, n_rows) of what has been written whole."""
        if not self._exists(f"{self.path}/manifests"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/*")

    def paths(self, form: str) -> list[str]:
        """Folders of one format, by name."""
        rows = self.manifests().where(F.array_contains("formats", form)).orderBy("name").collect()
        return [f"{self.path}/data/{r.folder}/{form}" for r in rows]

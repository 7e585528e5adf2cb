"""Vectors that are kept in lists around centroids, and exact search that skips lists.

Centroids are fitted on a bounded sample of directions; every vector is then put in the list of its nearest centroid. A list
knows, for each notice and topic, how many vectors it has and the widest angle between one of them and the centroid. Angles
obey the triangle inequality: no vector of a list is nearer to a target than the angle between target and centroid less that
widest angle. So the k closest of a notice are found in the lists nearest to the target that hold k vectors, and in those
whose bound does not exceed the k-th distance found there; all others are skipped. The result is exact.

A folder holds ``centroids``, written once, and ``vectors`` and ``lists`` by generations, of which one counts when its row in
``generations`` is written, as its last. Vectors without a length, or of another width than the centroids, have the
distance 1 to everything and a list of their own; rows without a vector are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .dense import MAX_TARGETS, _matrix, _rounded
from .lexical import top

#: Vectors that fit the centroids at most, lists, and rounds of the fit.
SAMPLE, LISTS, ROUNDS = 20_000, 64, 6
#: The list of vectors without a direction, and what rounding may hide.
NO_LIST, MARGIN = -1, 2e-6


def _directions(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, whether they have a length)."""
    own, length = _matrix(vectors, width)
    return own / np.where(length > 0, length, 1)[:, None], length > 0


def _fitted(sample: np.ndarray) -> np.ndarray:
    """Unit centroids of unit vectors, farthest first and then Lloyd's rounds."""
    if not len(sample):
        return sample
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(LISTS, len(sample)) and near.min() < 1 - 1e-12:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    centroids = sample[chosen]
    for _ in range(ROUNDS):
        own = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums**2).sum(1, keepdims=True))
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


@dataclass
class KeptVectors:
    spark: SparkSession
    path: str

    def _centroids(self) -> np.ndarray:
        rows = self.spark.read.schema("centroid array<double>, list int").parquet(f"{self.path}/centroids").orderBy("list").collect()
        return np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0))

    def create(self, chunks: DataFrame) -> None:
        """Fit the centroids on SAMPLE vectors with the least hashes of their ids, of the width that most of these have."""
        drawn = chunks.where("embedding is not null").orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
        widths = np.bincount(drawn.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) if len(drawn) else np.zeros(1, np.int64)
        unit, good = _directions(drawn, int(widths.argmax())) if len(drawn) else (np.zeros((0, 0)), np.zeros(0, bool))
        rows = [(c.tolist(), k) for k, c in enumerate(_fitted(unit[good]))]
        self.spark.createDataFrame(rows, "centroid array<double>, list int").coalesce(1).write.parquet(f"{self.path}/centroids")

    def append(self, chunks: DataFrame) -> None:
        """Add rows (notice_id, chunk_id, l_topic, embedding) whose ids are not there yet."""
        centroids = self._centroids()
        rows = chunks.where("embedding is not null").select("notice_id", "chunk_id", "l_topic", F.col("embedding").cast("array<double>").alias("embedding"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                listed, angle = np.full(b.num_rows, NO_LIST), np.zeros(b.num_rows)
                if len(centroids) and b.num_rows:
                    unit, good = _directions(b.column("embedding"), centroids.shape[1])
                    near = unit @ centroids.T
                    listed = np.where(good, near.argmax(1), NO_LIST)
                    angle = np.where(good, _angle(near.max(1)), 0.0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(listed, pa.int32()), pa.array(angle)], [*b.schema.names, "list", "angle"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", list int, angle double"
        generation = uuid.uuid4().hex
        placed = materialize(rows.mapInArrow(run, schema), "placed").withColumn("generation", F.lit(generation))
        placed.repartitionByRange("list", "notice_id", "chunk_id").write.partitionBy("generation", "list").mode("append").parquet(f"{self.path}/vectors")
        lists = placed.groupBy("generation", "list", "notice_id", "l_topic").agg(F.count("*").alias("n"), F.max("angle").alias("widest"))
        lists.write.mode("append").parquet(f"{self.path}/lists")
        self.spark.createDataFrame([(generation,)], "generation string").coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def best(self, targets: DataFrame, limit: int, topics: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
        """((notice_id, ordinal, chunk_id, distance, rank), (n_read, n_lists)): of each notice and target (ordinal, embedding)
        the ``limit`` closest chunks, equally close ones by id, as ``dense.distances`` and ``lexical.top`` tell them; and how
        many of the notices' lists were read for a target. At most MAX_TARGETS targets."""
        centroids, spark = self._centroids(), self.spark
        asked = targets.where("embedding is not null").select("ordinal", F.col("embedding").cast("array<double>").alias("embedding")).orderBy("ordinal").limit(MAX_TARGETS + 1).toArrow()
        if asked.num_rows > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets")
        committed = [r.generation for r in spark.read.parquet(f"{self.path}/generations").collect()]
        kept = lambda table: spark.read.parquet(f"{self.path}/{table}").where(F.col("generation").isin(committed))
        scoped = lambda df: df if topics is None else df.where(F.col("l_topic").isin(*topics))
        ordinals, vectors = asked.column("ordinal").to_pylist(), asked.column("embedding").combine_chunks()
        width = len(vectors[0]) if len(vectors) else 0
        far, far_length = _matrix(vectors, width)
        there = far_length > 0
        if width == centroids.shape[1] and len(centroids):
            angles = _angle((far / np.where(there, far_length, 1)[:, None]) @ centroids.T)
        else:
            angles, there = np.zeros((len(ordinals), len(centroids))), np.zeros(len(ordinals), bool)
        kind = targets.schema["ordinal"].dataType.simpleString()
        to_lists = [(o, k, float(a) if there[i] else None) for i, o in enumerate(ordinals) for k, a in [*enumerate(angles[i]), (NO_LIST, 0.0)]]
        sides = spark.createDataFrame(to_lists, f"ordinal {kind}, list int, to_list double")
        lists = scoped(kept("lists")).groupBy("notice_id", "list").agg(F.sum("n").alias("n"), F.max("widest").alias("widest"))
        # A target or a vector without a direction is at distance 1; otherwise one minus the cosine of the least angle.
        least = F.when(F.col("to_list").isNull() | (F.col("list") == NO_LIST), 1.0 if width == centroids.shape[1] else 0.0).otherwise(1 - F.cos(F.greatest(F.col("to_list") - F.col("widest"), F.lit(0.0))))
        bounds = materialize(lists.join(F.broadcast(sides), "list").withColumn("least", least), "bounds")
        group = Window.partitionBy("notice_id", "ordinal").orderBy("least", "list").rowsBetween(Window.unboundedPreceding, -1)
        bounds = bounds.withColumn("_before", F.coalesce(F.sum("n").over(group), F.lit(0)))

        def scored(chosen: DataFrame) -> DataFrame:
            """(notice_id, chunk_id, ordinal, distance) of chosen (notice_id, list, ordinal)."""
            wanted = chosen.groupBy("notice_id", "list").agg(F.collect_list("ordinal").alias("ordinals")).withColumnRenamed("notice_id", "_notice").withColumnRenamed("list", "_list")
            rows = scoped(kept("vectors")).join(wanted, (F.col("list") == F.col("_list")) & F.col("notice_id").eqNullSafe(F.col("_notice")))
            rows = rows.select("notice_id", "chunk_id", "embedding", "ordinals")
            number = {o: i for i, o in enumerate(ordinals)}

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    own, length = _matrix(b.column("embedding"), width)
                    asked = b.column("ordinals")
                    row = np.repeat(np.arange(len(own)), asked.value_lengths().to_numpy(zero_copy_only=False))
                    flat = asked.flatten()
                    at = np.array([number[o] for o in flat.to_pylist()], np.int64)
                    both = length[:, None] * far_length
                    d = _rounded(np.where(both > 0, 1 - own @ far.T / np.where(both > 0, both, 1), 1.0))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([b.column("notice_id").take(take), b.column("chunk_id").take(take), flat, pa.array(d[row, at])], ["notice_id", "chunk_id", "ordinal", "distance"])

            names = {f.name: f.dataType.simpleString() for f in rows.schema}
            return rows.mapInArrow(run, f"notice_id {names['notice_id']}, chunk_id {names['chunk_id']}, ordinal {kind}, distance double")

        nearest = lambda df: top(df, limit, ["notice_id", "ordinal"], "distance", largest=False)
        seeds = materialize(bounds.where(F.col("_before") < limit).select("notice_id", "list", "ordinal"), "seeds")
        first = materialize(nearest(scored(seeds)).drop("rank"), "first")
        enough = first.groupBy("notice_id", "ordinal").agg(F.max("distance").alias("most"), F.count("*").alias("have")).where(F.col("have") == limit)
        enough = enough.select(F.col("notice_id").alias("_notice"), F.col("ordinal").alias("_ordinal"), "most")
        rest = bounds.where(F.col("_before") >= limit).join(enough, F.col("notice_id").eqNullSafe(F.col("_notice")) & (F.col("ordinal") == F.col("_ordinal")), "left")
        rest = materialize(rest.where(F.col("most").isNull() | (F.col("least") <= F.col("most") + MARGIN)).select("notice_id", "list", "ordinal"), "rest")
        found = nearest(first.unionByName(scored(rest))).select("notice_id", "ordinal", "chunk_id", "distance", "rank")
        read = seeds.unionByName(rest).agg(F.count("*").alias("n_read"))
        return found, read.join(bounds.agg(F.count("*").alias("n_lists")))

"""Exact search by cosine distance, as batched matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Targets that are sent to every task at once; more are compared in blocks of so many, one scan of the chunks each.
MAX_TARGETS = 5_000
#: Distances are equal if they are in so many digits.
DIGITS = 6


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 10**DIGITS + 0.5) / 10**DIGITS


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``width``, their lengths); a vector of another width has no length."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    good = size == width
    if not good.all():
        vectors = vectors.filter(pa.array(good))
    out = np.zeros((len(size), width))
    out[good] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out, np.sqrt(np.einsum("ij,ij->i", out, out))


def _blocks(targets: DataFrame) -> list[DataFrame]:
    n = targets.limit(MAX_TARGETS + 1).count()
    if n <= MAX_TARGETS:
        return [targets]
    parts = -(-targets.count() // MAX_TARGETS)
    return [targets.where(F.pmod(F.xxhash64("ordinal"), F.lit(parts)) == k) for k in range(parts)]


def scan(chunks: DataFrame, targets: DataFrame, topics: tuple[str, ...] | None = None, fetch: int | None = None) -> DataFrame:
    """(notice_id, chunk_id, ordinal, distance, hits): of each embedded chunk the nearest target, of equally close ones the
    first, and hits: array<struct<ordinal, distance>>.

    hits holds all targets, or with ``fetch`` those for which the chunk can be among the ``fetch`` closest of its notice: what
    is beyond them in a batch is left out there. The distance is 1 - cosine, 1 where a vector has no length or the vectors
    are of different widths. One row a chunk comes out for each block of targets.
    """
    near = chunks.where("embedding is not null")
    if topics is not None:
        near = near.where(F.col("l_topic").isin(*topics))
    near = near.select("notice_id", "chunk_id", "embedding")
    names = {f.name: f.dataType.simpleString() for f in near.schema}
    kind = targets.schema["ordinal"].dataType.simpleString()
    schema = f"notice_id {names['notice_id']}, chunk_id {names['chunk_id']}, ordinal {kind}, distance double, hits array<struct<ordinal:{kind},distance:double>>"
    number = {"int": pa.int32(), "bigint": pa.int64()}[kind]

    def found(block: DataFrame) -> DataFrame:
        rows = block.where("embedding is not null").select("ordinal", "embedding").orderBy("ordinal").toArrow()
        vectors = rows.column("embedding").combine_chunks()
        width = len(vectors[0]) if len(vectors) else 0
        sent = chunks.sparkSession.sparkContext.broadcast((rows.column("ordinal").to_numpy(), *_matrix(vectors, width)) if width else (np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ordinals, far, far_length = sent.value
            for b in batches:
                if not (b.num_rows and len(ordinals)):
                    continue
                own, length = _matrix(b.column(2), far.shape[1])
                both = length[:, None] * far_length
                d = _rounded(np.where(both > 0, 1 - own @ far.T / np.where(both > 0, both, 1), 1.0))
                best = d.argmin(1)
                kept = np.ones(d.shape, bool)
                if fetch is not None:
                    group = b.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                    order = np.argsort(group, kind="stable")
                    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                        if len(rows) > fetch:
                            kept[rows] = d[rows] <= np.partition(d[rows], fetch - 1, axis=0)[fetch - 1]
                row, target = np.nonzero(kept)
                pairs = pa.StructArray.from_arrays([pa.array(ordinals[target], number), pa.array(d[row, target])], ["ordinal", "distance"])
                hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept.sum(1))]), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ordinals[best], number), pa.array(d[np.arange(len(d)), best]), hits], ["notice_id", "chunk_id", "ordinal", "distance", "hits"])

        return near.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(found, _blocks(targets)))


def pairs(found: DataFrame) -> DataFrame:
    """(notice_id, chunk_id, ordinal, distance) of the hits of a scan."""
    return found.select("notice_id", "chunk_id", F.explode("hits").alias("hit")).select("notice_id", "chunk_id", "hit.ordinal", "hit.distance")


def distances(chunks: DataFrame, targets: DataFrame, topics: tuple[str, ...] | None = None, fetch: int | None = None) -> DataFrame:
    """(notice_id, chunk_id, ordinal, distance) of embedded chunks and targets; ``fetch`` as in ``scan``."""
    return pairs(scan(chunks, targets, topics, fetch))


def nearest(found: DataFrame) -> DataFrame:
    """(notice_id, chunk_id, ordinal, distance): the closest target of each chunk; of equally close ones the first."""
    return found.groupBy("notice_id", "chunk_id").agg(F.min(F.struct("distance", "ordinal")).alias("best")).select("notice_id", "chunk_id", "best.ordinal", "best.distance")

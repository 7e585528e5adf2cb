"""Centroid clustering: Lloyd's rounds with a tree over the vectors and a tree over the centroids.

Vectors become points of an integer grid. Each task cuts its points into blocks and builds a cover tree over each, once: a
farthest-first order of the points, in which the net of every scale is a prefix, each point of a finer net hanging on the
nearest point of the coarser one. The blocks are written and serve all rounds. A round sends the centroids (k x width
numbers) with a cover tree over them to the tasks and walks both trees from their roots: a pair of nodes goes when the least
distance between their points exceeds what another pair guarantees, a node whose points have one centroid left is assigned
as a whole, and what is left at the leaves is compared exactly, in whole numbers. A task answers with one sum for each
centroid and component, so what is shuffled and what the driver holds is k x width.

Defined results: vectors of another width, with a null or a non-finite component, or with a component beyond 2**21 in
magnitude (its squared distances would not fit a long) are left out. Of equally near centroids the one with the smaller
number counts. A null id is the empty text in the hash that chooses the first centroids; rows that repeat an id are vectors
of their own, which the hash orders by their components. With fewer vectors than centroids there are as many centroids as vectors;
an empty table has no rows. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize

K, ROUNDS, SCALE, WIDTH = 16, 3, 64, 64
#: Points of one tree. Building it takes the square of this number of distances.
BLOCK = 1024
#: Components are below this in magnitude, so that 64 squared differences fit a long.
LARGEST = 1 << 27
#: Products below this are exact in floating point.
EXACT = 1 << 53


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered rows."""
    most = max((int(np.abs(x).max()) for x in (a, b) if x.size), default=0)
    if 4 * a.shape[1] * most * most < EXACT:
        a, b = a.astype(np.float64), b.astype(np.float64)
    else:
        a, b = a.astype(np.int64), b.astype(np.int64)
    out = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
    return out.astype(np.int64)


@dataclass
class CoverTree:
    """Level by level from the root: the nodes of a level are the first ``sizes[level]`` points of ``order``."""

    order: np.ndarray
    sizes: list[int]
    parents: list[np.ndarray]  # of each level's nodes, in the level above; the root's own is 0
    radii: list[np.ndarray]  # the farthest point below each node
    below: list[np.ndarray]  # the number of points below each node

    def pack(self) -> dict[str, bytes]:
        join = lambda parts, kind: np.concatenate(parts).astype(kind).tobytes()
        return {"sizes": join([self.sizes], "<i4"), "parents": join(self.parents, "<i4"), "radii": join(self.radii, "<f8")}

    @classmethod
    def unpack(cls, sizes: bytes, parents: bytes, radii: bytes) -> CoverTree:
        n = np.frombuffer(sizes, "<i4")
        cut = np.cumsum(n)[:-1]
        return cls(np.arange(n[-1]), n.tolist(), np.split(np.frombuffer(parents, "<i4"), cut), np.split(np.frombuffer(radii, "<f8"), cut), [])


def cover_tree(points: np.ndarray) -> CoverTree:
    """A cover tree over whole-numbered points; its scales are powers of two, and repeats hang on the first of them."""
    apart = squared(points, points)
    n = len(points)
    order, insertion = [0], [0]
    left = apart[0].copy()
    left[0] = -1
    while len(order) < n:
        i = int(left.argmax())
        insertion.append(int(left[i]))
        order.append(i)
        np.minimum(left, apart[i], out=left)
        left[i] = -1
    order = np.array(order)
    apart = apart[np.ix_(order, order)]
    far = np.array(insertion[1:])  # squared and never increasing
    sizes, scale = [1], 4 ** int(far[0]).bit_length() if n > 1 else 0
    while sizes[-1] < n:
        scale = scale // 4 if scale > 1 else -1
        size = 1 + int(np.searchsorted(-far, -scale, "left"))
        if size > sizes[-1]:
            sizes.append(size)
    parents = [np.zeros(1, np.int64)]
    for above, size in zip(sizes, sizes[1:], strict=False):
        parents.append(np.concatenate([np.arange(above), apart[above:size, :above].argmin(1)]))
    radii, below = [], []
    up = np.arange(n)
    for level in range(len(sizes) - 1, -1, -1):
        radius = np.zeros(sizes[level])
        np.maximum.at(radius, up, np.sqrt(apart[np.arange(n), up]))
        radii.append(radius)
        below.append(np.bincount(up, minlength=sizes[level]))
        up = parents[level][up]
    return CoverTree(order, sizes, parents, radii[::-1], below[::-1])


def nearest(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> np.ndarray:
    """The nearest centroid of each point, both in the order of their trees; of equally near ones the smaller number."""
    far = centroids[over.order]
    label = np.full(1, -1)
    may = np.ones((1, 1), bool)
    q = c = 0
    while True:
        rows = np.flatnonzero(label < 0)
        bottom = len(tree.sizes) - 1, len(over.sizes) - 1
        if len(rows):
            columns = np.flatnonzero(may[rows].any(0))
            apart = squared(points[rows], far[columns])
            left = may[np.ix_(rows, columns)]
            if (q, c) == bottom:
                by_number = np.argsort(over.order[columns])
                held = np.where(left, apart, np.iinfo(np.int64).max)[:, by_number]
                label[rows] = over.order[columns][by_number][held.argmin(1)]
            else:
                apart = np.sqrt(apart.astype(np.float64))
                own, theirs = tree.radii[q][rows][:, None], over.radii[c][columns]
                sure = np.where(left, apart + own, np.inf).min(1, keepdims=True)
                left &= apart - own - theirs <= sure * (1 + 1e-9) + 1e-6
                kept = np.zeros((len(rows), may.shape[1]), bool)
                kept[:, columns] = left
                may[rows] = kept
                one = (left.sum(1) == 1) & (over.below[c][columns][left.argmax(1)] == 1)
                # A node with one centroid below it is that centroid.
                label[rows[one]] = over.order[columns[left.argmax(1)[one]]]
        if (q, c) == bottom:
            return label
        widest = max((float(tree.radii[q][rows].max()) if len(rows) else 0.0), 0.0)
        if c == bottom[1] or (q < bottom[0] and widest >= float(over.radii[c].max())):
            q += 1
            label, may = label[tree.parents[q]], may[tree.parents[q]]
        else:
            c += 1
            may = may[:, over.parents[c]]


def _on_grid(vectors: pa.Array, scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their points)."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == width)
    values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    with np.errstate(over="ignore"):
        points = np.floor(values * scale)
    good = (np.isfinite(points) & (np.abs(points) < LARGEST)).all(1)  # a null is NaN here
    return rows[good], points[good].astype(np.int64)


def blocks(vectors: DataFrame, vec: str, column: str, k: int, scale: int, width: int) -> DataFrame:
    """Rows of (ids, points, tree, first): at most BLOCK points with their cover tree, and the k of them whose ids have the
    least hashes."""
    rows = vectors.select(F.col(f"`{vec}`").alias("id"), F.col(f"`{column}`").alias("embedding"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"ids array<{kind}>, points binary, sizes binary, parents binary, radii binary, first array<struct<hash:string,point:array<bigint>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, points = _on_grid(b.column("embedding"), scale, width)
            for at in range(0, len(kept), BLOCK):
                part = points[at : at + BLOCK]
                tree = cover_tree(part)
                ids = b.column("id").take(pa.array(kept[at : at + BLOCK][tree.order]))
                part = part[tree.order]
                hashes = [hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest() for i in ids.to_pylist()]
                least = sorted((h, p.tolist()) for h, p in zip(hashes, part, strict=True))[:k]
                packed = tree.pack() | {"points": part.astype("<i4").tobytes()}
                out = {
                    "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    **{c: pa.array([packed[c]], pa.binary()) for c in ("points", "sizes", "parents", "radii")},
                    "first": pa.array([[{"hash": h, "point": p} for h, p in least]], pa.list_(pa.struct([("hash", pa.string()), ("point", pa.list_(pa.int64()))]))),
                }
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return materialize(rows.mapInArrow(run, schema), "trees")


def _walk(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, width: int):
    over = cover_tree(centroids)
    for b in batches:
        for row in range(b.num_rows):
            got = {c: b.column(c)[row].as_py() for c in ("points", "sizes", "parents", "radii")}
            points = np.frombuffer(got.pop("points"), "<i4").reshape(-1, width).astype(np.int64)
            yield b, row, points, nearest(points, CoverTree.unpack(**got), centroids, over)


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of each centroid's vectors."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), object), np.zeros(k, np.int64)
        for _, _, points, label in _walk(batches, centroids, width):
            for c in np.unique(label):
                total[c] += points[label == c].sum(0)
            n += np.bincount(label, minlength=k)
        met = np.flatnonzero(n)
        own = {
            "cluster": pa.array(np.repeat(met, width), pa.int64()),
            "place": pa.array(np.tile(np.arange(width), len(met)), pa.int64()),
            "total": pa.array([str(x) for x in total[met].ravel()], pa.string()),
            "n": pa.array(np.repeat(n[met], width), pa.int64()),
        }
        yield pa.RecordBatch.from_arrays(list(own.values()), list(own))

    sums = trees.select("points", "sizes", "parents", "radii").mapInArrow(run, "cluster bigint, place bigint, total string, n bigint")
    found = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in found:
        out[r.cluster, r.place] = int(r.total) // r.n
    return out


def cluster(vectors: DataFrame, vec: str = "vec_id", column: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """((vec, cluster, distance) of every kept vector, the centroids): ``rounds`` rounds of Lloyd's from the k vectors whose
    ids have the least hashes, then a last assignment. The distance is squared, on the grid."""
    trees = blocks(vectors, vec, column, k, scale, width)
    first = trees.select(F.explode("first").alias("f")).select("f.hash", "f.point").orderBy("hash", "point").limit(k).collect()
    centroids = np.array([r.point for r in first], np.int64).reshape(-1, width)
    if len(centroids):
        for _ in range(rounds):
            centroids = _moved(trees, centroids)
    kind = trees.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, points, label in _walk(batches, centroids, width):
            distance = ((points - centroids[label]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("ids").slice(row, 1).flatten(), pa.array(label, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    placed = trees.select("ids", "points", "sizes", "parents", "radii").mapInArrow(run, f"id {kind}, cluster int, distance bigint") if len(centroids) else trees.selectExpr(f"cast(null as {kind}) as id", "0 as cluster", "0L as distance").where("false")
    return placed.withColumnRenamed("id", vec), centroids


def report(vectors: DataFrame, vec: str = "vec_id", column: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    placed, centroids = cluster(vectors, vec, column, k, rounds, scale, width)
    placed = materialize(placed.withColumnRenamed(vec, "vec_id"), "placed")
    own = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("of_cluster")).collect()
    every = sum(int(r.of_cluster) for r in own)
    digests = [(r.cluster, int(r.of_cluster), every, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in own]
    told = placed.sparkSession.createDataFrame(digests, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH) -> str:
    assign = """a{r} AS (SELECT rn, min(struct_pack(d := d, c := cluster)) AS best FROM (
      SELECT v.rn, c.cluster, list_sum(list_transform(list_zip(v.g, c.g), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r} AS c) GROUP BY rn)"""
    move = """m{r} AS (SELECT cluster, list((((s - ((s % n) + n) % n)) // n)::BIGINT ORDER BY place) AS g FROM (
      SELECT best.c AS cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT a.best, unnest(v.g) AS x, unnest(range({width})) AS place FROM a{p} AS a JOIN v USING (rn)) GROUP BY ALL) GROUP BY cluster),
    c{r} AS (SELECT c.cluster, coalesce(m.g, c.g) AS g FROM c{p} AS c LEFT JOIN m{r} AS m USING (cluster))"""
    steps = [assign.format(r=0)]
    for r in range(1, rounds + 1):
        steps += [move.format(r=r, p=r - 1, width=width), assign.format(r=r)]
    return f"""
WITH w AS (SELECT row_number() OVER () AS rn, vec_id, embedding FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS MATERIALIZED (SELECT rn, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS g FROM w),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), g) - 1 AS cluster, g FROM v ORDER BY cluster LIMIT {k}),
    {", ".join(steps)}
SELECT v.vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c.g, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN v USING (rn) JOIN c{rounds} AS c ON c.cluster = best.c"""


ORACLE = _oracle()

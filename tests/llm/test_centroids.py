"""Centroid clustering against plain loops, and odd tables."""

import hashlib
import math

import numpy as np
import pytest

from tendril.llm import centroids
from tendril.llm.queries import QUERIES


def plain(rows, k=16, rounds=3):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(64 * x) < 2**27 for x in v):
            kept.append((vec_id, [math.floor(64 * x) for x in v]))
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), g) for i, g in kept)[:k]
    at = [g for _, g in first]
    apart = lambda g, c: sum((x - y) ** 2 for x, y in zip(g, c))
    assign = lambda: [min((apart(g, c), j) for j, c in enumerate(at)) for _, g in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(at)):
            own = [g for (_, g), (_, c) in zip(kept, found) if c == j]
            if own:
                at[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign() if kept else []
    total = sum(d for d, _ in found)
    return sorted((str(i), c, d, sum(e for e, b in found if b == c), total, hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, found))


def told(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("n, spread", [(300, 1.0), (90, 0.02), (5, 1.0)])
def test_equals_plain_loops(spark, n, spread):
    draw = np.random.default_rng(n)
    rows = [(i, (draw.normal(size=64) * spread + draw.integers(0, 3)).round(2).tolist()) for i in range(n)]
    rows += [(i + n, rows[i % 7][1]) for i in range(n // 3)]  # copies, and ties between centroids
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    assert told(centroids.report(df)) == plain(rows)


def test_odd_rows(spark):
    one = [0.5] * 64
    rows = [
        (1, one), (1, one), (1, [0.25] * 64), (None, [-0.3] * 64), (2, None), (3, one[:63]), (4, one + [0.1]), (5, one[:63] + [None]),
        (6, one[:63] + [float("nan")]), (7, one[:63] + [float("inf")]), (8, one[:63] + [1e30]), (9, one[:63] + [2.0**20]), (10, []),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, distance string")
    assert told(centroids.report(df)) == plain(rows)
    assert told(centroids.report(df.where("false"))) == []
    text = spark.createDataFrame([("a", one), ("b", [0.1] * 64)], "name string, v array<float>")
    assert told(centroids.report(text, "name", "v", k=1)) == plain([("a", one), ("b", [0.1] * 64)], k=1)


def test_cover_tree():
    draw = np.random.default_rng(3)
    points = draw.integers(-40, 40, (200, 64))
    points[150:] = points[:50]
    tree = centroids.cover_tree(points)
    own = points[tree.order]
    assert sorted(tree.order.tolist()) == list(range(200)) and tree.sizes[0] == 1 and tree.sizes[-1] == 200
    for level in range(1, len(tree.sizes)):
        up = tree.parents[level]
        apart = np.sqrt(((own[: tree.sizes[level]] - own[up]) ** 2).sum(1))
        assert (apart <= tree.radii[level - 1][up] + 1e-9).all() and (up[: tree.sizes[level - 1]] == np.arange(tree.sizes[level - 1])).all()
        net = own[: tree.sizes[level - 1]]
        assert len(net) == 1 or centroids.squared(net, net)[~np.eye(len(net), dtype=bool)].min() > apart.max() ** 2 / 4 - 1e-6
    again = centroids.CoverTree.unpack(**tree.pack())
    assert again.sizes == tree.sizes and all((a == b).all() for a, b in zip(again.radii, tree.radii))


def test_pruning_keeps_the_nearest():
    draw = np.random.default_rng(4)
    middle = draw.integers(-3000, 3000, (12, 64))
    points = (middle[draw.integers(0, 12, 500)] + draw.integers(-20, 20, (500, 64))).astype(np.int64)
    far = np.concatenate([middle, middle[:2]])
    tree, over = centroids.cover_tree(points), centroids.cover_tree(far)
    found = centroids.nearest(points[tree.order], tree, far, over)
    assert (found == centroids.squared(points[tree.order], far).argmin(1)).all()


def test_query(spark):
    got = QUERIES["op11_centroids"](spark, "/root/testdata/sf0.001")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert told(got) == plain(rows)

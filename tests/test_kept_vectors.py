"""Kept lists of vectors against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendril.operators import dense, lexical
from tendril.operators.kept_vectors import KeptVectors
from tendril.plans import registry
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"


def frame(spark, n, seed=1, spread=0.05):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(30, 8))
    rows = []
    for i in range(n):
        v = (middle[draw.integers(30)] + spread * draw.normal(size=8)).tolist()
        rows.append((i, [None, "n1", "n2"][i % 3 if i % 7 else 1], ["a", "b", None][i % 3], v))
    rows += [(n, "n1", "a", None), (n + 1, "n1", "a", [0.0] * 8), (n + 2, "n2", "a", [1.0, 2.0]), (n + 3, "n1", "a", rows[0][3]), (n + 4, "n3", "a", rows[1][3])]
    return spark.createDataFrame(rows, "chunk_id long, notice_id string, l_topic string, embedding array<double>").repartition(3)


def goals(spark, chunks, *more):
    near = [(k, r.embedding) for k, r in enumerate(chunks.where("chunk_id in (4, 17, 40)").orderBy("chunk_id").collect())]
    return spark.createDataFrame([*near, *more], "ordinal int, embedding array<double>")


def told(df):
    return sorted((str(r.notice_id), r.ordinal, r.rank, r.chunk_id, round(r.distance, 6)) for r in df.collect())


def plain(chunks, targets, limit, topics=None):
    return told(lexical.top(dense.distances(chunks, targets, topics), limit, ["notice_id", "ordinal"], "distance", largest=False))


@pytest.mark.parametrize("limit, topics", [(3, None), (5, ("a", "b")), (500, None)])
def test_equals_comparing_all(spark, tmp_path, limit, topics):
    chunks = frame(spark, 900)
    targets = goals(spark, chunks, (7, [0.0] * 8), (8, [-1.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 1.0]), (9, None))
    index = KeptVectors(spark, f"{tmp_path}/v")
    index.create(chunks)
    for k in range(2):
        index.append(chunks.where(F.col("chunk_id") % 2 == k))
    found, _ = index.best(targets, limit, topics)
    assert told(found) == plain(chunks, targets, limit, topics)


def test_skips_lists(spark, tmp_path):
    chunks = frame(spark, 3000, seed=2)
    targets = goals(spark, chunks)
    index = KeptVectors(spark, f"{tmp_path}/v")
    index.create(chunks)
    index.append(chunks)
    found, read = index.best(targets, 5)
    assert told(found) == plain(chunks, targets, 5)
    counts = read.first()
    assert counts.n_read < 0.35 * counts.n_lists


def test_uncommitted_and_empty(spark, tmp_path):
    chunks = frame(spark, 60)
    index = KeptVectors(spark, f"{tmp_path}/v")
    index.create(chunks)
    index.append(chunks)
    for name in ("vectors", "lists"):
        spark.read.parquet(f"{tmp_path}/v/{name}").withColumn("generation", F.lit("lost")).write.mode("append").partitionBy(*(["generation", "list"] if name == "vectors" else [])).parquet(f"{tmp_path}/v/{name}")
    assert told(index.best(goals(spark, chunks), 4)[0]) == plain(chunks, goals(spark, chunks), 4)
    none = KeptVectors(spark, f"{tmp_path}/none")
    none.create(chunks.where("false"))
    none.append(chunks.where("chunk_id < 5"))
    assert told(none.best(goals(spark, chunks), 4)[0]) == plain(chunks.where("chunk_id < 5"), goals(spark, chunks), 4)


def test_query(spark):
    same(duck(SF), registry.QUERIES["kept_dense_topk_multi"](spark, SF), registry.ORACLE_SQL["kept_dense_topk_multi"])

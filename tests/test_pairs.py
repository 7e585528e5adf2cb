"""Results made of pairs, as their tasks hold them."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tendril.operators import relational, tools
from tendril.operators.tools import tool_rows
from tendril.plans import registry
from tests.compare import duck, same


def test_partners_lie_together(spark):
    """A task's pairs are of one or two nations, so that what is written repeats few partners."""
    found = registry.QUERIES["partners_of_search"](spark, "/root/testdata/sf0.01")
    sizes = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.countDistinct("partner_id").alias("n")).collect()]
    assert max(sizes) <= 20  # of 100


def test_the_tool_is_called_for_companies(spark, monkeypatch):
    """Not for each of their searches."""
    asked = []
    monkeypatch.setattr(tools, "tool_rows", lambda searches, partners, **more: asked.append(searches.count()) or tool_rows(searches, partners, **more))
    assert registry.QUERIES["partners_tool"](spark, "/root/testdata/sf0.01").count() > 0
    assert asked[0] <= 25


@pytest.fixture
def nation(spark, tmp_path):
    """One nation with 600 searches and 5,000 partners."""
    d = str(tmp_path)
    spark.range(600).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("P").alias("o_orderstatus")).write.parquet(f"{d}/orders.parquet")
    spark.range(600).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey")).write.parquet(f"{d}/customer.parquet")
    spark.range(5_000).select(F.col("id").alias("s_suppkey"), F.format_string("Supplier#%09d", "id").alias("s_name"), F.lit(3).alias("s_nationkey")).write.parquet(f"{d}/supplier.parquet")
    return d


def test_a_nation_of_many_partners_is_written_small(spark, nation, tmp_path):
    """What a pair takes on disk doesn't grow with the partners of its nation."""
    registry.QUERIES["partners_of_search"](spark, nation).coalesce(1).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 600 * 5_000
    assert sum(map(os.path.getsize, glob.glob(str(tmp_path / "out" / "*.parquet")))) < 0.5 * 600 * 5_000


def test_a_nation_is_many_tasks(spark, nation):
    """Also where Spark itself wouldn't broadcast the partners."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in registry.QUERIES["partners_of_search"](spark, nation).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert sum(sizes) == 600 * 5_000 and max(sizes) <= 600 * 5_000 / 4


@pytest.mark.parametrize("sent", [100, 2])  # rows that are broadcast: all, or none
def test_pairs_of_odd_rows(spark, monkeypatch, sent):
    """Nulls, repeated rows and keys of one side; tiles and blocks that are not full."""
    monkeypatch.setattr(relational, "MAX_SENT", sent)
    monkeypatch.setattr(relational, "TILE", 3)
    monkeypatch.setattr(relational, "BLOCK", 2)
    many = spark.createDataFrame([(k % 3, k) for k in range(40)] + [(1, None), (1, 7), (1, 7), (None, 5), (9, 6)], "k int, a long")
    few = spark.createDataFrame([(k % 2, k, f"n{k}") for k in range(15)] + [(1, None, None), (1, 3, "n3"), (None, 8, "x"), (7, 1, "y")], "k int, b long, c string")
    got, want = relational.pairs(many, few, "k"), many.join(few, "k").drop("k")
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert relational.pairs(many, few.limit(0), "k").count() == relational.pairs(many.limit(0), few, "k").count() == 0


def test_partners_as_in_sql(spark):
    d = "/root/testdata/sf0.01"
    same(duck(d), registry.QUERIES["partners_of_search"](spark, d), registry.ORACLE_SQL["partners_of_search"])

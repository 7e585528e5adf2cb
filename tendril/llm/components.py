"""Connected components by alternating large-star and small-star steps, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang the larger (or the smaller, and the node itself) neighbours of each node on the least of all of them."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = near.join(least, "a")
    if larger:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes that are not the least of their component; component: the least node.

    Each round is written to the shared folder, which bounds the lineage. An edge from a node to itself, or with a null end, joins nothing.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNotNull() & F.col(b).isNotNull()).toDF("a", "b", "both").where("both and a != b").select("a", "b").distinct()
    now = materialize(now, "edges")
    state = _state(now)
    while state[0]:
        now = materialize(_stars(_stars(now, True), False), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))

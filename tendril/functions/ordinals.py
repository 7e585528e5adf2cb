"""Places in a total order, without gathering a table or a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


def numbered(df: DataFrame, order: list[str | Column], name: str, by: str | None = None) -> DataFrame:
    """``df`` with its rows' places from 1, as a long, in a total order; with ``by`` the places inside each group.

    Rows are dealt by ranges of the order; a place is that inside the range plus the sizes of the ranges before, so a
    large group is shared by many tasks. Only these sizes, one for each range and group, meet in one task.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    group = [] if by is None else [by]
    dealt = materialize(df.repartitionByRange(*group, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range", *group).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_range").alias("_r"), *[F.col(c).alias("_g") for c in group], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    rows = dealt.join(before, same & F.col(by).eqNullSafe(F.col("_g")) if by else same)
    place = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*keys)) + F.col("_before")
    return rows.withColumn(name, place.cast("long")).select(*df.columns, name)

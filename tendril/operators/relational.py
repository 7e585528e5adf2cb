"""Filters, lookups, and changes of tables as new tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of an ``IN`` list that go into the plan; longer lists are joined.
MAX_LISTED = 1_000
#: Characters of a search's message.
MESSAGE = 2_000
#: Of ``pairs``: rows of a tile and of a block, parts that the rows of one key are dealt to, rows that are broadcast at most.
TILE, BLOCK, SALTS, MAX_SENT = 256, 64, 16, 1_000_000
#: Tasks of ``pairs``, and pairs of a task from which there are more of them.
PARTS, MAX_PAIRS = 100, 50_000_000


@dataclass(frozen=True)
class HardFilter:
    """Conditions that all hold; one that is None isn't there. ``joint``: the method is given, or it is not."""

    domain_code: str | None = None
    joint: bool | None = None
    budget_min: int | None = None
    budget_max: int | None = None
    deadline: datetime | None = None

    def __post_init__(self) -> None:
        if any(x is not None and x < 0 for x in (self.budget_min, self.budget_max)):
            raise ValueError("a budget is negative")
        if self.budget_min is not None and self.budget_max is not None and self.budget_min > self.budget_max:
            raise ValueError("budget_min is above budget_max")

    def conditions(self) -> list[Column]:
        method = F.col("joint_venture_method")
        told = [
            (self.domain_code, lambda x: F.col("domain_code") == x),
            (self.joint, lambda x: method.isNotNull() if x else method.isNull()),
            (self.budget_min, lambda x: F.col("budget_krw") >= x),
            (self.budget_max, lambda x: F.col("budget_krw") <= x),
            (self.deadline, lambda x: F.col("bid_deadline") <= F.lit(x)),
        ]
        return [make(x) for x, make in told if x is not None]


@dataclass(frozen=True)
class SearchRequest:
    """A search: conditions, whose domain code must be one of ``codes``, and a message of at most ``MESSAGE`` characters."""

    filters: HardFilter = HardFilter()
    message: str | None = None
    codes: frozenset[str] | None = None

    def __post_init__(self) -> None:
        if self.codes is not None and self.filters.domain_code is not None and self.filters.domain_code not in self.codes:
            raise ValueError(f"domain_code: {self.filters.domain_code!r}")
        if self.message is not None and len(self.message) > MESSAGE:
            raise ValueError(f"the message has more than {MESSAGE} characters")


def hard_filter(notices: DataFrame, conditions: HardFilter) -> DataFrame:
    return reduce(lambda df, c: df.where(c), conditions.conditions(), notices)


def by_keys(rows: DataFrame, key: str, keys: list) -> DataFrame:
    """Rows whose key is in a list; long lists are a semi join."""
    if len(keys) <= MAX_LISTED:
        return rows.where(F.col(key).isin(keys))
    listed = rows.sparkSession.createDataFrame([(k,) for k in keys], rows.select(key).schema)
    return rows.join(listed, key, "left_semi")


def insert_new(stored: DataFrame, came: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to append: those whose key isn't stored, the first of each key in the order of all columns."""
    new = came.join(stored, keys, "left_anti")
    order = Window.partitionBy(*keys).orderBy(*[c for c in came.columns if c not in keys])
    return new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, came: DataFrame, keys: list[str]) -> DataFrame:
    """Stored and new rows by key; a value that came replaces the stored one unless it is null."""
    others = [c for c in stored.columns if c not in keys]
    both = stored.alias("s").join(came.alias("n"), keys, "full")
    take = lambda c: F.coalesce(f"n.{c}", f"s.{c}") if c in came.columns else F.col(f"s.{c}")
    return both.select(*keys, *[take(c).alias(c) for c in others])


def delete_by(rows: DataFrame, parents: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """What stays after the rows of the given parents are deleted; keys: own column to parent's."""
    gone = parents.select(*[F.col(p).alias(o) for o, p in keys.items()]).distinct()
    return rows.join(gone, list(keys), "left_anti")


def blocked(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents that may not be deleted, because they still have children."""
    return parents.join(children.select(key).distinct(), key, "left_semi")


def first_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 20) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset at least 0")
    return rows.orderBy(*order).offset(offset).limit(limit)


def key_conflicts(stored: DataFrame, came: DataFrame, key: str) -> DataFrame:
    """Keys that are stored already or come more than once."""
    twice = came.groupBy(key).count().where("count > 1").select(key)
    return came.join(stored, key, "left_semi").select(key).unionByName(twice).distinct()


def patch(rows: DataFrame, changes: DataFrame, key: str, sent: list[str], vector: str) -> DataFrame:
    """Set the columns that were sent, null included; where that changes a value, the vector is void."""
    both = rows.alias("r").join(changes.select(key, *sent, F.lit(True).alias("_sent")).alias("c"), key, "left")
    hit = F.col("_sent").isNotNull()
    differs = reduce(lambda a, b: a | b, [~F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in sent])
    out = []
    for c in rows.columns:
        if c == key:
            out.append(F.col(key))
        elif c == vector:
            out.append(F.when(~(hit & differs), F.col(f"r.{c}")).alias(c))
        elif c in sent:
            out.append(F.when(hit, F.col(f"c.{c}")).otherwise(F.col(f"r.{c}")).alias(c))
        else:
            out.append(F.col(f"r.{c}").alias(c))
    return both.select(*out)


def at_places(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Zip two tables by their explicit ordinals; a place that one side lacks is an error of the caller's."""
    return left.join(right, by, "inner")


def _in_arrays(rows: DataFrame, key: str, name: str, size: int, salts: int) -> DataFrame:
    """(key, _salt, _place, name): the rows' other columns as arrays of at most ``size`` structs, each of one key."""
    columns = [c for c in rows.columns if c != key]
    order = Window.partitionBy(key, "_salt").orderBy(*columns)
    salted = rows.where(F.col(key).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))
    placed = salted.withColumn("_place", F.floor((F.row_number().over(order) - 1) / size))
    return placed.groupBy(key, "_salt", "_place").agg(F.collect_list(F.struct(*columns)).alias(name))


def pairs(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The inner join by ``key``, without it, where the pairs are far more than the rows of both tables.

    A tile of rows of ``many`` meets a key's rows of ``few`` one after the other. So the columns of ``few`` stay the same over
    a tile, and those of ``many`` soon come again, which Parquet tells in a few bytes; row by row of ``many``, what comes
    again lies all rows of ``few`` apart. A task holds a tile with the blocks of its key. ``few`` is broadcast, and a task makes
    up to about ``MAX_PAIRS`` pairs; above ``MAX_SENT`` rows it is joined by shuffle, a key in ``SALTS`` parts.
    """
    most, n_few = few.where(F.col(key).isNotNull()).groupBy(key).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    sent = n_few <= MAX_SENT
    tiles = _in_arrays(many, key, "_many", TILE, SALTS)
    blocks = _in_arrays(few, key, "_few", BLOCK, 1 if sent else SALTS).drop("_salt", "_place")
    if sent:
        parts = max(PARTS, -(-many.count() * most // MAX_PAIRS))
        both = tiles.repartitionByRange(parts, key, "_salt", "_place").join(F.broadcast(blocks), key)
    else:
        both = tiles.join(blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"])
    # A function over the block keeps this step apart from the join in Spark's code, which otherwise gathers all pairs of a tile before it hands any on.
    rows = both.select("_many", F.explode(F.transform("_few", lambda r: r)).alias("_one"))
    return rows.select(F.inline("_many"), "_one.*")


def concat_branches(branches: list[DataFrame], key: str, order: str = "pos", item: str = "item") -> DataFrame:
    """(key, items): what parallel branches (key, pos, item) found for each key, branch after branch in the order given."""
    rows = reduce(DataFrame.unionByName, [b.withColumn("_branch", F.lit(k)) for k, b in enumerate(branches)])
    found = F.array_sort(F.collect_list(F.struct("_branch", order, item)))
    return rows.groupBy(key).agg(F.transform(found, lambda x: x[item]).alias("items"))

"""Tools of an assistant as table functions, to be called from SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

PARTNERS, SEARCHES, MOST, SALTS = 0, 1, 100, 16


class ListPartners:
    """``list_partners(TABLE(rows), most, 'field,field')``: for each search the first ``most`` partners of its company, by id,
    with the fields asked for, whose types are those of the rows.

    rows: (company_id, salt, kind, search_id, partner_id, fields ...), a company's partners ahead of its searches and once
    for each salt, as ``tool_rows`` makes them. What is held is the partners of one company, ``most`` of them.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        if not isinstance(most.value, int) or most.value < 0:
            raise ValueError("the second argument is a number of partners")
        if not isinstance(fields.value, str):
            raise ValueError("the third argument names fields")
        own = {f.name: f for f in rows.dataType.fields}
        names = [x.strip() for x in fields.value.split(",") if x.strip()]
        if missing := [x for x in ("company_id", "salt", "kind", "search_id", "partner_id", *names) if x not in own]:
            raise ValueError(f"the table has no {', '.join(missing)}")
        schema = StructType([own["search_id"], own["partner_id"], *(StructField(x, own[x].dataType) for x in names)])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("company_id"), PartitioningColumn("salt")], orderBy=[OrderingColumn("kind"), OrderingColumn("partner_id")])

    def __init__(self):
        self.partners: list[tuple] = []

    def eval(self, row: Row, most: int, fields: str) -> Iterator[tuple]:
        if row["kind"] == PARTNERS:
            if len(self.partners) < most:
                self.partners.append((row["partner_id"], *(row[x.strip()] for x in fields.split(",") if x.strip())))
        else:
            for partner in self.partners:
                yield row["search_id"], *partner


def register(spark: SparkSession) -> None:
    """Make the tools known to SQL."""
    spark.udtf.register("list_partners", F.udtf(ListPartners))


def tool_rows(searches: DataFrame, partners: DataFrame, salts: int = SALTS) -> DataFrame:
    """Searches (search_id, company_id) and partners (company_id, partner_id, ...) as rows of ``list_partners``. A company's
    searches are parted by a salt, so that a company with many is many groups; its partners are repeated for each. Searches
    and partners without a company meet nothing."""
    salt = F.pmod(F.xxhash64("search_id"), F.lit(salts)).cast("int")
    asked = searches.where("company_id is not null").select("company_id", salt.alias("salt"), F.lit(SEARCHES).alias("kind"), "search_id")
    told = partners.where("company_id is not null").select("*", F.lit(PARTNERS).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return asked.unionByName(told, allowMissingColumns=True)

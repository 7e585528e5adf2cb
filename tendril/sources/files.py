"""Label files, cases, results and templates as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A case as stored, one JSON object a line.
CASE = "case_id string, company_id long, bid_notice_ids array<long>, message string, notice_relevance map<string,int>, chunk_relevance map<string,map<string,int>>, target_snapshot array<struct<source:string,id:long,text:string,embedding_sha256:string>>"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of labels: header, byte order mark, quoted cells with line feeds and doubled quotes; all columns are text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_labels(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases; a line that isn't one is an error."""
    return spark.read.schema(CASE).option("mode", "FAILFAST").json(path)


def notice_labels(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.explode("notice_relevance").alias("notice_id", "grade")).withColumn("notice_id", F.col("notice_id").cast("long"))


def chunk_labels(cases: DataFrame) -> DataFrame:
    rows = cases.select("case_id", F.explode("chunk_relevance").alias("notice_id", "labels"))
    rows = rows.select("case_id", F.col("notice_id").cast("long").alias("notice_id"), F.explode("labels").alias("chunk_id", "grade"))
    return rows.withColumn("chunk_id", F.col("chunk_id").cast("long"))


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as CSV needs them."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return rows.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema.fields])


def write_results(rows: DataFrame, path: str, stamp: str) -> None:
    """Results as JSON and as CSV, in folders named by a time stamp."""
    rows.write.mode("overwrite").json(f"{path}/{stamp}.json")
    flat(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{stamp}.csv")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, content) of whole text files."""
    found = spark.read.text(path, wholetext=True)
    return found.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.col("value").alias("content"))


def missing_templates(templates: DataFrame, stored: DataFrame) -> DataFrame:
    return templates.join(stored, "source_file", "left_anti")


def fill(template: str, values: dict[str, str]) -> str:
    """A text template with ``{{NAME}}`` replaced."""
    for name, value in values.items():
        template = template.replace("{{" + name + "}}", value)
    return template


def sse(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, event): server-sent events of rows, one each, of the columns that are no keys; nulls are told."""
    told = [c for c in rows.columns if c not in (keys or [])]
    return rows.select(*(keys or []), F.concat(F.lit("data: "), F.to_json(F.struct(*told), {"ignoreNullFields": "false"}), F.lit("\n\n")).alias("event"))


def label_context(cases: DataFrame, methods: list[str], pool_k: int, scope: str = "pooled_candidates") -> DataFrame:
    """(case_id, context): what a label file was made from, as JSON with nulls told.

    cases: (case_id, company_id, bid_notice_ids, message) and any further columns, which come last.
    """
    first = ["case_id", "company_id", "bid_notice_ids", "message"]
    rest = [F.col(f"`{c}`") for c in cases.columns if c not in first]
    ids = F.coalesce("bid_notice_ids", F.array().cast(cases.schema["bid_notice_ids"].dataType)).alias("bid_notice_ids")
    told = F.struct("case_id", "company_id", ids, "message", F.array(*map(F.lit, methods)).alias("methods"), F.lit(pool_k).alias("pool_k"), F.lit(scope).alias("label_scope"), *rest)
    return cases.select("case_id", F.to_json(told, {"ignoreNullFields": "false"}).alias("context"))

"""The domain's stored tables: their columns, a bootstrap that creates or widens them, and appends that give ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordinals import numbered

_JSON = "array<map<string,string>>"
# The stored tables' columns.
TABLES = {
    "companies": "id long, email string, name string, contact_name string, created_at timestamp",
    "partners": "id long, company_id long, name string, email string, domain string, tech_stack string, created_at timestamp",
    "company_profiles": "id long, company_id long, company_scale string, target_techs string, offered_solutions string, strengths_diff string, credit_rating string, sp_grade string, embedding array<float>, updated_at timestamp",
    "company_projects": "id long, company_id long, title string, client string, domain string, tech_stack string, develop_features string, content string, performance string, embedding array<float>, created_at timestamp",
    "bid_notices": "id long, notice_no string, title string, demand_org string, budget_krw long, bid_deadline timestamp_ntz, rfp_file_url string, parse_status string, raw_md_text string, procurement_clsfc_no string, procurement_clsfc_nm string, joint_venture_method string, created_at timestamp",
    "chunks": "id long, bid_notice_id long, chunk_index int, content string, chunk_metadata map<string,string>, token_count int, embedding array<float>, created_at timestamp",
    "search_sets": "id long, company_id long, title string, status string, failure_reason string, progress_current int, progress_total int, created_at timestamp",
    "hard_filters": "id long, search_set_id long, domain_code string, joint_venture boolean, budget_min_krw long, budget_max_krw long, deadline timestamp, created_at timestamp",
    "analysis_results": f"id long, search_set_id long, bid_notice_id long, is_hard_passed boolean, soft_score int, chunk_judgments {_JSON}, recommend_reason {_JSON}, weaknesses {_JSON}, summary string, created_at timestamp",
    "chat_messages": "id long, search_set_id long, role string, content string, created_at timestamp",
    "eval_criteria_references": "id long, source_file string, content string, embedding array<float>, created_at timestamp",
}


def bootstrap(spark: SparkSession, folder: str, tables: dict[str, str] | None = None) -> list[str]:
    """Create the tables that aren't there, empty, and tell their names. A table that is there stays; columns that it lacks
    are read as nulls by ``load``."""
    made = []
    for name, columns in (tables or TABLES).items():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            spark.createDataFrame([], columns).write.parquet(f"{folder}/{name}")
            made.append(name)
    return made


def load(spark: SparkSession, folder: str, name: str, tables: dict[str, str] | None = None) -> DataFrame:
    return spark.read.schema((tables or TABLES)[name]).parquet(f"{folder}/{name}")


def with_ids(stored: DataFrame, came: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """``came`` with the ids that follow the greatest stored one, in an order, first of all columns."""
    last = stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    rows = numbered(came, order, "_place").join(F.broadcast(last))
    return rows.select((F.col("_last") + F.col("_place")).alias(key), *came.columns)


def append(spark: SparkSession, folder: str, name: str, came: DataFrame, order: list[str], tables: dict[str, str] | None = None) -> DataFrame:
    """Append rows to a stored table and return them with their ids; columns that they lack are null."""
    columns = tables or TABLES
    rows = with_ids(load(spark, folder, name, columns), came, order)
    schema = spark.createDataFrame([], columns[name]).schema
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    full.write.mode("append").parquet(f"{folder}/{name}")
    return rows

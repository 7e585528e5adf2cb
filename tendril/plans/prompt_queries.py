"""Prompts, contexts, mail drafts, and what is checked before them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import prompts as P
from ..sources import feed, files
from .domain import table
from .registry import query

_PROFILE = ("c_mktsegment", "c_acctbal")
_PROJECT = ("title", "status")


def _quoted(text: str) -> str:
    """A string in SQL, with its line feeds."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _profiles(spark, sf_dir):
    """Two customers of three have a profile."""
    return table(spark, sf_dir, "customer").where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("company_id"), (F.col("c_custkey") * 10).alias("profile_id"), "c_mktsegment", F.floor("c_acctbal").alias("c_acctbal"))


def _projects(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("project_id"), F.col("o_orderpriority").alias("title"), F.nullif("o_orderstatus", F.lit("P")).alias("status"))


_FIRST = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"


@query("fit_prompt", f"""WITH ranked AS (SELECT l_orderkey AS notice_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank, l_discount AS score, CASE l_suppkey % 2 WHEN 0 THEN 'profile' ELSE 'project' END AS src, l_suppkey FROM lineitem), texts AS (SELECT notice_id, string_agg('- chunk_id=' || l_partkey || ' (rank=' || rank || ', score=' || printf('%.4f', score::DOUBLE) || ', {P.MATCHED}=' || src || '#' || l_suppkey || ')' || chr(10) || '  ' || p_name, chr(10) ORDER BY rank, l_partkey) AS lines FROM ranked JOIN part ON p_partkey = l_partkey WHERE p_size % 4 <> 0 AND p_name <> '' GROUP BY 1), listed AS (SELECT o_custkey, string_agg('project#' || o_orderkey || ': title=' || o_orderpriority || ', status=' || coalesce(nullif(o_orderstatus, 'P'), 'None'), chr(10) ORDER BY o_orderkey) AS lines, count(*) AS n_projects FROM {_FIRST} WHERE n <= 100 GROUP BY 1) SELECT notice_id, o.o_custkey AS company_id, {_quoted(P.NOTICE + " bid_notice_id=")} || notice_id || {_quoted(chr(10) + P.CHUNKS + chr(10))} || t.lines || {_quoted(chr(10) * 2 + P.PROFILE + chr(10))} || CASE WHEN o.o_custkey % 3 <> 0 AND c_custkey IS NOT NULL THEN 'profile#' || c_custkey * 10 || ': c_mktsegment=' || c_mktsegment || ', c_acctbal=' || floor(c_acctbal)::BIGINT ELSE {_quoted(P.NO_PROFILE)} END || {_quoted(chr(10) * 2 + P.PROJECTS + chr(10))} || coalesce(l.lines, {_quoted(P.NO_PROJECTS)}) AS prompt, CASE WHEN o.o_custkey % 3 <> 0 THEN c_custkey * 10 END AS profile_id, coalesce(n_projects, 0) AS n_projects FROM texts t JOIN orders o ON o.o_orderkey = notice_id LEFT JOIN customer ON c_custkey = o.o_custkey LEFT JOIN listed l ON l.o_custkey = o.o_custkey""")
def fit_prompt(spark, sf_dir):
    """Orders are the notices and their customers the companies; a notice's chunks are the parts of its lines."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_partkey").alias("chunk_id"), F.row_number().over(order).alias("rank"), F.col("l_discount").alias("score"), F.when(F.col("l_suppkey") % 2 == 0, "profile").otherwise("project").alias("matched_source"), F.col("l_suppkey").alias("matched_id"))
    ranked = ranked.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("notice_id"), F.col("o_custkey").alias("company_id")), "notice_id")
    chunks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.when(F.col("p_size") % 4 != 0, F.col("p_name")).alias("content"))
    found = P.fit_prompt(ranked, chunks, _profiles(spark, sf_dir), _projects(spark, sf_dir), _PROFILE, _PROJECT)
    return found.withColumn("n_projects", F.size("project_ids").cast("long")).drop("project_ids")


@query("company_context", f"SELECT c_custkey AS company_id, CASE WHEN c_custkey % 3 <> 0 THEN concat_ws(chr(10), 'segment: ' || c_mktsegment, 'balance: ' || floor(c_acctbal)::BIGINT) ELSE {_quoted(P.NO_PROFILE)} END || chr(10) || chr(10) || coalesce(lines, {_quoted(P.NO_RECORD)}) AS context FROM customer LEFT JOIN (SELECT o_custkey, string_agg(concat_ws(chr(10), 'title: ' || o_orderpriority, 'status: ' || nullif(o_orderstatus, 'P')), chr(10) ORDER BY o_orderkey) AS lines FROM {_FIRST} WHERE n <= 20 GROUP BY 1) ON o_custkey = c_custkey")
def company_context(spark, sf_dir):
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"))
    return P.company_context(companies, _profiles(spark, sf_dir), _projects(spark, sf_dir), [("segment", "c_mktsegment"), ("balance", "c_acctbal")], [("title", "title"), ("status", "status")])


@query("company_ready", "SELECT c_custkey AS company_id, CASE WHEN c_custkey % 3 = 0 THEN 'no profile' WHEN n IS NULL THEN 'no project' WHEN c_mktsegment = 'BUILDING' THEN 'blank profile' WHEN told = 0 THEN 'blank projects' END AS error FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS told FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def company_ready(spark, sf_dir):
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"))
    profile = F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment"))
    return P.company_ready(companies, _profiles(spark, sf_dir), _projects(spark, sf_dir), profile, F.when(F.col("status") == "F", F.col("title")).otherwise(""))


_MAIL = "replace(replace(replace(replace(replace({}, '{{partner_name}}', s_name), '{{company_name}}', c_name), '{{contact_name}}', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE {} END), '{{project_title}}', p_name), '{{help_needed}}', l_returnflag)".format


@query("mail_draft", f"SELECT request_id, CASE WHEN error IS NULL THEN 'mail@' || s_suppkey END AS \"to\", CASE WHEN error IS NULL THEN {_MAIL(_quoted(P.SUBJECT), _quoted(P.CONTACT))} END AS subject, CASE WHEN error IS NULL THEN {_MAIL(_quoted(P.BODY), _quoted(P.CONTACT))} END AS body, error FROM (SELECT l_orderkey * 10 + l_linenumber AS request_id, *, CASE WHEN c_custkey IS NULL THEN 'no company' WHEN s_suppkey IS NULL OR s_suppkey % 7 = 0 THEN 'no partner' WHEN s_acctbal <= 0 THEN 'no address' WHEN p_partkey IS NULL OR p_size % 5 = 0 THEN 'no notice' END AS error FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey)")
def mail_draft(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("company_id"))
    requests = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), "company_id", F.col("l_suppkey").alias("partner_id"), F.col("l_partkey").alias("notice_id"), F.col("l_returnflag").alias("help_needed"))
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("contact_name"))
    partners = table(spark, sf_dir, "supplier").where("s_suppkey % 7 != 0").select(F.col("s_suppkey").alias("partner_id"), F.col("s_name").alias("partner_name"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("mail@"), "s_suppkey")).otherwise("").alias("email"))
    notices = table(spark, sf_dir, "part").where("p_size % 5 != 0").select(F.col("p_partkey").alias("notice_id"), F.col("p_name").alias("title"))
    return P.mail_draft(requests, companies, partners, notices)


_PAGES = "SELECT o_custkey AS feed, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS page, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 5 END AS n_items, CASE WHEN o_orderkey % 17 = 0 THEN 'failed' END AS error, 22::BIGINT AS total FROM orders"


@query("feed_stop", f"WITH pages AS ({_PAGES}), seen AS (SELECT *, coalesce(max(CASE WHEN error IS NOT NULL OR n_items = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY page), 0) AS ended, coalesce(sum(n_items) OVER (PARTITION BY feed ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pages) SELECT feed, page, n_items FROM seen WHERE ended = 0 AND (before < total OR page = 1)")
def feed_stop(spark, sf_dir):
    """Each customer's orders as the pages of a feed, some of them empty or failed."""
    i = F.col("o_orderkey")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feed"), page.alias("page"), F.when(i % 13 == 0, 0).otherwise(5).alias("n_items"), F.when(i % 17 == 0, "failed").alias("error"), F.lit(22).cast("long").alias("total"))
    return feed.until_end(pages, "feed").select("feed", "page", "n_items")


@query("store_parsed", "SELECT doc_id, text AS markdown, 'PENDING' AS parse_status FROM documents WHERE lang <> 'fr' AND text <> ''")
def store_parsed(spark, sf_dir):
    parsed = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "fr", "failed").otherwise("ok").alias("status"), F.col("text").alias("markdown"))
    return feed.storable(parsed)


@query("label_context", "SELECT c_custkey AS case_id, to_json(struct_pack(case_id := c_custkey, company_id := c_nationkey, bid_notice_ids := coalesce(ids, []), message := CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, methods := ['dense', 'bm25', 'rrf'], pool_k := 20, label_scope := 'pooled_candidates')) AS context FROM customer LEFT JOIN (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def label_context(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("bid_notice_ids"))
    cases = table(spark, sf_dir, "customer").join(ids, "c_custkey", "left").select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("company_id"), "bid_notice_ids", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("message"))
    return files.label_context(cases, ["dense", "bm25", "rrf"], 20)

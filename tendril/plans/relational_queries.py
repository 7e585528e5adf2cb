"""Filters, lookups, joins, changes of tables, pages and feeds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import tools
from ..sources import feed, files, tables
from ..streaming import feeds, watch
from . import domain
from .domain import table, with_
from .registry import query

_NOTICE = "notice_id, company_id, domain_code, joint_venture_method, budget_krw, bid_deadline"


def _hard(name: str, conditions: R.HardFilter, where: str) -> None:
    @query(name, with_("notices") + f"SELECT {_NOTICE} FROM notices WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.hard_filter(domain.notices(spark, sf_dir), conditions)


_DAY = datetime(1997, 1, 1)
_hard("hard_filter", R.HardFilter("1-URGENT", True, 50_000, 200_000, _DAY), "domain_code = '1-URGENT' AND joint_venture_method IS NOT NULL AND budget_krw BETWEEN 50000 AND 200000 AND bid_deadline <= TIMESTAMP '1997-01-01'")
_hard("hard_filter_all", R.HardFilter(), "true")
_hard("hard_filter_code", R.HardFilter("5-LOW"), "domain_code = '5-LOW'")
_hard("hard_filter_joint", R.HardFilter(joint=True), "joint_venture_method IS NOT NULL")
_hard("hard_filter_not_joint", R.HardFilter(joint=False), "joint_venture_method IS NULL")
_hard("hard_filter_budget", R.HardFilter(budget_min=100_000, budget_max=150_000), "budget_krw BETWEEN 100000 AND 150000")
_hard("hard_filter_deadline", R.HardFilter(deadline=_DAY), "bid_deadline <= TIMESTAMP '1997-01-01'")


@query("scan_point_lookup", with_("notices") + f"SELECT {_NOTICE} FROM notices WHERE notice_id = 7")
def scan_point_lookup(spark, sf_dir):
    return domain.notices(spark, sf_dir).where("notice_id = 7")


@query("in_list_semi", with_("notices") + "SELECT notice_id, budget_krw FROM notices WHERE notice_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def in_list_semi(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("notice_id"))
    return domain.notices(spark, sf_dir).join(listed, "notice_id", "left_semi").select("notice_id", "budget_krw")


@query("in_list_short", with_("notices") + "SELECT notice_id, domain_code FROM notices WHERE notice_id IN (1, 2, 3, 5, 8, 13, 21)")
def in_list_short(spark, sf_dir):
    return R.by_keys(domain.notices(spark, sf_dir), "notice_id", [1, 2, 3, 5, 8, 13, 21]).select("notice_id", "domain_code")


@query("work_queue", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'")
def work_queue(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "user_id", "ts")


@query("owned_rows", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7")
def owned_rows(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_nationkey = 7").select("s_suppkey", "s_name")


@query("has_profile", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_profile FROM customer")
def has_profile(spark, sf_dir):
    there = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return table(spark, sf_dir, "customer").join(there, "c_custkey", "left").select("c_custkey", F.col("has").isNotNull().alias("has_profile"))


@query("key_conflicts", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT') UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(*) > 1")
def key_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").alias("key"))
    return R.key_conflicts(rows.where("o_orderpriority != '1-URGENT'"), rows.where("o_orderpriority = '1-URGENT'").select("key"), "key")


_NAMES = ("unspecified", "low", "urgent")
_CODES = {"1-URGENT": "urgent", "5-LOW": "low"}


@query("domain_name", with_("notices") + "SELECT notice_id, CASE domain_code WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' END AS domain_name FROM notices")
def domain_name(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])
    return domain.notices(spark, sf_dir).select("notice_id", F.try_element_at(names, F.col("domain_code")).alias("domain_name"))


@query("result_items", with_("notices") + "SELECT notice_id, domain_code AS code, budget_krw, bid_deadline, joint_venture_method IS NOT NULL AS joint FROM notices")
def result_items(spark, sf_dir):
    return domain.notices(spark, sf_dir).select("notice_id", F.col("domain_code").alias("code"), "budget_krw", "bid_deadline", F.col("joint_venture_method").isNotNull().alias("joint"))


@query("invalidate_embedding", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang, source, vec_id IS NOT NULL AND NOT (doc_id % 3 = 0 AND lang IS NOT NULL) AS embedded FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def invalidate_embedding(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select("doc_id", "lang", "source", "embedding")
    sent = rows.where("doc_id % 3 = 0").select("doc_id", F.lit(None).cast("string").alias("lang"))
    return R.patch(rows, sent, "doc_id", ["lang"], "embedding").select("doc_id", "lang", "source", F.col("embedding").isNotNull().alias("embedded"))


@query("ingest_new_only", "SELECT o_custkey AS notice_no, min(o_orderkey) AS first_order FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def ingest_new_only(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    stored = rows.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("notice_no"))
    return R.insert_new(stored, rows.select(F.col("o_custkey").alias("notice_no"), F.col("o_orderkey").alias("first_order")), ["notice_no"])


@query("upsert_analysis", "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(d.n_chars, l.quality::BIGINT) AS value, l.toxic FROM labels l FULL JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) d ON l.doc_id = d.doc_id")
def upsert_analysis(spark, sf_dir):
    stored = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("value"), "toxic")
    return R.upsert(stored, table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.col("n_chars").alias("value")), ["doc_id"])


@query("update_by_key", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'ERROR' ELSE s_name END AS status FROM supplier")
def update_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("status"), "s_acctbal")
    return R.upsert(rows.select("s_suppkey", "status"), rows.where("s_acctbal < 0").select("s_suppkey", F.lit("ERROR").alias("status")), ["s_suppkey"])


@query("delete_by_parent", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_parent(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return R.delete_by(table(spark, sf_dir, "lineitem"), gone, {"l_orderkey": "o_orderkey"}).select("l_orderkey", "l_linenumber")


@query("cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey < 5")
    orders = table(spark, sf_dir, "orders")
    lost = orders.join(gone.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return R.delete_by(lines, lost, {"l_orderkey": "o_orderkey"}).select("l_orderkey", "l_linenumber")


@query("restrict_delete", "SELECT c_custkey FROM customer WHERE c_nationkey < 5 AND c_custkey IN (SELECT o_custkey FROM orders)")
def restrict_delete(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").where("c_nationkey < 5").select("c_custkey")
    return R.blocked(asked, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


_ANALYSIS = "analysis AS (SELECT l_orderkey AS notice_id, l_suppkey AS set_id, CASE WHEN l_returnflag = 'N' THEN NULL ELSE floor(l_quantity)::INT END AS soft_score, l_linenumber AS line FROM lineitem)"


@query("analysis_top5", "WITH " + _ANALYSIS + ", joined AS (SELECT a.*, o_orderpriority AS code, row_number() OVER (PARTITION BY set_id ORDER BY soft_score DESC NULLS LAST, notice_id, line) AS rank FROM analysis a JOIN orders ON notice_id = o_orderkey) SELECT set_id, notice_id, soft_score, code, rank FROM joined WHERE rank <= 5")
def analysis_top5(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_suppkey").alias("set_id"), F.when(F.col("l_returnflag") != "N", F.floor("l_quantity").cast("int")).alias("soft_score"), F.col("l_linenumber").alias("line"))
    both = rows.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("notice_id"), F.col("o_orderpriority").alias("code")), "notice_id")
    order = Window.partitionBy("set_id").orderBy(F.desc_nulls_last("soft_score"), "notice_id", "line")
    # Cast as the SQL side has it: ranks are long.
    return both.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("set_id", "notice_id", "soft_score", "code", F.col("rank").cast("long").alias("rank"))


@query("paginate", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 20 OFFSET 5")
def paginate(spark, sf_dir):
    return R.page(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], 5, 20)


@query("newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def newest_first(spark, sf_dir):
    return R.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 0, 50)


@query("first_by_id", "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def first_by_id(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("first_order"))
    return R.first_of(rows, ["o_custkey"], ["first_order"])


@query("chat_history", with_("messages") + "SELECT session_id, id, role, content, row_number() OVER (PARTITION BY session_id ORDER BY id) AS place FROM messages")
def chat_history(spark, sf_dir):
    order = Window.partitionBy("session_id").orderBy("id")
    return domain.messages(spark, sf_dir).withColumn("place", F.row_number().over(order).cast("long"))


_PARTS = 100


@query("partners_of_search", "SELECT o_orderkey AS search_id, s_suppkey AS partner_id, s_name AS partner FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_nationkey = c_nationkey WHERE o_orderstatus = 'P'")
def partners_of_search(spark, sf_dir):
    searches = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("search_id"), F.col("o_custkey").alias("c_custkey"))
    owners = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"))
    partners = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("partner_id"), F.col("s_name").alias("partner"))
    return R.pairs(searches.join(owners, "c_custkey").select("s_nationkey", "search_id"), partners, "s_nationkey")


@query("partners_tool", "SELECT o_orderkey AS search_id, s_suppkey AS partner_id, s_name AS partner FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 100) ON s_nationkey = c_nationkey WHERE o_orderstatus = 'P'")
def partners_tool(spark, sf_dir):
    """``partners_of_search`` as an assistant's tool calls it, from SQL: once for each company, since all its searches get the
    same partners, which the join hands to them."""
    searches = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("search_id"), F.col("o_custkey").alias("c_custkey"))
    searches = searches.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("company_id")), "c_custkey").drop("c_custkey")
    partners = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("company_id"), F.col("s_suppkey").alias("partner_id"), F.col("s_name").alias("partner"))
    tools.register(spark)
    companies = searches.select("company_id", F.col("company_id").alias("search_id")).distinct()
    dealt = searches.repartitionByRange(_PARTS, "company_id", "search_id")
    return spark.sql("SELECT s.search_id, p.partner_id, p.partner FROM {dealt} s JOIN list_partners(TABLE({rows}), 100, 'partner') p ON p.search_id = s.company_id", dealt=dealt, rows=tools.tool_rows(companies, partners, salts=1))


@query("row_counts", with_("notices") + "SELECT domain_code, count(*) AS notices, count(joint_venture_method) AS joint FROM notices GROUP BY 1")
def row_counts(spark, sf_dir):
    return domain.notices(spark, sf_dir).groupBy("domain_code").agg(F.count("*").alias("notices"), F.count("joint_venture_method").alias("joint"))


@query("topn_per_group", with_("notices") + "SELECT domain_code, notice_id, budget_krw, rank FROM (SELECT *, row_number() OVER (PARTITION BY domain_code ORDER BY budget_krw DESC, notice_id) AS rank FROM notices) WHERE rank <= 10")
def topn_per_group(spark, sf_dir):
    order = Window.partitionBy("domain_code").orderBy(F.desc("budget_krw"), "notice_id")
    rows = domain.notices(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return rows.select("domain_code", "notice_id", "budget_krw", F.col("rank").cast("long").alias("rank"))


# The feed: documents stand for its items, with three attachments made of their columns.
_FEED = "SELECT doc_id, 'N' || (doc_id % 300) AS notice_no, source AS code, CASE WHEN doc_id % 7 = 0 THEN '' ELSE n_chars::VARCHAR END AS budget, CASE WHEN doc_id % 11 = 0 THEN 'soon' ELSE strftime(TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::INT), '%Y-%m-%d %H:%M:%S') END AS deadline, ['plan-' || lang || CASE WHEN doc_id % 2 = 0 THEN '.HWP' ELSE '.docx' END, 'notice.pdf', 'plan-' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.hwpx' ELSE '.pdf' END] AS names FROM documents"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int"))
    names = F.array(
        F.concat(F.lit("plan-"), "lang", F.when(i % 2 == 0, ".HWP").otherwise(".docx")),
        F.lit("notice.pdf"),
        F.concat(F.lit("plan-"), i.cast("string"), F.when(i % 3 == 0, ".hwpx").otherwise(".pdf")),
    )
    return table(spark, sf_dir, "documents").select(
        F.lit(1).alias("page"), i.alias("pos"), F.concat(F.lit("N"), (i % 300).cast("string")).alias("notice_no"), F.col("source").alias("code"), F.col("lang").alias("title"),
        F.when(i % 7 == 0, "").otherwise(F.col("n_chars").cast("string")).alias("budget"),
        F.when(i % 11 == 0, "soon").otherwise(F.concat(day.cast("string"), F.lit(" 00:00:00"))).alias("deadline"),
        names.alias("names"), F.transform(names, lambda n: F.concat(F.lit("http://x/"), n)).alias("urls"),
    )


@query("feed_select", f"WITH feed AS ({_FEED}), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY notice_no ORDER BY doc_id) AS n FROM feed WHERE code IN ('src0', 'src1', 'src2', 'src3')) WHERE n = 1), files AS (SELECT doc_id, min_by(name, prio * 10 + pos) AS file_name FROM (SELECT doc_id, name, pos, CASE lower(regexp_extract(name, '[^.]*$')) WHEN 'hwpx' THEN 1 WHEN 'pdf' THEN 2 WHEN 'hwp' THEN 3 ELSE 99 END AS prio FROM (SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM firsts)) WHERE contains(name, 'plan') AND prio <= 3 GROUP BY 1) SELECT notice_no, try_cast(nullif(budget, '') AS BIGINT) AS budget_krw, try_cast(deadline AS TIMESTAMP) AS bid_deadline, file_name, 'http://x/' || file_name AS file_url FROM firsts JOIN files USING (doc_id) WHERE try_cast(deadline AS TIMESTAMP) >= TIMESTAMP '2024-01-20'")
def feed_select(spark, sf_dir):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return feed.select_notices(_feed(spark, sf_dir), now, ("src0", "src1", "src2", "src3"), "plan").select("notice_no", "budget_krw", "bid_deadline", "file_name", "file_url")


@query("feed_flatten", "SELECT source AS page, doc_id AS item_id, lang AS title FROM documents")
def feed_flatten(spark, sf_dir):
    """Envelopes of 500 ids or fewer of a source."""
    item = F.struct(F.col("doc_id").alias("item_id"), F.col("lang").alias("title"))
    pages = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("page"), F.floor(F.col("doc_id") / feed.PAGE_ROWS)).agg(F.struct(F.struct(F.collect_list(item).alias("items")).alias("body")).alias("response"))
    return feed.items(pages).select("page", "item.item_id", "item.title")


@query("status_changes", with_("progress") + "SELECT set_id, event_id, status, current FROM (SELECT *, lag(status) OVER w AS s, lag(current) OVER w AS c, row_number() OVER w AS n FROM progress WINDOW w AS (PARTITION BY set_id ORDER BY ts, event_id)) WHERE n = 1 OR status IS DISTINCT FROM s OR current IS DISTINCT FROM c")
def status_changes(spark, sf_dir):
    return feeds.changes(domain.progress(spark, sf_dir), "set_id", ["ts", "event_id"], ["status", "current"]).select("set_id", "event_id", "status", "current")


_WATCHED = "SELECT user_id AS set_id, ts, event_id AS seq, nullif(nullif(event_type, 'error'), 'purchase') AS status, event_type = 'purchase' AS done, floor(value)::INT AS current FROM events"


@query(
    "status_events",
    "WITH w AS (SELECT set_id, ts, seq, CASE WHEN done THEN 'completed' ELSE status END AS status, current, min(ts) OVER (PARTITION BY set_id) + INTERVAL 1 HOUR AS until, max(ts) OVER () AS latest FROM (" + _WATCHED + ")), "
    "o AS (SELECT *, coalesce(sum((status IS NULL OR status = 'completed')::INT) OVER (PARTITION BY set_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM w WHERE ts <= until), "
    "k AS (SELECT *, row_number() OVER v AS n, lag(status) OVER v AS s, lag(current) OVER v AS c FROM o WHERE over = 0 WINDOW v AS (PARTITION BY set_id ORDER BY ts, seq)) "
    "SELECT set_id, ts, seq, CASE WHEN status IS NULL THEN 'gone' ELSE 'status' END AS kind, status, current, 100 AS total FROM k WHERE n = 1 OR status IS DISTINCT FROM s OR current IS DISTINCT FROM c "
    "UNION ALL SELECT set_id, until, NULL, 'timeout', NULL, NULL, NULL FROM k GROUP BY set_id, until, latest HAVING count(*) FILTER (status IS NULL OR status = 'completed') = 0 AND latest > until",
)
def status_events(spark, sf_dir):
    """Users as sets: a purchase completes one, an error says that it is gone, an hour is the deadline."""
    kind = F.when(F.col("event_type") == "purchase", "completed").otherwise(F.nullif("event_type", F.lit("error")))
    rows = domain.table(spark, sf_dir, "events").select(F.col("user_id").alias("set_id"), "ts", F.col("event_id").alias("seq"), kind.alias("status"), F.floor("value").cast("int").alias("current"), F.lit(100).alias("total"))
    return watch.events(rows, seconds=3600)


@query("progress_monotone", with_("progress", epochs="SELECT *, sum((current = 0)::INT) OVER (PARTITION BY set_id ORDER BY ts, event_id) AS epoch FROM progress") + "SELECT set_id, event_id, current, greatest(max(current) OVER (PARTITION BY set_id, epoch ORDER BY ts, event_id), 0) AS progress FROM epochs")
def progress_monotone(spark, sf_dir):
    return feeds.monotone(domain.progress(spark, sf_dir), "set_id", ["ts", "event_id"], "current").select("set_id", "event_id", "current", "progress")


@query("embedded_flag", "SELECT doc_id, vec_id IS NOT NULL AND doc_id % 3 <> 0 AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def embedded_flag(spark, sf_dir):
    """Whether a row has a vector; one row in three is taken to have lost it."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"))
    return table(spark, sf_dir, "documents").select("doc_id").join(vectors, "doc_id", "left").select("doc_id", F.col("embedding").isNotNull().alias("embedded"))


@query("branch_concat", "SELECT o_custkey AS key, string_agg(said, ',' ORDER BY branch, o_orderkey) AS said FROM (SELECT o_custkey, o_orderkey, 0 AS branch, o_orderstatus AS said FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT o_custkey, o_orderkey, 1, o_orderpriority FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def branch_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    branches = [rows.where("o_totalprice > 100000").select("key", "pos", F.col("o_orderstatus").alias("item")), rows.where("o_orderstatus = 'F'").select("key", "pos", F.col("o_orderpriority").alias("item"))]
    return R.concat_branches(branches, "key").select("key", F.array_join("items", ",").alias("said"))


@query("append_ids", "SELECT 1000 + row_number() OVER (ORDER BY c_custkey) AS id, c_custkey AS company_id, c_name AS name FROM customer")
def append_ids(spark, sf_dir):
    """Rows that are appended behind a greatest stored id of 1000."""
    came = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"))
    return tables.with_ids(spark.createDataFrame([(7,), (1000,)], "id long"), came, ["company_id"])


@query("sse_events", with_("progress") + "SELECT event_id, 'data: ' || to_json(struct_pack(set_id := set_id, status := status, current := current)) || chr(10) || chr(10) AS event FROM progress")
def sse_events(spark, sf_dir):
    rows = domain.progress(spark, sf_dir).select("event_id", "set_id", "status", "current")
    return files.sse(rows, ["event_id"])

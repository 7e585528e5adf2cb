"""Scalar functions, chunking and the streaming work queue."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import providers
from ..functions import text as X
from ..functions.chunk_values import INVENTORY
from ..functions.storage import materialize, shared_dir
from ..operators import chunking, contents, fusion, scoring
from ..sources import markup
from ..streaming import feeds, queues
from . import domain
from .domain import table, tok, with_
from .registry import query
from .retrieval_queries import _ALL, _BOTH, _SUMMED, _ranked, _sql

_TERMS = ("the", "tion", "le", "und", "zz-none")
_LIST = "['the', 'tion', 'le', 'und', 'zz-none']"


@query("normalize_text", "SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&copy;', chr(169)), '&middot;', chr(183)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;?', '&', 'g'), '<[^>]+>', ' ', 'g'), '[\\s\\x{00A0}\\x{0085}\\x{2028}\\x{2029}]+', ' ', 'g'))) AS content FROM pages")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.normalize(F.col("html")).alias("content"))


@query("compose_text", "SELECT s_suppkey, concat_ws(chr(10), CASE WHEN s_name <> '' THEN 'name: ' || s_name END, CASE WHEN s_nationkey % 2 = 0 THEN 'nation: ' || s_nationkey END) AS content FROM supplier")
def compose_text(spark, sf_dir):
    nation = F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.compose([("name", F.col("s_name")), ("nation", nation)]).alias("content"))


@query("keyword_match", f"SELECT doc_id, array_to_string(list_filter({_LIST}, lambda t: contains(lower(text), t)), ',') AS matched FROM documents")
def keyword_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.matches(F.lower("text"), _TERMS), ",").alias("matched"))


@query("preview", "SELECT doc_id, nullif(substr(text, 1, 120), '') AS preview, coalesce(nullif(substr(lang, 1, 1), 'e'), '-') AS short FROM documents")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text"), 120).alias("preview"), F.coalesce(F.nullif(F.substring("lang", 1, 1), F.lit("e")), F.lit("-")).alias("short"))


@query("file_priority", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 99 END AS priority FROM part")
def file_priority(spark, sf_dir):
    ends = F.element_at(F.array(F.lit(".a.HWPX"), F.lit(".pdf"), F.lit(".pdf.hwp"), F.lit("")), F.col("p_size") % 4 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", X.file_priority(F.concat("p_name", ends)).alias("priority"))


@query("parse_values", "SELECT doc_id, try_cast(CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN n_chars::VARCHAR ELSE lang END AS BIGINT) AS budget, try_strptime(CASE doc_id % 2 WHEN 0 THEN '2024-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 10:00:00' ELSE 'soon' END, '%Y-%m-%d %H:%M:%S') AS deadline FROM documents")
def parse_values(spark, sf_dir):
    i = F.col("doc_id")
    number = F.when(i % 3 == 0, "").when(i % 3 == 1, F.col("n_chars").cast("string")).otherwise(F.col("lang"))
    when = F.when(i % 2 == 0, F.concat(F.lit("2024-02-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:00:00"))).otherwise("soon")
    return table(spark, sf_dir, "documents").select("doc_id", X.parse_long(number).alias("budget"), X.parse_time(when).alias("deadline"))


@query("ordered_dedupe", "SELECT d.doc_id, coalesce(words, '') AS words FROM documents d LEFT JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS words FROM (SELECT doc_id, word, min(place) AS place FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (SELECT doc_id, " + tok("text") + " AS w FROM documents)) GROUP BY ALL) GROUP BY 1) USING (doc_id)")
def ordered_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(X.tokens(F.col("text"))), " ").alias("words"))


@query("token_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def token_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("concat_by_topic", with_("chunks") + "SELECT notice_id, l_topic, (chunk_index // 256)::INT AS part_no, sha256(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS body_sha256, count(*) AS n_chunks FROM chunks GROUP BY ALL")
def concat_by_topic(spark, sf_dir):
    """In ordered parts of 256 places, so that a large notice is no single value."""
    parts = domain.chunks(spark, sf_dir, vectors=False, indexed=True).withColumn("part_no", F.floor(F.col("chunk_index") / 256).cast("int"))
    found = scoring.concat_chunks(parts, ["notice_id", "l_topic", "part_no"])
    return found.select("notice_id", "l_topic", "part_no", F.sha2("body", 256).alias("body_sha256"), "n_chunks")


@query("notice_body", with_("chunks") + "SELECT notice_id, nullif(substr(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index), 1, 6000), '') AS body FROM chunks GROUP BY 1")
def notice_body(spark, sf_dir):
    return scoring.notice_body(domain.chunks(spark, sf_dir, vectors=False, indexed=True))


@query("notice_summary", with_("chunks") + "SELECT notice_id, substr(sha256(body), 1, 10) AS summary FROM (SELECT notice_id, nullif(substr(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index), 1, 6000), '') AS body FROM chunks GROUP BY 1)")
def notice_summary(spark, sf_dir):
    """What the stand-in model says of each notice's body, cut to ten characters."""
    bodies = scoring.notice_body(domain.chunks(spark, sf_dir, vectors=False, indexed=True))
    return scoring.summary(bodies, providers.HashProvider(), 10)


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_no FROM documents), big AS (SELECT *, trim(line) AS t, NOT (length(trim(line)) < 200 AND NOT contains(line, '<table>')) AS big FROM lines), ats AS (SELECT *, sum(big::INT) OVER w - big::INT AS pos, sum(big::INT) OVER (PARTITION BY doc_id) AS n FROM big WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)), placed AS (SELECT *, pos = n AS tail, least(pos, n - 1) AS place FROM ats WHERE n > 0)"


@query("merge_tiny", "WITH " + _LINES + " SELECT doc_id, place::BIGINT AS chunk_no, coalesce(string_agg(t, chr(10) ORDER BY chunk_no) FILTER (NOT big AND NOT tail) || chr(10) || chr(10), '') || max(t) FILTER (big) || coalesce(chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY chunk_no) FILTER (NOT big AND tail), '') AS content FROM placed GROUP BY 1, 2")
def merge_tiny(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("l_topic"), F.lit("").alias("s_topic"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_no", "content"))
    return chunking.merge_tiny(lines, least=200).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "content")


@query("token_windows", "WITH toks AS (SELECT doc_id, " + tok("text") + " AS w FROM documents), cut AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 300 THEN [0] ELSE range(0, len(w), 260) END) AS first_token FROM toks) SELECT doc_id, (CASE WHEN len(w) <= 300 THEN 0 ELSE first_token // 260 + 1 END)::INT AS part_no, first_token::INT AS first_token, len(w[first_token + 1:first_token + 300])::INT AS token_count, md5(array_to_string(w[first_token + 1:first_token + 300], ' ')) AS digest FROM cut")
def token_windows(spark, sf_dir):
    found = chunking.token_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), X.tokens(F.col("text")), 300, 40)
    return found.select("doc_id", "part_no", "first_token", F.size("window").alias("token_count"), F.md5(F.array_join("window", " ")).alias("digest"))


@query("chunk_index", with_("chunks") + "SELECT notice_id, chunk_id, chunk_index FROM chunks")
def chunk_index(spark, sf_dir):
    return domain.chunks(spark, sf_dir, vectors=False, indexed=True).select("notice_id", "chunk_id", "chunk_index")


@query("chunk_status", "SELECT d.doc_id, count(line) AS n_chunks, CASE WHEN count(line) = 0 THEN 'ERROR' ELSE 'CHUNKED' END AS parse_status FROM documents d LEFT JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l ON d.doc_id = l.doc_id AND length(line) >= 200 GROUP BY 1")
def chunk_status(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.length("line") >= 200)
    return chunking.chunk_status(docs, lines)


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their first words, as many as the made lines take."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.split("text", "[\\x09-\\x0D ]+", 6).alias("w"))


def _word(k: int) -> Column:
    return F.coalesce(F.translate(F.get("w", F.lit(k)), "|\\", ""), F.lit("x"))


def _markdown(docs: DataFrame, *ahead: Column) -> DataFrame:
    """Whole texts, each twice, under two headers and beside a pipe table, made of their own words."""
    lines = [*ahead, F.concat(F.lit("# 1. "), _word(0)), F.concat(F.lit("| a | "), _word(1), F.lit(" |")), F.lit("| --- | --- |"), F.concat(F.lit("| "), _word(2), F.lit(" | 2 |")), F.lit(""), F.concat(F.lit("1. "), _word(3)), F.col("text"), F.concat(F.lit("# 2. "), _word(4)), F.col("text")]
    return docs.select("doc_id", "source", F.concat_ws("\n", *lines).alias("content"), F.array(_word(0), _word(4)).alias("heads"))


_WORD = "coalesce(translate(w[{}], '|\\', ''), 'x')".format
_TABLE = f"""'<table>' || chr(10) || '  <tr><th>a</th><th>' || {_WORD(2)} || '</th></tr>' || chr(10) || '  <tr><td>a</td><td>' || {_WORD(2)} || '</td></tr>' || chr(10) || '  <tr><td>---</td><td>---</td></tr>' || chr(10) || '  <tr><td>' || {_WORD(3)} || '</td><td>2</td></tr>' || chr(10) || '</table>'"""


@query("md_tables", f"SELECT doc_id, '# 1. ' || {_WORD(1)} || chr(10) || {_TABLE} || chr(10) || chr(10) || '1. ' || {_WORD(4)} || chr(10) || coalesce(text || chr(10), '') || '# 2. ' || {_WORD(5)} || coalesce(chr(10) || text, '') AS content FROM (SELECT doc_id, text, regexp_split_to_array(text, '[\\x09-\\x0D ]+') AS w FROM documents)")
def md_tables(spark, sf_dir):
    return chunking.md_tables(_markdown(_worded(spark, sf_dir)), strict=True).select("doc_id", "content")


def _booklet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts behind a table of contents, made of their own words."""
    entry = lambda number, k, leaders, page: F.concat(F.lit(f"{number} "), _word(k), F.lit(f"{leaders}{page}"))
    listed = [F.lit("목차"), entry("1.", 0, " ........ ", 3), entry("가.", 3, " ··· ", 4), entry("2.", 4, "\t", 12), F.lit("붙임 ..... 90"), F.lit("")]
    return _markdown(_worded(spark, sf_dir), *listed)


@query("contents_headers")
def contents_headers(spark, sf_dir):
    return contents.find_headers(_booklet(spark, sf_dir))


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(chunking.md_tables(_booklet(spark, sf_dir)).select("doc_id", "content"), "booklets")
    return chunking.slice_headers(docs, contents.find_headers(docs))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, each with a table of its address woven in: the pages have none."""
    cells = F.concat(F.lit("<table><tr><th>page<th>url<tr><td>"), F.col("page_id").cast("string"), F.lit("<td>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</table>"))
    return table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("</article>"), F.concat(cells, F.lit("</article>"))))


@query("page_markdown")
def page_markdown(spark, sf_dir):
    """Whole pages as Markdown, their pipe tables as HTML: what chunking reads on."""
    found = markup.parse(_pages(spark, sf_dir), keep=["page_id"]).withColumnRenamed("markdown", "content")
    return chunking.md_tables(found).select("page_id", "parse_status", "char_count", (F.size(F.split("content", "<table>")) - 1).alias("n_tables"), "content")


@query("slice_headers")
def slice_headers(spark, sf_dir):
    return _sliced(spark, sf_dir)


@query("refine_chunks")
def refine_chunks(spark, sf_dir):
    return chunking.refine(_sliced(spark, sf_dir), ["doc_id", "chunk_no", "l_topic", "s_topic"])


_BULLETED = [("□", "text"), ("3.", "text"), ("## 가)", "lang"), ("-", "source")]
_BULLET_SQL = ", ".join("regexp_extract(body, '(?m)^[\\s\\x{00A0}\\x{0085}\\x{2028}\\x{2029}]*(?:#+[\\s\\x{00A0}]*)?(" + p + ")[\\s\\x{00A0}\\x{0085}\\x{2028}\\x{2029}]+', 1)" for p in INVENTORY)


@query("bullet_inventory", "SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(found) + 1), lambda k: CASE WHEN list_position(found, found[k]) = k THEN found[k] ELSE '' END), lambda b: b <> ''), ',') AS bullets FROM (SELECT doc_id, [" + _BULLET_SQL + "] AS found FROM (SELECT doc_id, " + " || chr(10) || ".join(f"'{'  ' * k}{b} ' || coalesce({c}, '')" for k, (b, c) in enumerate(_BULLETED)) + " AS body FROM documents))")
def bullet_inventory(spark, sf_dir):
    """Whole texts behind bullets, with what bullets they have themselves."""
    body = F.concat_ws("\n", *[F.concat(F.lit(f"{'  ' * k}{b} "), F.coalesce(c, F.lit(""))) for k, (b, c) in enumerate(_BULLETED)])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.bullets(body, INVENTORY), ",").alias("bullets"))


_HASHED = "('0x' || substr(md5(word), 1, 12))::BIGINT"


@query("embed_chunks", f"WITH words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\\x09-\\x0D ]+'), lambda w: w <> '')) AS word FROM documents WHERE lang = 'fr'), hashed AS (SELECT doc_id, {_HASHED} % 64 AS k, CASE WHEN {_HASHED} // 64 % 2 = 1 THEN 1.0 ELSE -1.0 END AS v FROM words), summed AS (SELECT doc_id, k, sum(v) AS v FROM hashed GROUP BY ALL), sized AS (SELECT doc_id, greatest(1, sqrt(sum(v * v))) AS n FROM summed GROUP BY 1), made AS (SELECT doc_id, string_agg(k || ':' || round(v / n * 1000)::BIGINT, ' ' ORDER BY k) FILTER (round(v / n * 1000)::BIGINT <> 0) AS vector FROM summed JOIN sized USING (doc_id) GROUP BY 1), told AS (SELECT vec_id, string_agg(k || ':' || v, ' ' ORDER BY k) FILTER (v <> 0) AS vector FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, round(unnest(embedding)::DOUBLE * 1000)::BIGINT AS v FROM embeddings) GROUP BY 1) SELECT d.doc_id AS chunk_id, coalesce(made.vector, told.vector, '') AS vector FROM documents d LEFT JOIN made USING (doc_id) LEFT JOIN told ON told.vec_id = d.doc_id AND d.lang IS DISTINCT FROM 'fr' WHERE d.lang = 'fr' OR told.vec_id IS NOT NULL")
def embed_chunks(spark, sf_dir):
    """Chunks without vectors get them: those in French are taken to have none. Vectors as their places and thousandths."""
    rows = domain.chunks(spark, sf_dir).where("embedding is not null or l_topic = 'fr'")
    rows = rows.select("chunk_id", "content", F.when(~F.col("l_topic").eqNullSafe(F.lit("fr")), F.col("embedding")).cast("array<double>").alias("embedding"))
    found = providers.embed(rows, providers.HashProvider(64)).select("chunk_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("v"))
    told = F.filter(F.transform("v", lambda x, k: F.when(x != 0, F.concat_ws(":", k, x))), lambda x: x.isNotNull())
    return found.select("chunk_id", F.array_join(told, " ").alias("vector"))


@query("criterion_prompt", with_("chunks", first="SELECT notice_id, chunk_id, content, row_number() OVER (PARTITION BY notice_id ORDER BY chunk_id) AS rank FROM chunks") + "SELECT f.notice_id AS criterion_id, '[criterion]' || chr(10) || 'name=' || f.notice_id || chr(10) || 'description=d' || chr(10) || 'max_score=10' || chr(10) || chr(10) || '[chunks]' || chr(10) || string_agg('- chunk_id=' || chunk_id || ': ' || content, chr(10) ORDER BY rank) || chr(10) || chr(10) || '[projects]' || chr(10) || any_value(p.lines) AS prompt FROM first f, (SELECT string_agg('- project_id=' || item_id || ' title=' || text, chr(10) ORDER BY item_id) AS lines FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 50)) p WHERE rank <= 5 GROUP BY 1")
def criterion_prompt(spark, sf_dir):
    order = Window.partitionBy("notice_id").orderBy("chunk_id")
    ranked = domain.chunks(spark, sf_dir, vectors=False).withColumn("rank", F.row_number().over(order)).where("rank <= 5").select(F.col("notice_id").alias("criterion_id"), "chunk_id", "rank", "content")
    criteria = ranked.select("criterion_id").distinct().select("criterion_id", F.lit(1).alias("company_id"), F.col("criterion_id").alias("name"), F.lit("d").alias("description"), F.lit("10").alias("max_score"))
    projects = table(spark, sf_dir, "benchmark").select(F.lit(1).alias("company_id"), F.col("item_id").alias("project_id"), F.col("text").alias("title"))
    return scoring.criterion_prompt(criteria, ranked, projects)


@query("search_end_to_end", _sql(f"SELECT notice_id, budget_krw, aggregate_score, n_chunks FROM ({_SUMMED}) JOIN (SELECT 'src' || o_orderkey AS notice_id, floor(o_totalprice)::BIGINT AS budget_krw FROM orders WHERE floor(o_totalprice) >= 50000) USING (notice_id)", _ALL, _ranked(_BOTH)))
def search_end_to_end(spark, sf_dir):
    """Hard filter over all notices, second filter, and both joined: documents' sources are the notices that have chunks."""
    from ..operators.relational import HardFilter, hard_filter

    notices = domain.notices(spark, sf_dir).withColumn("notice_id", F.concat(F.lit("src"), F.col("notice_id").cast("string")))
    kept = hard_filter(notices, HardFilter(budget_min=50_000))
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("notice_id")).distinct()
    found = fusion.second_filter(kept.select("notice_id").join(sources, "notice_id", "left_semi"), domain.chunks(spark, sf_dir), fusion.dedupe_targets(domain.targets(spark, sf_dir)), topics=domain.TOPICS)
    return kept.join(found, "notice_id").select("notice_id", "budget_krw", "aggregate_score", "n_chunks")


def _landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    source = spark.readStream.schema(table(spark, sf_dir, name).schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return source.parquet(f"{sf_dir}/{name}.parquet")
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("ingest_stream", "WITH toks AS (SELECT doc_id, len(" + tok("text") + ") AS n FROM documents) SELECT doc_id, (CASE WHEN n <= 7500 THEN 0 ELSE k // 7100 + 1 END)::INT AS part_no, least(7500, n - k)::INT AS token_count FROM (SELECT doc_id, n, unnest(CASE WHEN n <= 7500 THEN [0] ELSE range(0, n, 7100) END) AS k FROM toks)")
def ingest_stream(spark, sf_dir):
    """Documents as a landing folder: each batch is cut into windows and appended once."""
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    source = _landed(spark, sf_dir, "documents")

    def step(batch: DataFrame) -> DataFrame:
        found = chunking.token_windows(batch.select("doc_id", "text"), X.tokens(F.col("text")))
        return found.select("doc_id", "part_no", F.size("window").alias("token_count"))

    feeds.work(source, step, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("doc_id long, part_no int, token_count int").parquet(f"{base}/out").select("doc_id", "part_no", "token_count")


_LONG, _SIZE, _STEP, _SHORT = 2500, 300, 260, 4


def _window_worker(row: dict) -> list[dict]:
    """Windows of a document's words; it refuses those of too many."""
    words = [w for w in re.split("[\x09-\x0D ]+", row["text"] or "") if w]
    if len(words) > _LONG:
        raise ValueError("too long")
    return [{"part_no": k, "content": " ".join(words[at : at + _SIZE])} for k, at in enumerate(range(0, len(words), _STEP))]


def _vector_worker(row: dict) -> list[dict]:
    """The vector of a window; it refuses those of too few words."""
    if row["content"].count(" ") + 1 < _SHORT:
        raise ValueError("too short")
    return [{"part_no": row["part_no"], "embedding": providers.HashProvider(16).embed([row["content"]])[0]}]


@query("queue_states", f"""WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'), lambda w: w <> '')) AS n FROM documents)
SELECT doc_id, CASE WHEN n = 0 OR n > {_LONG} OR n - {_STEP} * ((n - 1) // {_STEP}) < {_SHORT} THEN 'ERROR' ELSE 'EMBEDDED' END AS state,
    CASE WHEN n = 0 THEN 'no results' WHEN n > {_LONG} THEN 'ValueError: too long' WHEN n - {_STEP} * ((n - 1) // {_STEP}) < {_SHORT} THEN 'ValueError: too short' END AS error FROM n""")
def queue_states(spark, sf_dir):
    """Documents through two chained queues, windows and their vectors, each of which refuses some."""
    base = f"{shared_dir(spark)}/queues-{uuid.uuid4().hex}"
    source = _landed(spark, sf_dir, "documents")
    cut = queues.Step(spark, f"{base}/cut", "doc_id", _window_worker, "part_no int, content string", "CHUNKED")
    embed = queues.Step(spark, f"{base}/embed", "doc_id", _vector_worker, "part_no int, embedding array<double>", "EMBEDDED")
    cut.start(source.select("doc_id", "text")).awaitTermination()
    cut.feed(embed).awaitTermination()
    return queues.states(table(spark, sf_dir, "documents"), "doc_id", [cut, embed])


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")

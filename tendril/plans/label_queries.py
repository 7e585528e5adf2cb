"""Rule classifiers, scoring and the preparation of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import classify, labels, scoring
from . import domain
from .domain import TOPICS, table, with_
from .registry import query

# The rules' own terms are Korean; the tables hold other words, so the queries take terms that occur in them.
_RUBRIC = classify.Rubric(vocabulary=("the\\s+of", "tion", "que\\s*la", "und"), keyword="license", points="\\d+(?:\\.\\d+)?\\s*a", total="(?:to|de)\\D{0,6}\\d", grades="ing|est|ent|er", level="\\d\\s*the", requirements=("api", "\\b(?:MIT|GNU)\\b"), header="(?dm)^the")
_N = "'[^0-9]'"
_R = {
    "b": "SELECT doc_id, text, regexp_matches(text, 'license') AS kw, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?\\s*a')) AS points, regexp_matches(text, '(?:to|de)[^0-9]{0,6}[0-9]') AS total, regexp_matches(text, '<table[\\s>]') OR regexp_matches(text, '(?m)^\\s*\\|.*\\|\\s*$') AS tbl, len(list_distinct(regexp_extract_all(text, '(ing|est|ent|er)'))) >= 3 OR regexp_matches(text, '[0-9]\\s*the') AS scale, regexp_matches(text, '(?m)^the') AS head, regexp_matches(text, 'the\\s+of')::INT + regexp_matches(text, 'tion')::INT + regexp_matches(text, 'que\\s*la')::INT + regexp_matches(text, 'und')::INT AS a, regexp_matches(text, 'api|\\b(?:MIT|GNU)\\b') AS req FROM documents",
    "c": "SELECT *, tbl AND scale AS grade, (kw AND (tbl OR points >= 4 OR total)) OR (a >= 3 AND (points >= 3 OR total OR (tbl AND scale))) AS gate, req AND NOT kw AS dis FROM b",
}
_RSQL = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _R.items())


@query("rubric_classify", _RSQL + " SELECT doc_id, a AS gate_a_hits, gate AS gate_b, dis AS disqualified, (a * 2 + 4 * kw::INT + least(points, 4) + 2 * total::INT + 2 * grade::INT + 2 * head::INT + tbl::INT - 8 * dis::INT)::INT AS score, a >= 1 AND gate AND NOT dis AS is_eval_table FROM c")
def rubric_classify(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return classify.rubric(rows, "content", _RUBRIC).select("doc_id", "gate_a_hits", "gate_b", "disqualified", "score", "is_eval_table")


@query("rubric_text", _RSQL + ", ch AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) SELECT ch.source AS notice_id, coalesce(string_agg(ch.text, chr(10) || chr(10) ORDER BY i) FILTER (a >= 1 AND gate AND NOT dis), 'template') AS rubric, count(*) FILTER (a >= 1 AND gate AND NOT dis) AS n_chunks FROM ch JOIN c USING (doc_id) GROUP BY 1")
def rubric_text(spark, sf_dir):
    return scoring.rubric_text(domain.chunks(spark, sf_dir, vectors=False, indexed=True), "template", _RUBRIC)


_DRAFT = classify.DraftTerms(direct=("license", "general public"), project=("estion", "mentation", "tionque"), generic=("the", "und", "que"))
_NORM = "lower(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(coalesce(text, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '[\\s\\x{00A0}\\x{0085}\\x{2028}\\x{2029}]+', ' ', 'g')))"


def _has(t: str, terms: tuple[str, ...]) -> str:
    return f"list_filter([{', '.join(repr(x) for x in terms)}], lambda x: contains({t}, x))"


_DSQL = f"n AS (SELECT doc_id, source, {_NORM} AS t FROM documents), m AS (SELECT *, {_has('t', _DRAFT.direct)} AS d, {_has('t', _DRAFT.project)} AS p, {_has('t', _DRAFT.generic)} AS g FROM n), draft AS (SELECT *, CASE WHEN len(d) > 0 THEN 3 WHEN len(p) > 0 THEN 2 WHEN len(g) > 0 THEN 1 ELSE 0 END AS draft_grade, CASE WHEN len(d) >= 2 OR (len(d) > 0 AND len(p) > 0) THEN 'high' WHEN len(d) > 0 THEN 'medium' WHEN len(p) >= 2 THEN 'high' WHEN len(p) > 0 THEN 'medium' WHEN len(g) > 0 THEN CASE WHEN len(g) >= 2 THEN 'medium' ELSE 'low' END WHEN length(t) >= 80 THEN 'high' ELSE 'medium' END AS draft_confidence FROM m)"


@query("draft_label", f"WITH {_DSQL} SELECT doc_id, draft_grade, draft_confidence, array_to_string(d || p || g, ',') AS terms FROM draft")
def draft_label(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return classify.draft_label(rows, "content", _DRAFT).select("doc_id", "draft_grade", "draft_confidence", F.array_join("draft_terms", ",").alias("terms"))


def _ranked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rank = lambda n, k: F.when(i % n != 0, (i % k).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("lang").alias("l_topic"), rank(3, 97).alias("dense_rank"), rank(5, 61).alias("bm25_rank"), rank(7, 43).alias("rrf_rank"), (i % 4).cast("int").alias("notice_relevance"))


_RANKS = "least(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 97 END, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 61 END, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 43 END)"


@query("review_priority", f"WITH {_DSQL}, r AS (SELECT *, {_RANKS} AS best FROM draft) SELECT doc_id, CASE WHEN draft_grade >= 2 OR coalesce(best <= 10, false) THEN 'P0' WHEN draft_confidence <> 'high' OR draft_grade = 1 OR coalesce(best <= 30, false) THEN 'P1' ELSE 'P2' END AS priority, len(list_filter([draft_grade >= 2, coalesce(best <= 10, false), doc_id % 4 = 0 AND draft_grade >= 2], lambda x: x))::INT AS n_reasons FROM r")
def review_priority(spark, sf_dir):
    found = classify.review_priority(classify.draft_label(_ranked_rows(spark, sf_dir), "content", _DRAFT))
    n = F.when(F.col("priority") == "P0", F.size(F.split("priority_reason", ", "))).otherwise(0)
    return found.select("doc_id", "priority", n.alias("n_reasons"))


_FINAL = classify.FinalTerms(direct=("license",), strong=("estion", "mention"), generic=("tion",), procedural=("version",), non_match=("gnu",), operation=("apache",), lists=("| the",), inventory=("***",), scope=("!!",), feature=("ing",), adjacent=("token =",), integration=("example.com",), technical=("und",), details=("of the",), requirement="the", excluded="que la", excluded_part="men", overview="es", names=("los",))
_F = {
    "n": f"SELECT doc_id, lang, doc_id % 4 AS g, {_NORM} AS t FROM documents",
    "m": "SELECT *, contains(t, 'license') AS direct, contains(t, 'estion') OR (contains(t, 'mention') AND NOT contains(t, 'que la')) AS strong, contains(t, 'tion') AS generic, contains(t, 'version') AS proc, contains(t, 'gnu') AS nonm, contains(t, 'apache') AS oper, contains(t, 'of the') AS detail FROM n",
    "r": "SELECT *, CASE WHEN g = 0 THEN 0 WHEN length(t) < 25 OR (CASE WHEN contains(t, '| the') THEN NOT detail ELSE (length(t) < 80 AND contains(t, 'the') AND NOT detail) OR length(trim(replace(t, '![image]', ''))) < 25 END) THEN 1 WHEN contains(t, '***') THEN 2 WHEN contains(t, '!!') THEN 3 WHEN contains(t, 'token =') THEN 4 WHEN contains(t, 'example.com') THEN 5 WHEN direct AND oper THEN 6 WHEN direct AND (nonm OR proc) THEN 7 WHEN direct THEN 8 WHEN lang = 'es' AND length(t) < 80 AND contains(t, 'los') THEN 9 WHEN proc OR nonm THEN 10 WHEN strong AND contains(t, 'ing') THEN 11 WHEN strong THEN 12 WHEN generic THEN 13 WHEN contains(t, 'und') THEN 14 ELSE 15 END AS rule FROM m",
}


@query("final_decision", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _F.items()) + " SELECT doc_id, rule::INT AS final_rule, (CASE WHEN rule = 2 THEN CASE WHEN direct OR strong OR generic THEN least(g, 1) ELSE 0 END WHEN rule IN (3, 9, 11, 13, 14) THEN least(g, 1) WHEN rule IN (4, 5, 6, 12) THEN least(g, 2) WHEN rule = 8 THEN least(g, 3) ELSE 0 END)::INT AS final_grade FROM r")
def final_decision(spark, sf_dir):
    return classify.final_decision(_ranked_rows(spark, sf_dir), "content", _FINAL).select("doc_id", "final_rule", "final_grade")


@query("judgment_guard", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0 ELSE greatest(0, least(l_quantity - 10, 30)) END AS score FROM lineitem")
def judgment_guard(spark, sf_dir):
    verdict = F.when(F.col("l_returnflag") == "R", "no_evidence").otherwise("found")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scoring.guarded(F.col("l_quantity") - 10, verdict, F.lit(30.0)).alias("score"))


_VOTES = "judged AS (SELECT l_orderkey AS notice_id, l_suppkey % 3 AS criterion, l_linenumber AS run, CASE WHEN l_returnflag = 'R' THEN 'no_evidence' ELSE 'found' END AS verdict, CASE WHEN l_returnflag = 'R' THEN 0 ELSE least(l_quantity, 40) END AS score FROM lineitem), voted AS (SELECT notice_id, criterion, round(avg(score), 6) AS earned, CASE WHEN count(*) FILTER (verdict = 'found') * 2 > count(*) THEN 'found' ELSE 'no_evidence' END AS verdict, min(run) FILTER (verdict = 'found') AS f, min(run) FILTER (verdict = 'no_evidence') AS ne, min(run) AS first FROM judged GROUP BY ALL)"


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "R", "no_evidence").otherwise("found")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("notice_id"), (F.col("l_suppkey") % 3).alias("criterion"), F.col("l_linenumber").alias("run"), verdict.alias("verdict"), F.col("l_quantity").alias("score"), F.lit(40.0).alias("max_score"))
    return scoring.vote(rows, ["notice_id", "criterion"])


@query("criterion_vote", f"WITH {_VOTES} SELECT notice_id, criterion, earned, verdict, coalesce(CASE verdict WHEN 'found' THEN f ELSE ne END, first) AS run FROM voted")
def criterion_vote(spark, sf_dir):
    return _voted(spark, sf_dir).select("notice_id", "criterion", "earned", "verdict", "run")


@query("soft_score", f"WITH {_VOTES} SELECT notice_id, least(round_even(round(sum(earned) / (40.0 * count(*)) * 100, 6), 0), 100)::INT AS soft_score FROM voted GROUP BY 1")
def soft_score(spark, sf_dir):
    return scoring.soft_score(_voted(spark, sf_dir), ["notice_id"])


@query("third_filter_top5", "WITH s AS (SELECT l_suppkey AS set_id, l_orderkey * 10 + l_linenumber AS notice_id, l_extendedprice AS agg, floor(l_quantity)::INT AS soft, CASE l_linenumber % 5 WHEN 0 THEN 'other_error' WHEN 1 THEN 'app_error' ELSE 'scored' END AS outcome FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY agg DESC, notice_id) AS place FROM s), k AS (SELECT set_id, notice_id, place, CASE WHEN outcome = 'app_error' THEN 0 ELSE soft END AS soft_score, CASE WHEN outcome = 'app_error' THEN 'failed' END AS note FROM p WHERE place <= 10 AND outcome <> 'other_error') SELECT set_id, notice_id, soft_score, note, rank FROM (SELECT *, (row_number() OVER (PARTITION BY set_id ORDER BY soft_score DESC, place))::INT AS rank FROM k) WHERE rank <= 5")
def third_filter_top5(spark, sf_dir):
    n = F.col("l_linenumber") % 5
    outcome = F.when(n == 0, "other_error").when(n == 1, "app_error").otherwise("scored")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("set_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("notice_id"), F.col("l_extendedprice").alias("aggregate_score"), F.floor("l_quantity").cast("int").alias("soft_score"), outcome.alias("outcome"), F.lit("failed").alias("error"))
    return scoring.third_filter(rows)


@query("citation_guard", "WITH r AS (SELECT l_orderkey AS notice_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'inferred' ELSE 'cited' END AS grounding, CASE l_linenumber % 2 WHEN 0 THEN 'profile' ELSE 'project' END AS src, l_suppkey AS cid, l_shipmode FROM (SELECT *, 'f' AS l_shipmode FROM lineitem)), k AS (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY pos) AS n, grounding <> 'cited' OR (src = 'project' AND cid IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) AS fine FROM r) SELECT notice_id, pos, CASE WHEN fine THEN grounding ELSE 'inferred' END AS grounding, CASE WHEN fine THEN src ELSE 'none' END AS cited_source, CASE WHEN fine THEN cid END AS cited_id, CASE WHEN fine THEN 'f' END AS cited_field FROM k WHERE n <= 5")
def citation_guard(spark, sf_dir):
    n = F.col("l_linenumber")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("notice_id"), pos.alias("pos"), F.when(n % 3 == 0, "inferred").otherwise("cited").alias("grounding"), F.when(n % 2 == 0, "profile").otherwise("project").alias("cited_source"), F.col("l_suppkey").alias("cited_id"), F.lit("f").alias("cited_field"))
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.lit("project").alias("source"), F.col("s_suppkey").alias("id"))
    return scoring.citation_guard(rows, known)


@query("note_weakness", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(nullif(o_orderstatus, 'P'), '') ELSE o_orderpriority END AS weaknesses FROM orders")
def note_weakness(spark, sf_dir):
    given = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority"))
    found = scoring.with_note(given, F.nullif("o_orderstatus", F.lit("P")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("weaknesses"))


@query("partner_route", "WITH p AS (SELECT s_nationkey AS company_id, s_suppkey AS partner_id, CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END AS email, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS choice FROM supplier), w AS (SELECT c_custkey, c_nationkey AS company_id, c_custkey % 5 AS choice, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 2 END AS n_weak FROM customer) SELECT c_custkey, n_weak::INT AS n_weak, CASE WHEN n_weak > 0 AND email <> '' THEN partner_id END AS partner_id, CASE WHEN n_weak > 0 AND coalesce(email <> '', false) THEN 'email' ELSE 'search' END AS route FROM w LEFT JOIN p USING (company_id, choice)")
def partner_route(spark, sf_dir):
    blank = F.array(F.lit(" "), F.lit(""))
    some = F.array(F.lit("a"), F.lit(" "), F.lit("b"), F.lit("c"))
    weak = table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.col("c_nationkey").alias("company_id"), F.when(F.col("c_custkey") % 4 == 0, blank).otherwise(some).alias("reasons"), (F.col("c_custkey") % 5).cast("int").alias("choice"))
    partners = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("company_id"), F.col("s_suppkey").alias("partner_id"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise("").alias("email"))
    routes = scoring.partner_route(weak.select(F.col("c_custkey").alias("own"), "*").withColumn("company_id", F.col("company_id")).drop("c_custkey"), partners, keep=("own",))
    return routes.select(F.col("own").alias("c_custkey"), "n_weak", "partner_id", "route")


@query("label_reuse", with_("chunks", "relevance") + "SELECT c.notice_id, c.chunk_id, coalesce(grade::VARCHAR, '') AS chunk_relevance FROM chunks c LEFT JOIN relevance r ON c.notice_id = r.notice_id AND c.chunk_id = r.chunk_id")
def label_reuse(spark, sf_dir):
    return labels.reuse(domain.chunks(spark, sf_dir, vectors=False).select("notice_id", "chunk_id"), domain.relevance(spark, sf_dir), ["notice_id", "chunk_id"])


@query("label_conflicts", with_("relevance") + "SELECT notice_id, count(DISTINCT grade) AS grades FROM relevance GROUP BY 1 HAVING count(DISTINCT grade) <> 1")
def label_conflicts(spark, sf_dir):
    return labels.conflicts(domain.relevance(spark, sf_dir), ["notice_id"], "grade")


@query("label_orphans", with_("chunks", "relevance", l="SELECT chunk_id + (chunk_id % 5 = 0)::INT * 1000000 AS chunk_id, CASE WHEN chunk_id % 7 = 0 THEN 'other' ELSE notice_id END AS notice_id FROM relevance") + "SELECT l.notice_id, l.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'missing' WHEN c.notice_id <> l.notice_id THEN 'notice' ELSE 'topic' END AS fault FROM l LEFT JOIN chunks c ON l.chunk_id = c.chunk_id WHERE c.chunk_id IS NULL OR c.notice_id <> l.notice_id OR l_topic NOT IN ('en', 'fr')")
def label_orphans(spark, sf_dir):
    i = F.col("chunk_id")
    rows = domain.relevance(spark, sf_dir).select((i + F.when(i % 5 == 0, 1_000_000).otherwise(0)).alias("chunk_id"), F.when(i % 7 == 0, "other").otherwise(F.col("notice_id")).alias("notice_id"))
    return labels.orphans(rows, domain.chunks(spark, sf_dir, vectors=False), TOPICS)


@query("case_violations", "WITH n AS (SELECT lang AS case_id, source AS notice_id FROM documents GROUP BY ALL), nl AS (SELECT lang AS case_id, source AS notice_id, (max(quality) * 5 - min(toxic))::INT AS grade FROM documents JOIN labels USING (doc_id) GROUP BY ALL), cl AS (SELECT lang AS case_id, CASE WHEN doc_id % 50 = 0 THEN 'other' ELSE source END AS notice_id, quality * 2 + 1 - toxic AS grade FROM documents JOIN labels USING (doc_id)) SELECT case_id, notice_id, 'unlabelled' AS fault FROM n WHERE (case_id, notice_id) NOT IN (SELECT (case_id, notice_id) FROM nl) UNION SELECT case_id, notice_id, 'not listed' FROM cl WHERE (case_id, notice_id) NOT IN (SELECT (case_id, notice_id) FROM n) UNION SELECT case_id, notice_id, 'grade' FROM nl WHERE grade NOT BETWEEN 0 AND 3 UNION SELECT case_id, NULL, 'fewer than two' FROM n GROUP BY 1 HAVING count(*) < 2")
def case_violations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("case_id"), F.col("source").alias("notice_id"))
    judged = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    notice = judged.groupBy("case_id", "notice_id").agg((F.max("quality") * 5 - F.min("toxic")).alias("grade"))
    chunk = judged.select("case_id", F.when(F.col("doc_id") % 50 == 0, "other").otherwise(F.col("notice_id")).alias("notice_id"), F.col("doc_id").alias("chunk_id"), (F.col("quality") * 2 + 1 - F.col("toxic")).alias("grade"))
    return labels.case_violations(docs.select("case_id", "notice_id").distinct(), notice, chunk)


@query("snapshot_drift", "SELECT doc_id AS ordinal FROM documents WHERE doc_id % 10 = 0")
def snapshot_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), "source", F.col("doc_id").alias("id"), "text", F.sha2("text", 256).alias("embedding_sha256"))
    return labels.snapshot_drift(rows, rows.withColumn("text", F.when(F.col("id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))


@query("build_cases", with_("relevance") + "SELECT 'case' AS case_id, 1::BIGINT AS company_id, chunk_id % 20 AS notice_id, (chunk_id % 20 % 4)::INT AS notice_grade, chunk_id, grade::INT AS chunk_grade FROM relevance")
def build_cases(spark, sf_dir):
    i = F.col("chunk_id")
    rows = domain.relevance(spark, sf_dir).select(F.lit("case").alias("case_id"), F.lit("1").alias("company_id"), (i % 20).cast("string").alias("bid_notice_id"), (i % 20 % 4).cast("string").alias("notice_relevance"), i.cast("string").alias("chunk_id"), F.lit("").alias("chunk_relevance"), F.concat(F.lit(" "), F.col("grade").cast("string")).alias("final_chunk_relevance"))
    return labels.build_cases(rows)


@query("label_overlay", "WITH c AS (SELECT DISTINCT source || CASE WHEN length(source) = 4 THEN '-notice-only' ELSE '' END AS case_id, lang AS notice_id, 2 AS grade FROM documents WHERE lang IN ('en', 'fr')) SELECT doc_id, source AS case_id, lang AS notice_id, CASE WHEN lang IN ('en', 'fr') AND EXISTS (SELECT 1 FROM c WHERE replace(c.case_id, '-notice-only', '') = documents.source AND c.notice_id = documents.lang) THEN 2 END AS grade FROM documents")
def label_overlay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat("source", F.when(F.length("source") == 4, "-notice-only").otherwise(""))
    cases = docs.where(F.col("lang").isin(*TOPICS)).select(name.alias("case_id"), F.col("lang").alias("notice_id"), F.lit(2).alias("grade")).distinct()
    return labels.overlay(docs.select("doc_id", F.col("source").alias("case_id"), F.col("lang").alias("notice_id")), cases)


@query("positional_zip", "SELECT doc_id, place, text_len, embedding_len FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, length(text) AS text_len FROM documents) JOIN (SELECT row_number() OVER (ORDER BY vec_id) AS place, len(embedding)::INT AS embedding_len FROM embeddings) USING (place)")
def positional_zip(spark, sf_dir):
    from ..functions.ordinals import numbered
    from ..operators.relational import at_places

    left = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("text_len"))
    right = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("embedding_len"))
    return at_places(numbered(left, ["doc_id"], "place"), numbered(right, ["vec_id"], "place").drop("vec_id"), ["place"])

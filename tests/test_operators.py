"""Single operators on hand-computed values."""

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tendril import providers
from tendril.functions import text as X
from tendril.functions.chunk_values import INVENTORY
from tendril.functions.ordinals import numbered
from tendril.operators import aggregate, chunking, classify, dense, fusion, labels, lexical, metrics, relational, scoring
from tendril.sources import feed, files, tables
from tendril.streaming import feeds


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


CHUNKS = "notice_id long, chunk_id long, chunk_index int, l_topic string, content string, embedding array<float>"
TARGETS = "ordinal int, source string, id long, text string, embedding array<float>"


def test_rrf_of_two_lists(spark):
    lists = spark.createDataFrame([("d0", 1, 10, 1), ("d0", 1, 11, 2), ("d1", 1, 11, 1), ("d1", 1, 12, 2)], "list string, notice_id long, chunk_id long, rank int")
    found = {r.chunk_id: r.fused for r in fusion.rrf(lists).collect()}
    assert found[11] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    assert found[10] == pytest.approx(1 / 61, abs=1e-9)


def test_dedupe_targets_keeps_profiles(spark):
    t = spark.createDataFrame([(0, "profile", 1, "same", [1.0]), (1, "project", 5, "same", [1.0]), (2, "project", 6, "same", [1.0]), (3, "project", 7, "other", [1.0])], TARGETS)
    assert sorted((r.source, r.id) for r in fusion.dedupe_targets(t).collect()) == [("profile", 1), ("project", 5), ("project", 7)]


def test_rank_chunks_skips_missing_vectors_and_attributes(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "en", "alpha beta", [1.0, 0.0]), (1, 2, 1, "en", "alpha alpha", None), (1, 3, 2, "en", "gamma", [0.0, 1.0])], CHUNKS)
    targets = spark.createDataFrame([(0, "profile", 1, "alpha", [1.0, 0.0]), (1, "project", 5, "gamma", [0.0, 1.0])], TARGETS)
    found = {r.chunk_id: (r.rank, r.ordinal) for r in fusion.rank_chunks(chunks, targets).collect()}
    assert set(found) == {1, 3}
    assert found[1][1] == 0 and found[3][1] == 1


def test_rank_chunks_cut(spark):
    chunks = spark.createDataFrame([(1, i, i, "en", "x", [1.0, float(i)]) for i in range(7)], CHUNKS)
    targets = spark.createDataFrame([(0, "profile", 1, "nothing", [1.0, 0.0])], TARGETS)
    assert sorted(r["rank"] for r in fusion.rank_chunks(chunks, targets, candidate_k=3).collect()) == [1, 2, 3]


def test_second_filter_without_targets_has_every_notice(spark):
    chunks = spark.createDataFrame([], CHUNKS)
    notices = spark.createDataFrame([(1,), (2,)], "notice_id long")
    assert rows(fusion.second_filter(notices, chunks, spark.createDataFrame([], TARGETS)), "notice_id") == [(1, 0.0, 0), (2, 0.0, 0)]
    with pytest.raises(ValueError):
        fusion.second_filter(notices, chunks, spark.createDataFrame([], TARGETS), candidate_k=5, final_k=10)


def test_distances(spark, monkeypatch):
    """All pairs, in one block of targets and in several; vectors without a length or of another width are at distance one."""
    vectors = [[1.0, 0.0], [0.0, 0.0], [1.0, 1.0], None, [2.0, 0.0, 1.0]]
    chunks = spark.createDataFrame([(1, k, k, "en", "x", v) for k, v in enumerate(vectors)], CHUNKS)
    targets = spark.createDataFrame([(0, "profile", 1, "a", [1.0, 0.0]), (1, "project", 1, "b", [0.0, 2.0]), (2, "project", 2, "c", None), (3, "project", 3, "d", [0.0, 0.0])], TARGETS)
    want = {(k, t): 1.0 for k in (0, 1, 2, 4) for t in (0, 1, 3)} | {(0, 0): 0.0, (2, 0): 0.292893, (2, 1): 0.292893}
    for most in (5000, 1):
        monkeypatch.setattr(dense, "MAX_TARGETS", most)
        assert {(r.chunk_id, r.ordinal): r.distance for r in dense.distances(chunks, targets).collect()} == want
        assert {r.chunk_id: r.ordinal for r in dense.nearest(dense.scan(chunks, targets, fetch=1)).collect()} == {0: 0, 1: 0, 2: 0, 4: 0}
    assert dense.distances(chunks, targets.limit(0)).count() == dense.distances(chunks.limit(0), targets).count() == 0


def test_a_cut_inside_a_batch_keeps_the_closest(spark):
    chunks = spark.createDataFrame([(k % 3, k, k, "en", "x", [1.0, float(k % 17)]) for k in range(300)], CHUNKS)
    targets = spark.createDataFrame([(t, "project", t, f"t{t}", [1.0, float(t)]) for t in range(4)], TARGETS)
    best = lambda f: sorted(map(tuple, lexical.top(dense.distances(chunks, targets, fetch=f), 7, ["notice_id", "ordinal"], "distance", largest=False).collect()))
    assert best(7) == best(None)


def test_stored_index_finds_the_same(spark):
    chunks = spark.createDataFrame([(1, k, k, "en", " ".join("abcdef"[j] for j in range(6) if k >> j & 1), [1.0, 0.0]) for k in range(64)], CHUNKS)
    q = spark.createDataFrame([("q", "a c zz"), ("r", "f")], "query_id string, text string")
    found = [rows(lexical.search(lexical.build_index(chunks, stored=x), q), "query_id", "chunk_id") for x in (False, True)]
    assert found[0] == found[1] and len(found[0]) == 80


def test_numbered(spark):
    df = spark.createDataFrame([(k * 7 % 100, "x") for k in range(100)], "k int, v string").repartition(5)
    assert {(r.k, r.place) for r in numbered(df, [F.desc("k")], "place").collect()} == {(k, 100 - k) for k in range(100)}
    assert numbered(df.limit(0), ["k"], "place").count() == 0
    grouped = spark.createDataFrame([("ab"[k % 2] if k < 90 else None, k) for k in range(100)], "g string, k int").repartition(7)
    got = sorted((r.g or "", r.k, r.place) for r in numbered(grouped, ["k"], "place", "g").collect())
    assert got == sorted([("ab"[k % 2], k, k // 2 + 1) for k in range(90)] + [("", k, k - 89) for k in range(90, 100)])


@pytest.mark.parametrize("size", [4, 7, 8, 9, 10, 11])
def test_notice_body_at_the_cut(spark, size):
    """A first text that ends just before, at and behind a cut at ten characters."""
    chunks = spark.createDataFrame([(1, 0, "x" * size), (1, 1, "yy"), (1, 2, "z")], "notice_id int, chunk_index int, content string")
    assert scoring.notice_body(chunks, 10).first().body == ("x" * size + "\n\nyy\n\nz")[:10]


def test_character_entities(spark):
    import html

    texts = ["a&eacute;b &#8364; &#x4e2d; &amp;lt; &hellip;", "&lt;p&gt; &nbsp;", "none & nothing", None, "&notit; &copy 1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.unescape(F.col("t"))).collect()] == [t if t is None else html.unescape(t) for t in texts]


@pytest.mark.parametrize(("method", "first"), [("max", 20), ("sum_top_3", 10), ("discounted_sum", 10), ("sum_top_k", 10)])
def test_aggregate_methods(spark, method, first):
    ranked = spark.createDataFrame([(10, 1, 0.3), (10, 2, 0.2), (10, 3, 0.1), (20, 1, 0.4), (20, 2, 0.05), (20, 3, 0.01)], "notice_id long, rank int, score double")
    notices = spark.createDataFrame([(10,), (20,), (30,)], "notice_id long")
    found = {r.notice_id: r.notice_score for r in aggregate.rank_notices(ranked, notices, method, 3).collect()}
    assert max(found, key=found.get) == first and found[30] == 0.0
    if method == "sum_top_3":
        assert found[10] == pytest.approx(0.6)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        aggregate.rank_notices(spark.range(1), spark.range(1), "mean")


def _metrics(spark, ranked, graded, k, least=1):
    r = spark.createDataFrame([(1, c, n + 1) for n, c in enumerate(ranked)], "g long, c long, rank int")
    g = spark.createDataFrame([(1, c, n) for c, n in graded.items()], "g long, c long, grade int")
    return metrics.per_group(r, g, ["g"], "c", (k,), least).first()


def test_metrics_by_hand(spark):
    grades = {10: 3, 20: 2, 30: 1}
    assert _metrics(spark, [10, 99, 20], grades, 2).recall_2 == pytest.approx(1 / 3, abs=1e-6)
    assert _metrics(spark, [10, 99, 20], grades, 3).recall_3 == pytest.approx(2 / 3, abs=1e-6)
    assert _metrics(spark, [10, 99, 20], grades, 3, 3).recall_3 == 1.0
    assert _metrics(spark, [99, 10], grades, 1).hit_1 == 0.0
    assert _metrics(spark, [99, 10], grades, 2).rr == 0.5
    assert _metrics(spark, [99], grades, 2).rr == 0.0
    assert _metrics(spark, [10, 20, 30], grades, 3).ndcg_3 == 1.0
    assert _metrics(spark, [30, 20, 10], grades, 3).ndcg_3 < 1.0


def test_macro_and_unknown_k(spark):
    ranked = spark.createDataFrame([(10, 101, 1), (10, 999, 2), (10, 102, 3), (20, 999, 1), (20, 201, 2)], "g long, c long, rank int")
    graded = spark.createDataFrame([(10, 101, 3), (10, 102, 1), (20, 201, 2)], "g long, c long, grade int")
    m = metrics.macro(metrics.per_group(ranked, graded, ["g"], "c", (10, 50), candidate_k=20), ["g"]).first()
    assert (m.recall_10, m.rr, m.recall_50) == (1.0, 0.75, None)


def test_percentile(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (10, 20, 30, 40)], "k int, v double")
    r = metrics.percentile(df, "v", (50, 95), ["k"]).first()
    assert (r.p50, r.p95) == (25.0, 38.5)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=1, max_size=20, unique=True), st.dictionaries(st.integers(0, 30), st.integers(1, 3), min_size=1, max_size=10))
def test_recall_is_monotone_and_ndcg_bounded(spark, ranked, grades):
    a, b = _metrics(spark, ranked, grades, 3), _metrics(spark, ranked, grades, 10)
    assert a.recall_3 <= b.recall_10
    assert 0 <= b.ndcg_10 <= 1 + 1e-9


def test_hard_filter_validates():
    with pytest.raises(ValueError):
        relational.HardFilter(budget_min=2, budget_max=1)
    with pytest.raises(ValueError):
        relational.HardFilter(budget_min=-1)


def test_hard_filter_nulls_fail_and_push_down(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None, 5, None), (2, "a", "j", 7, datetime(2024, 1, 1))], "notice_id long, domain_code string, joint_venture_method string, budget_krw long, bid_deadline timestamp_ntz")
    df.write.parquet(f"{tmp_path}/n")
    stored = spark.read.parquet(f"{tmp_path}/n")
    assert [r.notice_id for r in relational.hard_filter(stored, relational.HardFilter(deadline=datetime(2025, 1, 1))).collect()] == [2]
    assert [r.notice_id for r in relational.hard_filter(stored, relational.HardFilter(joint=False)).collect()] == [1]
    found = relational.hard_filter(stored, relational.HardFilter(budget_max=6))
    assert "LessThanOrEqual(budget_krw,6)" in found._jdf.queryExecution().toString()


def test_pages_are_bounded(spark):
    with pytest.raises(ValueError):
        relational.page(spark.range(3), ["id"], 0, 101)


RUBRIC = "| 평가항목 | 배점 |\n|---|---|\n| 기술능력 평가 | 80점 |\n| 가격 평가 | 20점 |\n| 합계 | 100 |"


def test_rubric(spark):
    df = spark.createDataFrame([(1, RUBRIC), (2, "이 사업은 시스템을 구축한다."), (3, "요구사항 총괄표 평가항목"), (4, None)], "id int, content string")
    found = {r.id: r for r in classify.rubric(df).collect()}
    assert found[1].is_eval_table and found[1].gate_a_hits == 3 and found[1].gate_b
    assert not found[2].is_eval_table and found[2].score == 0
    assert found[3].disqualified and not found[3].is_eval_table
    assert found[4].score == 0


def _final(spark, content, grade="3", topic=""):
    df = spark.createDataFrame([(content, grade, topic)], "content string, notice_relevance string, l_topic string")
    return classify.final_decision(df).first()


@pytest.mark.parametrize(
    ("content", "notice", "grade"),
    [
        ("생성형 AI 기반 RAG 질의응답 시스템을 구축하고 업무도우미를 제공한다.", "3", 3),
        ("여러 기관의 데이터 연계 및 통합 대시보드를 구축하여 의사결정 지원을 한다.", "3", 2),
        ("생성형 AI 기반 RAG 질의응답 시스템을 구축하고 업무도우미를 제공한다.", "0", 0),
        ("요구사항 개수 ECR 3 SFR 12 보안 8 데이터 4 합계 27", "3", 0),
        ("제안서 작성 및 계약 일반 사항을 준수하여 납품 검수를 진행한다.", "3", 0),
        ("웹 서비스 응용프로그램을 개발하고 데이터베이스를 구성하는 사업이다.", "3", 1),
        ("서버명 모델 네트워크 운영체계 목록과 현행 정보시스템 구성 현황이다.", "3", 1),
        ("짧음", "3", 0),
    ],
)
def test_final_decision(spark, content, notice, grade):
    assert _final(spark, content, notice).final_grade == grade


def test_draft_label_and_priority(spark):
    df = spark.createDataFrame([("RAG 기반 챗봇 구축", 3, None, 40, 1), ("일반 정보시스템", None, None, None, 1), (None, None, None, None, 1)], "content string, dense_rank int, bm25_rank int, rrf_rank int, notice_relevance int")
    found = classify.review_priority(classify.draft_label(df)).collect()
    assert [(r.draft_grade, r.draft_confidence, r.priority) for r in found] == [(3, "high", "P0"), (1, "low", "P1"), (0, "medium", "P1")]


def test_finalize_needs_columns(spark):
    with pytest.raises(ValueError):
        classify.finalize(spark.range(1))


def test_vote_needs_more_than_half(spark):
    rows_ = [("c", 1, "found", 5.0, 10.0), ("c", 2, "no_evidence", 9.0, 10.0), ("d", 1, "no_evidence", 1.0, 10.0), ("d", 2, "found", 12.0, 10.0), ("d", 3, "found", 8.0, 10.0)]
    df = spark.createDataFrame(rows_, "k string, run int, verdict string, score double, max_score double")
    found = {r.k: (r.earned, r.verdict, r.run) for r in scoring.vote(df, ["k"]).collect()}
    assert found == {"c": (2.5, "no_evidence", 2), "d": (6.0, "found", 2)}


def test_soft_score_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 2.5, 100.0), (2, 3.5, 100.0), (3, 120.0, 100.0), (4, 0.0, 0.0)], "n int, earned double, max_score double")
    assert rows(scoring.soft_score(df, ["n"]), "n") == [(1, 2), (2, 4), (3, 100), (4, 0)]


def test_third_filter(spark):
    data = [(1, n, n / 100, (13 - n) * 10, "scored", None) for n in range(1, 13)]
    df = spark.createDataFrame(data, "set_id int, notice_id int, aggregate_score double, soft_score int, outcome string, error string")
    assert [r.notice_id for r in scoring.third_filter(df).orderBy("rank").collect()] == [3, 4, 5, 6, 7]
    few = spark.createDataFrame([(1, 1, 0.2, 50, "app_error", "bad"), (1, 2, 0.1, 50, "other_error", None)], df.schema)
    assert [tuple(r) for r in scoring.third_filter(few).collect()] == [(1, 1, 0, "bad", 1)]


def test_notice_body_cuts_and_is_null_if_empty(spark):
    df = spark.createDataFrame([(1, 0, "a" * 10), (1, 1, "b" * 10), (2, 0, "")], "notice_id int, chunk_index int, content string")
    assert rows(scoring.notice_body(df, 15), "notice_id") == [(1, "a" * 10 + "\n\nbbb"), (2, None)]


def test_html_tables_and_strict():
    md = "x\n| a | b\\|c |\n|---|---|\n| 1 | 2 |\ny"
    assert chunking.html_tables(md) == "x\n<table>\n  <tr><th>a</th><th>b|c</th></tr>\n  <tr><td>1</td><td>2</td></tr>\n</table>\ny"
    strict = chunking.html_tables(md, strict=True)
    assert strict.count("<td>a</td>") == 1 and strict.count("<td>---</td>") == 2


def test_merge_tiny(spark):
    long = "w" * 60
    df = spark.createDataFrame([(1, 0, "A", "a", "s1"), (1, 1, "B", "b", long), (1, 2, "C", "c", "s2"), (2, 0, "A", "a", "lost")], "doc_id int, chunk_no int, l_topic string, s_topic string, content string")
    assert [tuple(r) for r in chunking.merge_tiny(df).collect()] == [(1, 0, "B", "b", f"s1\n\n{long}\n\ns2")]


def test_slice_headers(spark):
    text = "intro\n# 1. 개요 ..... 3\n# 1. 개요\nbody\n<table>\n# 2. 범위\n</table>\n# 2. 범위\nmore"
    docs = spark.createDataFrame([(1, text)], "doc_id int, content string")
    heads = spark.createDataFrame([(1, 0, "# 개요", "L1", "S1"), (1, 1, "# 범위", "L2", "S2")], "doc_id int, ord int, exact_header string, l_topic string, s_topic string")
    found = rows(chunking.slice_headers(docs, heads), "chunk_no")
    assert found == [(1, 0, "L1", "S1", "# 1. 개요\nbody\n<table>\n# 2. 범위\n</table>"), (1, 1, "L2", "S2", "# 2. 범위\nmore")]


def test_refine(spark):
    df = spark.createDataFrame([(1, "a\n1. b\n1. c\n<table>\n1. t\n</table>\nd"), (2, None)], "doc_id int, content string")
    assert rows(chunking.refine(df, ["doc_id"]), "doc_id", "part_no") == [(1, 0, "숫자", "a"), (1, 1, "숫자", "1. b"), (1, 2, "숫자", "1. c"), (1, 3, "숫자", "<table>\n1. t\n</table>"), (1, 4, "숫자", "d")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 60), st.integers(5, 20), st.integers(0, 4))
def test_windows_cover_all_tokens(spark, n, size, overlap):
    df = spark.createDataFrame([(1, list(range(n)))], "doc_id int, t array<int>")
    found = chunking.token_windows(df, F.col("t"), size, overlap).collect()
    assert {x for r in found for x in r.window} == set(range(n))
    assert all(len(r.window) <= size for r in found)


def test_text_functions(spark):
    df = spark.createDataFrame([(" <b>A&amp;B</b>  c ", "x.HWPX", "12", "x")], "t string, f string, n string, bad string")
    r = df.select(X.normalize(F.col("t")), X.file_priority(F.col("f")), X.parse_long(F.col("n")), X.parse_long(F.col("bad")), X.bullets(F.lit("  - a\n1. b\n## 2. c"), INVENTORY)).first()
    assert tuple(r) == ("a&b c", 1, 12, None, ["-", "1."])


def test_bm25_of_blank_query_finds_nothing(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "en", "alpha", [1.0])], CHUNKS)
    q = spark.createDataFrame([("q", " ")], "query_id string, text string")
    assert lexical.search(lexical.build_index(chunks), q).count() == 0


def test_build_cases_rejects(spark):
    schema = "case_id string, company_id string, bid_notice_id string, notice_relevance string, chunk_id string, chunk_relevance string"
    with pytest.raises(ValueError):
        labels.build_cases(spark.createDataFrame([("c", "1", "1", "3", "1", ""), ("c", "1", "2", "1", "2", "1")], schema))
    with pytest.raises(ValueError):
        labels.build_cases(spark.createDataFrame([("c", "1", "1", "3", "1", "1"), ("c", "1", "1", "1", "2", "1")], schema))
    fine = labels.build_cases(spark.createDataFrame([("c", "1", "1", "3", "1", "1")], schema).withColumn("final_chunk_relevance", F.lit("2")))
    assert fine.first().chunk_grade == 2


def test_feed_selection(spark):
    names = ["제안요청서.hwp", "제안.pdf", "other.hwpx"]
    data = [(1, 0, "n1", "81111513", "t", "5", "2024-05-01 00:00:00", names, ["a", "b", "c"]), (1, 1, "n1", "81111513", "t", "6", "2024-05-01 00:00:00", names, ["a", "b", "c"]), (1, 2, "n2", "0", "t", "", "2024-05-01 00:00:00", names, []), (1, 3, "n3", "81111513", "t", "", "2020-01-01 00:00:00", names, [])]
    df = spark.createDataFrame(data, "page int, pos int, notice_no string, code string, title string, budget string, deadline string, names array<string>, urls array<string>")
    found = feed.select_notices(df, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).collect()
    assert [(r.notice_no, r.budget_krw, r.file_name, r.file_url) for r in found] == [("n1", 5, "제안.pdf", "b")]


def test_page_source_keeps_what_it_could_read(spark):
    def fetch(page):
        if page == 2:
            raise OSError("gone")
        return '{"n": %d}' % page if page < 4 else None

    spark.dataSource.register(feed.page_source("pages_test", fetch, 5))
    found = spark.read.format("pages_test").load().orderBy("page").collect()
    assert [(r.page, r.error is None) for r in found] == [(1, True), (2, False), (3, True)]


def test_label_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted"\nline'), ("2", "ü")], "id string, content string")
    files.write_labels(df, f"{tmp_path}/l")
    assert rows(files.read_labels(spark, f"{tmp_path}/l"), "id") == [("1", 'a "quoted"\nline'), ("2", "ü")]
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfid,content\r\n1,x\r\n")
    assert files.read_labels(spark, f"{tmp_path}/bom.csv").columns == ["id", "content"]


def test_cases_results_templates(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"case_id":"c","company_id":1,"bid_notice_ids":[10],"notice_relevance":{"10":3},"chunk_relevance":{"10":{"101":2}}}\n')
    cases = files.read_cases(spark, f"{tmp_path}/c.jsonl")
    assert [tuple(r) for r in files.chunk_labels(cases).collect()] == [("c", 10, 101, 2)]
    files.write_results(cases, f"{tmp_path}/out", "t")
    assert '"10":3' in files.read_labels(spark, f"{tmp_path}/out/t.csv").first().notice_relevance
    (tmp_path / "a.md").write_text("x\ny")
    found = files.read_templates(spark, f"{tmp_path}/*.md")
    assert [tuple(r) for r in found.collect()] == [("a.md", "x\ny")]
    assert files.missing_templates(found, found.select("source_file")).count() == 0
    assert files.fill("a {{X}}", {"X": "b"}) == "a b"
    assert files.sse(spark.range(1)).first().event == 'data: {"id":0}\n\n'


def test_embed_fills_only_what_lacks(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "c", [9.0])], "id int, content string, embedding array<float>")
    found = {r.id: r.embedding for r in providers.embed(df, providers.HashProvider(4)).collect()}
    assert found[2] == [9.0] and len(found[1]) == 4


EVENTS = [(1, 1, "2nd", 0), (1, 2, "3rd", 3), (1, 3, "3rd", 3), (1, 4, "3rd", 7), (1, 5, "completed", 10), (2, 1, "3rd", 5), (2, 2, "3rd", 2), (2, 3, "3rd", 0), (2, 4, "3rd", 1)]


def _stream(spark, tmp_path, make, name):
    df = spark.createDataFrame(EVENTS, "set_id long, seq long, status string, current int")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df, spark.table(name)


def test_stream_changes_equals_batch(spark, tmp_path):
    df, got = _stream(spark, tmp_path, feeds.stream_changes, "changes")
    want = feeds.changes(df, "set_id", ["seq"], ["status", "current"])
    assert rows(got, "set_id", "seq") == rows(want, "set_id", "seq")
    assert got.where("set_id = 1").count() == 4


def test_stream_progress_equals_batch(spark, tmp_path):
    df, got = _stream(spark, tmp_path, feeds.stream_progress, "progress")
    want = feeds.monotone(df, "set_id", ["seq"], "current").select("set_id", "seq", "progress")
    assert rows(got, "set_id", "seq") == rows(want, "set_id", "seq")


def test_plans(spark):
    from tendril.plans import registry

    plan = lambda n: registry.QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan("topn_per_group")
    assert "TakeOrderedAndProject" in plan("newest_first")
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,5-LOW)]" in plan("hard_filter_code")


def test_search_request():
    codes = frozenset(feed.CATEGORIES)
    relational.SearchRequest(relational.HardFilter(domain_code="81112002"), "x" * 2000, codes)
    for filters, message in ((relational.HardFilter(domain_code="1"), None), (relational.HardFilter(), "x" * 2001)):
        with pytest.raises(ValueError):
            relational.SearchRequest(filters, message, codes)


def test_feed_tells_its_pages(spark):
    def fetch(page):
        if page == 3:
            raise OSError("gone")
        return '{"response": {"body": {"totalCount": 5, "items": []}}}'

    spark.dataSource.register(feed.page_source("told_pages", fetch, rows=2))
    assert sorted((r.page, r.error) for r in spark.read.format("told_pages").load().collect()) == [(1, None), (2, None), (3, "gone")]
    assert [feed.total_count(x) for x in (None, "", "[]", "x", '{"response": {"body": {}}}')] == [0] * 5


def test_pages_until_the_end(spark):
    page = lambda n, items, error=None, total=6: (n, items, error, total)
    for pages, want in (([page(1, 3), page(2, 3), page(3, 3)], [1, 2]), ([page(1, 3), page(2, 0), page(3, 3)], [1]), ([page(1, 3), page(2, 3, "x")], [1]), ([page(1, 3, total=0), page(2, 3, total=0)], [1]), ([page(1, 0)], [])):
        df = spark.createDataFrame(pages, "page int, n_items int, error string, total long")
        assert [r.page for r in feed.until_end(df).orderBy("page").collect()] == want


def test_tables_bootstrap_and_append(spark, tmp_path):
    folder = str(tmp_path / "db")
    assert set(tables.bootstrap(spark, folder)) == set(tables.TABLES) and tables.bootstrap(spark, folder) == []
    one = tables.append(spark, folder, "partners", spark.createDataFrame([(1, "b"), (1, "a")], "company_id long, name string"), ["name"])
    assert rows(one, "id") == [(1, 1, "a"), (2, 1, "b")]
    tables.append(spark, folder, "partners", spark.createDataFrame([(2, "c")], "company_id long, name string"), ["name"])
    got = tables.load(spark, folder, "partners")
    assert rows(got.select("id", "company_id", "name", "email"), "id") == [(1, 1, "a", None), (2, 1, "b", None), (3, 2, "c", None)]
    wider = tables.TABLES | {"partners": tables.TABLES["partners"] + ", phone string"}
    assert tables.load(spark, folder, "partners", wider).where("phone is null").count() == 3

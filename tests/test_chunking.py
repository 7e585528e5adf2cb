"""Contents, slicing and refining of whole tables against plain loops over lines."""

import re

import pytest

from tendril.functions import chunk_values as V
from tendril.functions.chunk_values import BULLETS
from tendril.operators import chunking, contents
from tendril.plans import text_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """(doc_id, lines of the text with its tables as HTML)."""
    found = chunking.md_tables(text_queries._booklet(spark, SF)).select("doc_id", "content").collect()
    return [(r.doc_id, (r.content or "").split("\n")) for r in found]


def squeezed(title):
    bare = re.sub(V.NUMBER.replace("(?U:\\s*)", r"\s*"), "", re.sub(r"^#+\s*", "", title.strip()))
    return re.sub(V.ASIDE, "", bare).replace(" ", "")


def listed(lines):
    """(line number, title, page) of the longest run of entries."""
    runs, last = [], None
    size = 0
    for k, line in enumerate(lines):
        size += len(line) + 1
        if size > 20_001:
            break
        m = re.match(V.ENTRY, line)
        if not m or re.search(V.APPENDED, m[1]) or len(m[1]) > 200:
            continue
        page = int(m[2])
        if last is None or page < last[1] or k - last[0] > 5:
            runs.append([])
        runs[-1].append((k, m[1], page))
        last = k, page
    best = max(runs, key=len, default=[])
    return best if len(best) >= 3 else []


def headers(lines):
    """(title, level, page, topic, short title, line of the body)."""
    found = listed(lines)
    end = found[-1][0] if found else 0
    by_title = {}
    for k, line in enumerate(lines):
        if k > end and len(line) <= 400 and not re.search(V.LEADERS.replace("(?U)", ""), line):
            by_title.setdefault(squeezed(line), []).append(k)
    styles, topics, at, out = [], [], -1, []
    for _, title, page in found:
        style = next((k for k, p in enumerate(V.NUMBERING) if re.match(p, title)), len(V.NUMBERING))
        if style in styles:
            del styles[styles.index(style) + 1 :]
        else:
            styles.append(style)
        del topics[len(styles) - 1 :]
        topics.append(next((t for t, words in V.TITLE_TOPICS if re.search(words, title)), topics[-1] if topics else V.OTHER_TOPIC))
        body = next((k for k in by_title.get(squeezed(title), []) if k > at and squeezed(title)), None)
        at = at if body is None else body
        short = re.sub(V.TITLE_NUMBER, "", re.sub(r"^#+\s*", "", title)).strip()
        out.append((title, len(styles), page, topics[-1], short, body))
    return out


def bare_key(header):
    return re.sub(r"^#+\s*", "", re.sub(r"^([가-하a-zA-Z0-9]+[.)\]]\s*)", "", header)).replace(" ", "")


def sliced(lines):
    """(chunk number, topic, header, text) of the parts under the headers."""
    heads = [(title, topic, short) for title, _, _, topic, short, _ in headers(lines)]
    keys = [(k, bare_key(title), (topic, short)) for k, (title, topic, short) in enumerate(heads)]
    keys = [x for x in keys if x[1]]
    early = {k for k, _, _ in keys[:2]}
    parts, opaque = [], False
    begun = False
    for line in lines:
        clean = re.sub(r"^#+\s*", "", line).strip()
        closes = "</table>" in clean and "<table>" not in clean
        opaque = True if "<table>" in clean else False if closes else opaque
        hidden = opaque or closes or not clean
        bare = re.sub(r"\(.*?\)|\[.*?\]|託.*?〕|〈.*?〉", "", clean).replace(" ", "")
        hit = None
        if not hidden and not re.search(r"\.{2,}|·{2,}|\s+\d+\s*$", clean):
            hit = next((x for x in keys if x[1] in bare and len(bare) <= len(x[1]) + 6), None)
        begun = begun or (hit is not None and hit[0] in early)
        if not begun:
            continue
        if hit is not None:
            parts.append((hit[2], []))
        parts[-1][1].append(line)
    texts = [(head, "\n".join(body).strip()) for head, body in parts]
    return [(k, *head, text) for k, (head, text) in enumerate(x for x in texts if x[1])]


def refined(text):
    lines = text.split("\n")
    named = [(re.compile(rf"^\s*{p}"), name) for p, name in BULLETS]
    bullet, name = next(((p, n) for p, n in named if any(p.search(x) for x in lines if not x.strip().startswith("#"))), (None, "None"))
    cuts, depth = {0}, 0
    for k, line in enumerate(lines):
        bare = line.strip()
        if "<table>" in bare:
            cuts |= {k} if depth == 0 else set()
            depth += 1
        elif "</table>" in bare:
            depth = max(0, depth - 1)
            cuts |= {k + 1} if depth == 0 else set()
        elif depth == 0 and (bare.startswith("#") or (bullet and bullet.search(bare))):
            cuts.add(k)
    edges = [*sorted(cuts), len(lines)]
    parts = ["\n".join(lines[a:b]).strip() for a, b in zip(edges, edges[1:], strict=False)]
    return [(k, name, p) for k, p in enumerate(x for x in parts if x)]


def test_slices_of_all_documents(spark, docs):
    want = sorted((i, *p) for i, lines in docs for p in sliced(lines))
    got = sorted((r.doc_id, r.chunk_no, r.l_topic, r.s_topic, r.content) for r in text_queries.slice_headers(spark, SF).collect())
    assert len({i for i, *_ in want}) > 150
    assert got == want


def test_refined_chunks_of_all_documents(spark, docs):
    want = sorted((i, no, *p) for i, lines in docs for no, _, _, text in sliced(lines) for p in refined(text))
    got = sorted((r.doc_id, r.chunk_no, r.part_no, r.top_bullet, r.content) for r in text_queries.refine_chunks(spark, SF).collect())
    assert got == want and len(got) > 400


def told(df):
    return sorted((r.doc_id, r.ord, r.exact_header, r.level, r.page, r.l_topic, r.s_topic, r.body_line) for r in df.collect())


def test_headers_of_all_documents(spark):
    texts = text_queries._booklet(spark, SF).select("doc_id", "content").collect()
    want = sorted((r.doc_id, k, *h) for r in texts for k, h in enumerate(headers((r.content or "").split("\n"))))
    assert told(text_queries.contents_headers(spark, SF)) == want and len(want) > 500
    assert sum(h[-1] is not None for h in want) > 0.9 * len(want)


BOOK = """제안요청서
목 차
Ⅰ. 사업 개요 ················ 1
  1. 추진 배경 ........ 2
  가. 현황	3
  나. 범위 …… 3
  2. 일정  4
Ⅱ. 제안요청사항 ........... 5
  1. 기능 요구사항 ..... 6
★ 배점표 ....... 9
Ⅲ. 기타 사항 ....... 10
붙임 1. 서식 ....... 11
12.5 ..... 1

Ⅰ. 사업 개요
# 1. 추진 배경 (요약)
본문 2024
가. 현황
2. 일정
Ⅱ. 제안요청사항
1. 기능 요구사항
Ⅲ. 기타 사항
1. 추진 배경
"""


def test_headers_by_hand(spark):
    few = "a ... 1\nb ... 2"
    falls = "a ... 5\nb ... 3\nc ... 4\n\n\n\n\n\n\nd ... 4\ne ... 4\nf ... 9\nb\nc"
    rows = [(1, BOOK), (2, few), (3, falls), (4, None), (5, ""), (6, "x" * 30_000 + "\n" + BOOK), (7, "a ... 1\na ... 1\na ... 1\na\nb\na")]
    got = told(contents.find_headers(spark.createDataFrame(rows, "doc_id long, content string")))
    assert got == sorted((i, k, *h) for i, text in rows if text for k, h in enumerate(headers(text.split("\n"))))
    assert [(level, page, topic, short, body) for i, _, _, level, page, topic, short, body in got if i == 1] == [
        (1, 1, "개요", "사업 개요", 14), (2, 2, "개요", "추진 배경", 15), (3, 3, "개요", "현황", 17), (3, 3, "개요", "범위", None), (2, 4, "개요", "일정", 18),
        (1, 5, "요구사항", "제안요청사항", 19), (2, 6, "요구사항", "기능 요구사항", 20), (3, 9, "평가기준", "배점표", None), (1, 10, "기타", "기타 사항", 21),
    ]
    assert [(h, b) for i, _, h, _, _, _, _, b in got if i in (3, 7)] == [("d", None), ("e", None), ("f", None), ("a", 3), ("a", 5), ("a", None)]
    assert {i for i, *_ in got} == {1, 3, 7}


@pytest.mark.parametrize("body", ["", "\n \n", "</table>\n1. a\n<table>\n1. b\n<table>\n</table>\n2. c\n</table>x\n3. d", "# 1. a\n□ b\nc\n□ d", "# ①", "a\n<table>one</table>\nb\n</table>\n# c", "1. a <table>\n1. b"])
def test_refined_by_hand(spark, body):
    df = spark.createDataFrame([(1, "x", body), (2, None, None)], "doc_id long, part_no string, content string").drop("part_no")
    got = sorted((r.part_no, r.top_bullet, r.content) for r in chunking.refine(df, ["doc_id"]).collect())
    assert got == refined(body)

"""Documents to Markdown: by hand, and whole pages against an independent reading by the standard library's parser."""

import html.parser
import re

import pytest

from tendril.operators import chunking
from tendril.plans import text_queries
from tendril.sources import markup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "document, want",
    [
        ("", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<h2>A <b>b</b></h2><p>one<br>two<p>three", "## A b\n\none\ntwo\n\nthree"),
        ("<ul><li>a<li>b<ol><li>x</li><li>y</ol><li>c</ul>d", "- a\n- b\n  1. x\n  2. y\n- c\n\nd"),
        ("<table><tr><th>a<th>b|c<tr><td>1<br>2<td></table>", "| a | b\\|c |\n| --- | --- |\n| 1 2 |  |"),
        ("<table><tr><td colspan=2>w</td><td>x</td></tr><tr><td>1</td></tr></table>", "| w |  | x |\n| --- | --- | --- |\n| 1 |  |  |"),
        ("<table><tr><td>o<table><tr><td>in</td></tr></table>p</td><td>q</td></tr></table>z", "| o p | q |\n| --- | --- |\n\n| in |\n| --- |\n\nz"),
        ("<table><tr><td></td></tr></table>", ""),
        ("<head><title>t</title></head><script>if (a<b) '<p>'</script>x<!-- <p>y -->z<style>p{}</style>", "xz"),
        ("<head><title>t</title><body><p>x", "x"),
        ('<img alt="a &gt; b" src=x> <a href="y>z">link</a>', "a > b link"),
        ("<pre>  a\n   b</pre><p>c", "  a\n   b\n\nc"),
        ("a < b <c <d", "a < b <c <d"),
        ("<p>&lt;p&gt;</p><hr>x", "<p>\n\n---\n\nx"),
        ("</table></ul></td>x<li>y<td>z", "x\n\n- yz"),
        ("<table>a<tr><td>b", "| a |\n| --- |\n| b |"),
        ('<p "unclosed', '<p "unclosed'),
        ("<script>never closed <p>x", ""),
    ],
)
def test_by_hand(document, want):
    assert markup.markdown(document) == want


@pytest.mark.parametrize("piece", ["<", "<a ", '<a "', "<!--", "<table><tr><td>", "<ul><li>", "</td>", "&", "<td colspan=9999999>"])
def test_long_odd_documents(piece):
    markup.markdown(piece * 20_000)


class Words(html.parser.HTMLParser):
    """Words of the visible text, and of each heading and item."""

    def __init__(self):
        super().__init__()
        self.hidden, self.all, self.marked, self.mark = [], [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style"):
            self.hidden.append(tag)
        elif tag in ("h1", "li"):
            self.mark = []

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        elif tag in ("h1", "li") and self.mark is not None:
            self.marked.append((tag, " ".join(self.mark)))
            self.mark = None

    def handle_data(self, data):
        if not self.hidden:
            words = [w for w in re.split("[ \t\r\n\f]+", data) if w]
            self.all += words
            if self.mark is not None:
                self.mark += words


def test_pages(spark):
    rows = markup.parse(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert len(rows) >= 200
    for r in rows:
        words = Words()
        words.feed(r.html)
        words.close()
        lines = r.markdown.split("\n")
        bare = [re.sub(r"^(#+|-) ", "", x) for x in lines]
        assert r.parse_status == "ok" and r.char_count == len(r.markdown)
        assert "".join("".join(bare).split(" ")) == "".join(words.all)
        assert [x[2:] for x in lines if x.startswith("# ")] == [t for k, t in words.marked if k == "h1"]
        assert [x[2:] for x in lines if x.startswith("- ")] == [t for k, t in words.marked if k == "li"]


def test_rows(spark, monkeypatch):
    rows = [(1, "<p>a", "old"), (2, None, None), (2, "", ""), (None, "<bad>", "x"), (3, "<h1>" + "w " * 300_000, "y")]
    df = spark.createDataFrame(rows, "page_id long, html string, markdown string")
    real = markup.markdown
    monkeypatch.setattr(markup, "markdown", lambda d: (_ for _ in ()).throw(ValueError("no")) if "bad" in d else real(d))
    got = sorted(((r.page_id, r.parse_status, r.char_count) for r in markup.parse(df).collect()), key=str)
    assert got == sorted([(1, "ok", 1), (2, "error: no document", 0), (2, "ok", 0), (None, "error: no", 0), (3, "ok", 2 + 600_000 - 1)], key=str)
    assert markup.parse(df.where("false")).count() == 0


def test_markdown_feeds_chunking(spark):
    table = "<h1>1. T</h1><table><tr><th>a<th>b<tr><td>1<td>2|3</table><p>z"
    df = markup.parse(spark.createDataFrame([(1, table)], "page_id long, html string")).withColumnRenamed("markdown", "content")
    assert chunking.md_tables(df).first().content == "# 1. T\n\n<table>\n  <tr><th>a</th><th>b</th></tr>\n  <tr><td>1</td><td>2|3</td></tr>\n</table>\n\nz"


def test_query(spark):
    got = {r.page_id: r for r in text_queries.page_markdown(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.parse_status == "ok" and r.n_tables == 1 and "<table>" in r.content for r in got.values())

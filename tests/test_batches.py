"""What Python holds of texts at once, and entries found without trying long lines."""

import pyarrow as pa
from pyspark.sql import functions as F

from tendril.functions.batches import slices
from tendril.operators import chunking, contents
from tendril.sources import markup


def test_slices():
    """Runs of rows of about the limit, a large row by itself, all rows once and in order."""
    texts = ["x" * 100] * 50 + ["y" * 5000] + [None, ""]
    got = list(slices(iter([pa.RecordBatch.from_pydict({"t": texts}), pa.RecordBatch.from_pydict({"t": []})]), 1000))
    assert sum((b.column(0).to_pylist() for b in got), []) == texts and len(got) > 5


def test_columns(spark):
    """Other columns stay; pages go to Python once."""
    df = spark.range(30).select("id", F.concat(F.lit("| a |\n| --- |\n| "), "id", F.lit(" |")).alias("content"))
    got = chunking.md_tables(df).collect()
    assert [r.id for r in got] == list(range(30)) and all(f"<td>{r.id}</td>" in r.content for r in got)
    assert chunking.md_tables(df.select("content")).columns == ["content"]
    pages = spark.createDataFrame([(1, "<p>a</p>", "u"), (2, None, "v")], "page_id long, html string, url string")
    assert markup.parse(pages, keep=["page_id"]).columns == ["page_id", "markdown", "char_count", "parse_status"]
    assert markup.parse(pages).columns == ["page_id", "html", "url", "markdown", "char_count", "parse_status"]


def test_entries_read_once(spark):
    """The slow pattern is tried on lines that end in a number alone, and the tables of contents are made once."""
    text = "목차\n1. a .... 3 \n2. b ... 4\t\n가. c\t5\r\nwords and 7 words\n1. a\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "x 1")], "doc_id long, content string")
    found = contents.entries(df)
    assert [(r.line_no, r.exact_header, r.page) for r in found.orderBy("line_no").collect()] == [(1, "1. a", 3), (2, "2. b", 4), (3, "가. c", 5)]
    plan = contents.find_headers(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "listed-" in plan or "regexp_extract" not in plan

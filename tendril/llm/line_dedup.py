"""Line dedup by content-defined chunks, in DataFrame functions alone.

A text is cut at each line feed. The hash of a line is the number of the first eight hexadecimal digits of its MD5; the
rolling hash at a line is its own hash plus 31 times that of the line before. A chunk ends at a line whose rolling hash
is a multiple of ``every``, at a line of ``long`` characters or more, and at the last line; so boundaries depend on two
neighbouring lines only and come back in step after lines are inserted or deleted. A long line is a paragraph that isn't
wrapped, and stands for several. Chunks with a long line, or of ``min_lines`` lines or more that aren't blank, are looked
at: of equal ones in the whole table the first stays, by document id and place, and the others are removed.

Chunks are matched by hash first, without their text; only chunks whose hash is repeated are fetched and grouped by their
bytes, so nothing is removed on a hash alone.

Defined results: a null text is an empty one (one blank line); blank chunks and single short lines always stay; an id names a
document, so rows that repeat an id and a text are one document and lose the same chunks; rows without an id count as
one, the first; a text from which nothing is removed stays byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize

EVERY, MIN_LINES, LONG = 3, 2, 250
_MARK = "[^ \\t\\r\\f\\x0B]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(text: Column, every: int = EVERY, long: int = LONG) -> Column:
    """array<struct<no, lines>> of a text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    hashed = lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")

    def cut(x: Column) -> Column:
        last = F.size(x["lines"]) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (x["rolling"][i] % every == 0) | (F.length(x["lines"][i]) >= long))
        start = lambda e, k: F.when(k == 0, 0).otherwise(e[k - 1] + 1)
        return _let(ends, lambda e: F.transform(e, lambda end, k: F.struct(k.alias("no"), F.slice(x["lines"], start(e, k) + 1, end - start(e, k) + 1).alias("lines"))))

    def rolled(h: Column) -> Column:
        return F.zip_with(h, F.concat(F.array(F.lit(0).cast("long")), F.slice(h, 1, F.size(h) - 1)), lambda a, b: a + b * 31)

    return _let(lines, lambda ls: _let(F.struct(ls.alias("lines"), _let(F.transform(ls, hashed), rolled).alias("rolling")), cut))


def _eligible(chunk: Column, min_lines: int, long: int) -> Column:
    marks = F.filter(chunk["lines"], lambda line: line.rlike(_MARK))
    return (F.size(marks) >= min_lines) | F.exists(marks, lambda line: F.length(line) >= long)


def marked(docs: DataFrame, doc: str = "doc_id", text: str = "text", every: int = EVERY, min_lines: int = MIN_LINES, long: int = LONG) -> DataFrame:
    """(row, id, chunks, gone): the document as a struct, its id, its chunks, and the numbers of those to remove."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    packed = packed.select("row", F.col(f"row.`{doc}`").alias("id"), F.xxhash64(f"row.`{text}`").alias("t"))
    body = F.col(f"row.`{text}`")
    looked = F.filter(chunks(body, every, long), lambda c: _eligible(c, min_lines, long))

    hashes = packed.select("id", "t", F.explode(F.transform(looked, lambda c: F.struct(c["no"].alias("no"), F.xxhash64(c["lines"]).alias("h")))).alias("c")).select("id", "t", "c.no", "c.h")
    # Written, so that the join below shuffles two tables and Spark can split a hot chunk's rows.
    often = materialize(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    met = hashes.join(often, "h").groupBy("id", "t").agg(F.collect_set("no").alias("met"))

    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["t"] == b["t"])
    fetched = packed.alias("p").join(met.alias("m"), same(packed, met)).select("p.id", "p.t", "m.met", F.col(f"p.row.`{text}`").alias("body"))
    found = F.filter(chunks(F.col("body"), every, long), lambda c: F.array_contains("met", c["no"]))
    texts = fetched.select("id", "t", F.explode(F.transform(found, lambda c: F.struct(c["no"].alias("no"), F.array_join(c["lines"], "\n").alias("text")))).alias("c"))
    texts = materialize(texts.select("id", "t", "c.no", "c.text", F.xxhash64("c.text").alias("h")), "chunks")
    first = texts.groupBy("h", "text").agg(F.min(F.struct("id", "t", "no")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "text", "first")
    first = materialize(first, "firsts")  # as above
    later = texts.join(first, ["h", "text"]).where(~F.struct("id", "t", "no").eqNullSafe(F.col("first")))
    gone = later.groupBy("id", "t").agg(F.collect_set("no").alias("gone"))
    out = packed.alias("p").join(gone.alias("g"), same(packed, gone), "left")
    return out.select("p.row", "p.id", chunks(F.col(f"p.row.`{text}`"), every, long).alias("chunks"), F.coalesce("g.gone", F.array().cast("array<int>")).alias("gone"))


def _kept_text() -> Column:
    kept = F.filter("chunks", lambda c: ~F.array_contains("gone", c["no"]))
    return F.array_join(F.flatten(F.transform(kept, lambda c: c["lines"])), "\n")


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(row, clean): the document as a struct and its text without repeated chunks; null stays null."""
    body = F.col(f"row.`{text}`")
    return marked(docs, doc, text, **how).select("row", F.when(F.size("gone") == 0, body).otherwise(_kept_text()).alias("clean"))


def keep(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with cleaned texts; a document that had repeated chunks and has only blank lines left is dropped."""
    found = dedup(docs, doc, text, **how)
    found = found.where(F.col("clean").eqNullSafe(F.col(f"row.`{text}`")) | F.col("clean").rlike(_MARK))
    return found.select(*[F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def report(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_removed (chunks), n_removed_lines, kept_sha256 for each document."""
    found = marked(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", **how)
    lines = lambda cs: F.aggregate(F.transform(cs, lambda c: F.size(c["lines"])), F.lit(0), lambda a, n: a + n).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        lines("chunks").alias("n_lines"),
        F.size("chunks").cast("long").alias("n_chunks"),
        F.size("gone").cast("long").alias("n_removed"),
        lines(F.filter("chunks", lambda c: F.array_contains("gone", c["no"]))).alias("n_removed_lines"),
        F.sha2(_kept_text(), 256).alias("kept_sha256"),
    )


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines
), ended AS (
  SELECT *, ((h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 3 = 0 OR length(line) >= 250)::INT AS ends FROM hashed
), numbered AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM ended
), chunks AS (
  SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n, count(*) FILTER (regexp_matches(line, '[^ \\t\\r\\f\\v]')) + max((length(line) >= 250 AND regexp_matches(line, '[^ \\t\\r\\f\\v]'))::INT) AS marked FROM numbered GROUP BY ALL
), placed AS (
  SELECT *, marked >= 2 AND row_number() OVER (PARTITION BY chunk, marked >= 2 ORDER BY doc_id, no) > 1 AS gone FROM chunks
)
SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed,
  coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
  sha256(coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM placed GROUP BY doc_id
"""

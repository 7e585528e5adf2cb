"""Documents to chunks: tables, headers, bullets, tiny pieces, token windows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunk_values as V
from ..functions.batches import slices
from ..functions.text import strip

MIN_LENGTH, WINDOW, OVERLAP = 50, 7500, 400

_SEPARATOR = re.compile(r"\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?")


def _cells(line: str) -> list[str]:
    inner = line.strip().removeprefix("|")
    if inner.endswith("|"):
        inner = inner[:-1]
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


def html_tables(text: str, strict: bool = False) -> str:
    """Pipe tables as HTML. ``strict`` repeats the header and the separator as body rows, as some consumers expect."""
    lines = text.split("\n")
    opens = [line.lstrip().startswith("|") for line in lines]
    out: list[str] = []
    at = 0
    while at < len(lines):
        if not (opens[at] and at + 1 < len(lines) and _SEPARATOR.fullmatch(lines[at + 1].strip())):
            out.append(lines[at])
            at += 1
            continue
        end = next((k for k in range(at, len(lines)) if not opens[k]), len(lines))
        row = lambda cells, tag: "  <tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
        body = range(at if strict else at + 2, end)
        out += ["<table>", row(_cells(lines[at]), "th"), *(row(_cells(lines[k]), "td") for k in body), "</table>"]
        at = max(end, at + 2 if not strict else end)
    return "\n".join(out)


def md_tables(docs: DataFrame, text: str = "content", strict: bool = False) -> DataFrame:
    """The texts with their pipe tables as HTML, a slice of a batch at a time."""
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = (None if (t := x.as_py()) is None else html_tables(t, strict) for x in b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(1)], ["text", "row"])

    found = packed.mapInArrow(run, packed.schema)
    return found.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def _lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    return docs.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def slice_headers(docs: DataFrame, headers: DataFrame, doc: str = "doc_id", text: str = "content") -> DataFrame:
    """(doc, chunk_no, l_topic, s_topic, content): the parts of each text under its headers.

    headers: (doc, ord, exact_header, l_topic, s_topic). Nothing counts before one of the first two headers. Table lines
    are opaque; lines that look like a table of contents are never headers; of several headers that fit the first counts.
    """
    clean = lambda c: F.replace(F.regexp_replace(F.regexp_replace(c, V.NUMBER, ""), V.SIGNS, ""), F.lit(" "), F.lit(""))
    heads = headers.select(F.col(doc), "ord", clean(F.col("exact_header")).alias("key"), F.col("l_topic").alias("hl"), F.col("s_topic").alias("hs")).where("key != ''")
    heads = heads.withColumn("early", F.row_number().over(Window.partitionBy(doc).orderBy("ord")) <= 2)
    order = Window.partitionBy(doc).orderBy("line_no")
    lines = _lines(docs, [doc], text).withColumn("clean", strip(F.regexp_replace("line", V.SIGNS, "")))
    opens, closes = F.contains("clean", F.lit("<table>")), F.contains("clean", F.lit("</table>")) & ~F.contains("clean", F.lit("<table>"))
    last = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(order)
    lines = lines.withColumn("opaque", F.coalesce(last, F.lit(False)) | closes | (F.col("clean") == ""))
    bare = F.replace(F.regexp_replace("clean", V.ASIDE, ""), F.lit(" "), F.lit(""))
    toc = F.col("clean").rlike(V.LEADERS)
    lines = lines.withColumns({"bare": bare, "may": ~F.col("opaque") & ~toc})
    fits = (F.col("may")) & F.contains("bare", F.col("key")) & (F.length("bare") <= F.length("key") + 6)
    hits = lines.select(doc, "line_no", "bare", "may").join(heads, doc).where(fits).groupBy(doc, "line_no").agg(F.min(F.struct("ord", "hl", "hs", "early")).alias("head"))
    lines = lines.select(doc, "line_no", "line").join(hits, [doc, "line_no"], "left")
    begun = F.max(F.when(F.col("head.early"), 1).otherwise(0)).over(order) == 1
    lines = lines.withColumn("begun", begun).where("begun")
    part = F.sum(F.when(F.col("head").isNotNull(), 1).otherwise(0)).over(order)
    lines = lines.withColumn("part", part)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    parts = lines.groupBy(doc, "part").agg(strip(joined).alias("content"), F.max("head.hl").alias("l_topic"), F.max("head.hs").alias("s_topic"))
    parts = parts.where("content != ''")
    return parts.select(doc, (F.row_number().over(Window.partitionBy(doc).orderBy("part")) - 1).alias("chunk_no"), "l_topic", "s_topic", "content")


def merge_tiny(chunks: DataFrame, doc: str = "doc_id", order: str = "chunk_no", text: str = "content", least: int = MIN_LENGTH) -> DataFrame:
    """(doc, chunk_no, l_topic, s_topic, content): short chunks without a table go ahead of the next long one.

    What is short at the end goes behind the last long one; without a long one all is lost.
    """
    rows = chunks.withColumn("_t", strip(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("_big", ~((F.length("_t") < least) & ~F.contains("_t", F.lit("<table>"))))
    w = Window.partitionBy(doc).orderBy(order)
    bigs = F.sum(F.col("_big").cast("int")).over(w)
    rows = rows.withColumns({"_at": bigs - F.col("_big").cast("int"), "_n": F.sum(F.col("_big").cast("int")).over(Window.partitionBy(doc))}).where("_n > 0")
    rows = rows.withColumn("_tail", F.col("_at") == F.col("_n")).withColumn("_at", F.least("_at", F.col("_n") - 1))
    texts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(F.col(order).alias("o"), F.col("_t").alias("t"))))), lambda x: x["t"]), "\n")
    got = rows.groupBy(doc, "_at").agg(
        texts(~F.col("_big") & ~F.col("_tail")).alias("ahead"),
        F.max(F.when(F.col("_big"), F.struct("_t", "l_topic", "s_topic"))).alias("big"),
        texts(~F.col("_big") & F.col("_tail")).alias("behind"),
        F.count(F.when(~F.col("_big") & ~F.col("_tail"), 1)).alias("n_ahead"),
        F.count(F.when(~F.col("_big") & F.col("_tail"), 1)).alias("n_behind"),
    )
    content = F.concat(F.when(F.col("n_ahead") > 0, F.concat("ahead", F.lit("\n\n"))).otherwise(""), "big._t", F.when(F.col("n_behind") > 0, F.concat(F.lit("\n\n"), "behind")).otherwise(""))
    return got.select(doc, F.col("_at").alias("chunk_no"), "big.l_topic", "big.s_topic", content.alias("content"))


def refine(chunks: DataFrame, keys: list[str], text: str = "content", patterns: Sequence[tuple[str, str]] = V.BULLETS) -> DataFrame:
    """(keys, part_no, top_bullet, content): chunks cut at the kind of bullet they use, at ``#`` lines and around tables.

    ``keys`` name a chunk. Its kind of bullet is the first pattern that opens one of its lines without ``#``. A line's segment
    is the number of cuts up to it; lines inside a table, nested tables included, are never cut. Null and blank chunks have no parts.
    """
    order = Window.partitionBy(*keys).orderBy("_at")
    lines = chunks.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_at", "_line")).withColumn("_bare", strip(F.col("_line")))
    opens = F.contains("_bare", F.lit("<table>"))
    closes = F.contains("_bare", F.lit("</table>")) & ~opens
    lines = lines.withColumns({"_signs": F.startswith("_bare", F.lit("#")), "_opens": opens, "_closes": closes, "_step": opens.cast("int") - closes.cast("int")})
    fits = F.array(*[F.col("_line").rlike(f"(?U)^\\s*{p}") for p, _ in patterns])
    lines = lines.withColumn("_fits", fits).withColumn("_kind", F.when(~F.col("_signs"), F.array_position("_fits", True)))
    lines = lines.withColumns({"_kind": F.min(F.nullif("_kind", F.lit(0))).over(Window.partitionBy(*keys)).cast("int"), "_sum": F.sum("_step").over(order)})
    # How many tables are open behind a line: a closing tag without its opening one counts for nothing.
    lines = lines.withColumn("_open", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(order)))
    outside = F.coalesce(F.lag("_open").over(order), F.lit(0)) == 0
    bullet = F.coalesce(F.get("_fits", F.col("_kind") - 1), F.lit(False))
    behind = F.coalesce(F.lag(F.col("_closes") & (F.col("_open") == 0)).over(order), F.lit(False))
    cut = (outside & ~F.col("_closes") & (F.col("_opens") | F.col("_signs") | bullet)) | behind
    parts = lines.withColumn("_cut", cut.cast("int")).withColumn("_segment", F.sum("_cut").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_line"))), lambda x: x["_line"]), "\n")
    parts = parts.groupBy(*keys, "_segment").agg(strip(joined).alias("content"), F.first("_kind").alias("_kind")).where("content != ''")
    names = F.array(*[F.lit(name) for _, name in patterns])
    part_no = F.row_number().over(Window.partitionBy(*keys).orderBy("_segment")) - 1
    return parts.select(*keys, part_no.alias("part_no"), F.coalesce(F.get(names, F.col("_kind") - 1), F.lit("None")).alias("top_bullet"), "content")


def token_windows(chunks: DataFrame, tokens: Column, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Adds part_no (0: whole), first_token and window (array): chunks of up to ``size`` tokens stay whole, longer ones
    become overlapping windows, one every ``size - overlap`` tokens."""
    step = size - overlap
    rows = chunks.withColumn("_tokens", tokens)
    starts = F.when(F.size("_tokens") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("_tokens") - 1, F.lit(step)))
    rows = rows.select("*", F.posexplode(starts).alias("_k", "first_token"))
    part = F.when(F.size("_tokens") <= size, 0).otherwise(F.col("_k") + 1)
    return rows.select("*", part.alias("part_no"), F.slice("_tokens", F.col("first_token") + 1, F.lit(size)).alias("window")).drop("_tokens", "_k")


def chunk_status(notices: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_chunks, parse_status): CHUNKED, or ERROR where nothing came out."""
    n = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))
    out = notices.select(key).join(n, key, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return out.withColumn("parse_status", F.when(F.col("n_chunks") == 0, "ERROR").otherwise("CHUNKED"))

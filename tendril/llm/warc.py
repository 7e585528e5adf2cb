"""WARC records of pages, and Merkle fixity audits of replicas.

A page becomes a WARC resource record. Records are dealt into files by id, ``PER_FILE`` ids to a file, in the order of id
and hash; a record's offset is the sum of the lengths before it in its file. Each file has a tree of SHA-256 hashes: a
record, a range of ``FANOUT`` ids (the hashes, lengths and offsets inside the range of its records, in order), a range of
``FANOUT`` such ranges, and the root over these. Ranges are bound to ids, so a record that is lost or longer shifts no
other range.

An audit compares the roots of two replicas, then the upper ranges of files whose roots differ, then the lower ranges of
those, and last the records of lower ranges that differ: only mismatching branches are descended, and what is read on
the way down shrinks with them.

Defined results: null urls and bodies are empty ones; an id that is no whole number is numbered by a hash of its text, and
told as that number; pages without an id go into ``NULL_FILES`` files of negative numbers,
by the hash of the record; equal records are stored once with their number of copies, and a differing number of copies is
damage; an empty replica lacks every record, and records that only the replica has are told too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import materialize

PER_FILE, FANOUT, NULL_FILES = 1024, 16, 4096
_CRLF = "\r\n"
_END = _CRLF + _CRLF


def record(page: Column, url: Column, body: Column) -> Column:
    """The bytes of a record as a string, up to its closing two line ends."""
    body = F.coalesce(body, F.lit(""))
    lines = [
        F.lit("WARC/1.0"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        F.concat(F.lit(_CRLF), body),
    ]
    return F.concat_ws(_CRLF, *lines)


def _drawn(sha: Column, at: int) -> Column:
    """A number below 16 ** 8 from eight digits of a hash."""
    return F.conv(F.substring(sha, at, 8), 16, 10).cast("long")


def _number(page: Column) -> Column:
    """The id as a whole number; of one that is none, the lower bits of a hash of its text."""
    text = page.cast("string")
    return F.coalesce(text.try_cast("long"), F.when(page.isNotNull(), F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1))))


def _file_no(page: Column, sha: Column, per_file: int) -> Column:
    return F.coalesce(F.floor(_number(page) / per_file), -1 - _drawn(sha, 1) % NULL_FILES)


def catalogue(pages: DataFrame, page: str = "page_id", url: str = "url", body: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """(page_id, file_no, slot, start_offset, length, copies, sha): where each distinct record is and what it hashes to."""
    whole = F.concat(record(F.col(page), F.col(url), F.col(body)), F.lit(_END))
    made = pages.select(_number(F.col(page)).alias("page_id"), F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("sha"))
    made = made.groupBy("page_id", "length", "sha").agg(F.count("*").alias("copies"))
    made = made.withColumn("file_no", _file_no(F.col("page_id"), F.col("sha"), per_file)).withColumn("slot", F.coalesce(F.pmod("page_id", F.lit(per_file)), _drawn(F.col("sha"), 9) % per_file))
    order = Window.partitionBy("file_no").orderBy("page_id", "sha", "length")
    before = F.sum(F.col("length") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return made.select("page_id", "file_no", "slot", F.coalesce(before, F.lit(0)).alias("start_offset"), "length", "copies", "sha")


def _digest(order: list[str], said: Column) -> Column:
    """SHA-256 over what is said of the children, in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, said.alias("said")))), lambda x: x["said"]), "|"), 256).alias("hash")


def tree(records: DataFrame, fanout: int = FANOUT) -> dict[str, DataFrame]:
    """The levels of the trees: low (file_no, high, low, hash), high (file_no, high, hash), root (file_no, hash)."""
    placed = records.withColumn("low", F.floor(F.col("slot") / fanout)).withColumn("high", F.floor(F.col("slot") / (fanout * fanout)))
    start = F.min("start_offset").over(Window.partitionBy("file_no", "low"))
    placed = placed.withColumn("inside", F.col("start_offset") - start)
    low = placed.groupBy("file_no", "high", "low").agg(_digest(["page_id", "sha"], F.concat_ws(":", "inside", "length", "copies", "sha")))
    low = materialize(low, "low")  # every level above comes from it, and the audit reads it again
    high = low.groupBy("file_no", "high").agg(_digest(["low"], F.concat_ws(":", "low", "hash")))
    root = high.groupBy("file_no").agg(_digest(["high"], F.concat_ws(":", "high", "hash")))
    return {"low": low, "high": high, "root": root}


def _differing(left: DataFrame, right: DataFrame, keys: list[str], above: DataFrame | None) -> DataFrame:
    """Keys of the nodes that differ or are missing on a side, below the nodes of ``above``."""
    if above is not None:
        left, right = (x.join(above, above.columns, "left_semi") for x in (left, right))
    both = left.join(right.withColumnRenamed("hash", "other"), keys, "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("other"))).select(*keys)


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT, trees: tuple[dict[str, DataFrame], dict[str, DataFrame]] | None = None) -> DataFrame:
    """(page_id, file_no, sha, damage) of the damaged records of two catalogues, whose trees may be given.

    damage: ``changed`` (the id is there with other content), ``missing`` (on the right), ``extra`` (on the right),
    ``copies`` (their number differs).
    """
    a, b = trees or (tree(left, fanout), tree(right, fanout))
    bad = _differing(a["root"], b["root"], ["file_no"], None)
    bad = _differing(a["high"], b["high"], ["file_no", "high"], bad)
    bad = materialize(_differing(a["low"], b["low"], ["file_no", "high", "low"], bad).select("file_no", "low"), "ranges")
    ours, theirs = (x.withColumn("low", F.floor(F.col("slot") / fanout)).join(bad, ["file_no", "low"], "left_semi").select("file_no", "page_id", "sha", "copies") for x in (left, right))
    on = ours.alias("l").join(theirs.alias("r"), F.col("l.file_no").eqNullSafe(F.col("r.file_no")) & F.col("l.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("l.sha") == F.col("r.sha")), "full")
    apart = on.where(~F.col("l.copies").eqNullSafe(F.col("r.copies"))).select(
        F.coalesce("l.file_no", "r.file_no").alias("file_no"),
        F.when(F.col("l.sha").isNotNull(), F.col("l.page_id")).otherwise(F.col("r.page_id")).alias("page_id"),
        F.coalesce("l.sha", "r.sha").alias("sha"),
        F.when(F.col("l.sha").isNull(), "extra").when(F.col("r.sha").isNull(), "missing").otherwise("copies").alias("damage"),
    )
    sides = apart.groupBy("file_no", "page_id").agg(F.max((F.col("damage") == "extra").cast("int")).alias("came"), F.max((F.col("damage") == "missing").cast("int")).alias("went"))
    changed = apart.alias("x").join(sides.alias("s"), F.col("x.file_no").eqNullSafe(F.col("s.file_no")) & F.col("x.page_id").eqNullSafe(F.col("s.page_id")))
    turned = (F.col("s.came") == 1) & (F.col("s.went") == 1) & F.col("x.damage").isin("extra", "missing")
    # A changed record is told once, with the hash that it should have.
    return changed.where(~(turned & (F.col("x.damage") == "extra"))).select("x.page_id", "x.file_no", "x.sha", F.when(turned, "changed").otherwise(F.col("x.damage")).alias("damage"))


def fixity(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The left catalogue with the root of each record's file and its damage in the right one (``none``: it is whole), and
    the records that only the right one has (``extra``), placed as there; the root of a file that the left one lacks is null."""
    trees = tree(left, fanout), tree(right, fanout)
    found = materialize(audit(left, right, fanout, trees).select("page_id", "file_no", "sha", "damage"), "damage")
    same = lambda d: F.col("l.page_id").eqNullSafe(F.col(f"{d}.page_id")) & (F.col("l.sha") == F.col(f"{d}.sha"))
    out = left.alias("l").join(found.where("damage != 'extra'").alias("d"), same("d"), "left").select("l.*", F.coalesce("d.damage", F.lit("none")).alias("damage"))
    extra = right.alias("l").join(found.where("damage = 'extra'").alias("d"), same("d")).select("l.*", "d.damage")
    out = out.unionByName(extra).join(trees[0]["root"].select("file_no", F.col("hash").alias("root_sha256")), "file_no", "left")
    return out.select("page_id", "file_no", "start_offset", "length", "copies", F.col("sha").alias("record_sha256"), "root_sha256", "damage")


def report(pages: DataFrame, replica: DataFrame, **how) -> DataFrame:
    left, right = (materialize(catalogue(x, **how), "catalogue") for x in (pages, replica))
    return fixity(left, right)


def write(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", body: str = "html", per_file: int = PER_FILE) -> None:
    """Write WARC files, a folder for each file number, whose bytes are those that ``catalogue`` tells of."""
    text = record(F.col(page), F.col(url), F.col(body)).alias("value")
    sha = F.sha2(F.concat(text, F.lit(_END)), 256)
    rows = pages.select(_file_no(F.col(page), sha, per_file).alias("file_no"), F.col(page).alias("page"), sha.alias("sha"), text)
    rows.repartition("file_no").sortWithinPartitions("file_no", "page", "sha").select("file_no", "value").write.partitionBy("file_no").option("lineSep", _END).text(path)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.DOTALL)


def records(raw: bytes) -> Iterator[tuple[int, str | None, str | None, str | None]]:
    """(offset, url, body, fault) of the records of a file; bytes that are no UTF-8 become replacement characters.

    A record without a header, without a length, or cut off ends the file: it is told with its fault and no body.
    """
    at = 0
    while at < len(raw):
        m = _HEAD.match(raw, at)
        if m is None:
            yield at, None, None, "no header"
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in m[1].split(b"\r\n"))}
        url = fields.get(b"warc-target-uri", b"").decode(errors="replace")
        size = fields.get(b"content-length", b"")
        if not size.isdigit():
            yield at, url, None, "no length"
            return
        end = m.end() + int(size)
        if end > len(raw):
            yield at, url, None, "cut off"
            return
        yield at, url, raw[m.end() : end].decode(errors="replace"), None
        at = end + len(_END)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, start_offset, url, body, fault) of the records of WARC files.

    A file is read by one task as one value, so it must be below 2 GB; ``PER_FILE`` keeps those of ``write`` far below.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, raw in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(file, *r) for r in records(raw)], columns=["file", "start_offset", "url", "body", "fault"]).astype({"start_offset": "int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0)
    return files.select("path", "content").mapInPandas(parse, "file string, start_offset long, url string, body string, fault string")


_CUT = "substr(md5(page_id::VARCHAR), 1, 2)"
_RECORD = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"
#: The report of ``pages`` against the replica of the registered query.
ORACLE = f"""
WITH own AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, {_CUT} AS drawn FROM pages
), sides AS (
  SELECT 'l' AS side, * FROM own
  UNION ALL SELECT 'r', page_id, url, CASE WHEN drawn = '00' THEN '~' || substr(html, 2) ELSE html END, drawn FROM own WHERE drawn <> '01'
  UNION ALL SELECT 'r', page_id, url, 'extra', 'x' FROM own WHERE drawn = '02'
), told AS (
  SELECT side, page_id, floor(page_id / 1024)::BIGINT AS file_no, (page_id % 1024) AS slot, drawn, {_RECORD} AS record FROM sides
), hashed AS (
  SELECT side, page_id, file_no, slot, strlen(record)::BIGINT AS length, sha256(record) AS sha, drawn, count(*) AS copies FROM told GROUP BY ALL
), placed AS (
  SELECT *, coalesce(sum(length * copies) OVER (PARTITION BY side, file_no ORDER BY page_id, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM hashed
), inside AS (
  SELECT *, slot // 16 AS low, slot // 256 AS high, start_offset - min(start_offset) OVER (PARTITION BY file_no, slot // 16) AS inside FROM placed WHERE side = 'l'
), lows AS (
  SELECT file_no, high, low, sha256(string_agg(inside || ':' || length || ':' || copies || ':' || sha, '|' ORDER BY page_id, sha)) AS hash FROM inside GROUP BY ALL
), highs AS (
  SELECT file_no, high, sha256(string_agg(low || ':' || hash, '|' ORDER BY low)) AS hash FROM lows GROUP BY ALL
), roots AS (
  SELECT file_no, sha256(string_agg(high || ':' || hash, '|' ORDER BY high)) AS root_sha256 FROM highs GROUP BY ALL
)
SELECT page_id, file_no, start_offset, length, copies, sha AS record_sha256, root_sha256,
  CASE WHEN side = 'r' THEN 'extra' WHEN drawn = '00' THEN 'changed' WHEN drawn = '01' THEN 'missing' ELSE 'none' END AS damage
FROM placed LEFT JOIN roots USING (file_no) WHERE side = 'l' OR drawn = 'x'
"""

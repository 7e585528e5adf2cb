"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are the runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. Every run of ``window``
consecutive words of a benchmark item is a window; an item of fewer words, but not none, is one window of its own
length. The set of windows is broadcast to the tasks that scan the documents; a window whose hash is met is verified
word by word before it counts.

The number of windows is counted before anything is broadcast. Beyond ``max_windows`` the set is dealt into blocks of
about that size by hash. The documents pass each block in a job of its own, which writes the hits, and its broadcast is
given up before the next one; so no task and no driver ever holds more than a block. The hits of the blocks are joined by
a 128-bit hash of the text.

Defined results: a null or wordless text has no words and no hits; an item with a null text, or without a word, has
no windows; the windows of an item without an id are hit like others, but no id is listed or counted for them; repeated
items and repeated rows each count for themselves (an id is listed once); an empty benchmark marks nothing. Texts are
scanned whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .arrow_text import LOWER_WORDS, LOWER_WORDS_TABLE, blocks, range_sums, run_hash, slice_hash, word_bounds

WINDOW = 10
MAX_WINDOWS = 200_000  # pairs of a window and an item that are sent at once
_BITS = 22


def _joined(words: list[bytes], s: int, n: int) -> bytes:
    return b" ".join(words[s : s + n])


def windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(window, n, item): the distinct windows of each benchmark item, as its words joined by a space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[bytes, int, str]] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = t.encode().translate(LOWER_WORDS_TABLE).split()
                n = min(window, len(words))
                rows += [(_joined(words, s, n), n, i) for s in range(len(words) - n + 1) if n]
            w, n, i = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(n, pa.int32()), pa.array(i, pa.string())], ["window", "n", "item"])

    known = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null")
    return known.mapInArrow(cut, "window binary, n int, item string").distinct()


def _string_hash(window: bytes) -> int:
    norm = np.frombuffer(window, np.uint8)
    s, e, _ = word_bounds(norm, np.array([0, len(norm)]))
    return int(run_hash(slice_hash(range_sums(norm), s, e), len(s))[0])


class WindowSet:
    """Windows by hash; what is broadcast."""

    def __init__(self, rows: list[tuple[bytes, int, list[str]]]):
        self.table: dict[int, list[tuple[bytes, list[str]]]] = {}
        by_n: dict[int, list[int]] = {}
        for w, n, items in rows:
            h = _string_hash(bytes(w))
            self.table.setdefault(h, []).append((bytes(w), list(items)))
            by_n.setdefault(n, []).append(h)
        self.hashes = {n: np.unique(np.array(h, np.uint64)) for n, h in by_n.items()}

    def bitmaps(self) -> dict[int, np.ndarray]:
        out = {}
        for n, h in self.hashes.items():
            out[n] = np.zeros(1 << _BITS, bool)
            out[n][(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return out


def _occurrences(found: WindowSet, maps: dict[int, np.ndarray], norm: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
    """(first word, word after the last, items) of each verified occurrence in a block."""
    word_hash = slice_hash(range_sums(norm), starts, ends)
    raw = norm.tobytes()
    for n, known in found.hashes.items():
        if len(starts) < n:
            continue
        h = run_hash(word_hash, n)
        at = np.flatnonzero(maps[n][(h >> np.uint64(64 - _BITS)).astype(np.int64)] & (texts[: len(h)] == texts[n - 1 :]))
        near = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
        for s in at[known[near] == h[at]].tolist():
            said = b" ".join(raw[starts[s] : ends[s + n - 1]].split())
            for w, items in found.table[int(h[s])]:
                if w == said:
                    yield s, s + n, items


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted, overlapping or touching spans united; flat: start, end, start, end ..."""
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _scanner(broadcast, text_of: Callable[[pa.RecordBatch], pa.Array]) -> Callable:
    """Adds the block's hits to columns hits and items, in the last two places of a batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: WindowSet = broadcast.value  # one block
        maps = found.bitmaps()
        for b in batches:
            names = b.schema.names
            n_words, hits, items = np.zeros(b.num_rows, np.int64), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            for lo, hi, data, off in blocks(text_of(b)):
                norm = LOWER_WORDS[data]
                starts, ends, texts = word_bounds(norm, off)
                n_words[lo:hi] = np.bincount(texts, minlength=hi - lo)
                first = np.searchsorted(texts, np.arange(hi - lo))
                new: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
                for s, e, names_hit in _occurrences(found, maps, norm, starts, ends, texts):
                    spans, ids = new.setdefault(int(texts[s]), ([], set()))
                    spans.append((s - int(first[texts[s]]), e - int(first[texts[s]])))
                    ids.update(names_hit)
                for k in {*new, *(k for k in range(hi - lo) if hits[lo + k])}:
                    spans, ids = new.get(k, ([], set()))
                    old = hits[lo + k]
                    hits[lo + k] = _merge(spans + list(zip(old[::2], old[1::2], strict=True)))
                    items[lo + k] = sorted(ids | set(items[lo + k]))
            columns = [b.column(i) for i in range(b.num_columns - 3)]
            columns += [pa.array(n_words), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return scan


def _window_blocks(benchmark: DataFrame, window: int, item: str, item_text: str, max_windows: int) -> list[DataFrame]:
    """(window, n, items) of the distinct windows, in blocks of about ``max_windows`` pairs of a window and an item. A window
    of many items is in several blocks, each with some of them, so no block's lists outgrow it."""
    pairs = materialize(windows(benchmark, window, item, item_text), "windows")
    n_blocks = max(1, -(-pairs.count() // max_windows))
    block = F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks))
    return [pairs.where(block == k).groupBy("window", "n").agg(F.collect_set("item").alias("items")) for k in range(n_blocks)]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, item: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(row, n_words, hits, items) for each document.

    row: the document as a struct, so that no name can clash; hits: flat word positions [start, end) of the united
    occurrences; items: sorted ids of the items with occurring windows.
    """
    none = {"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<long>"), "items": F.array().cast("array<string>")}
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    *before, last = _window_blocks(benchmark, window, item, item_text, max_windows)

    def passed(rows: DataFrame, block: DataFrame):
        sent = docs.sparkSession.sparkContext.broadcast(WindowSet([(r.window, r.n, r["items"]) for r in block.collect()]))
        return sent, rows.mapInArrow(_scanner(sent, lambda b: b.column(0).field(text)), rows.schema)

    if before:
        body = F.col(f"row.`{text}`")
        keyed = packed.select("row", F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2"))
        texts = keyed.select(F.struct(body.alias(text), "t1", "t2").alias("row"), *[v.alias(k) for k, v in none.items()])
        found = []
        for block in before:
            sent, hit = passed(texts, block)
            found.append(materialize(hit.where(F.size("hits") > 0).select("row.t1", "row.t2", "hits", "items"), "hits"))
            sent.destroy()
        every = functools.reduce(DataFrame.unionByName, found).distinct().groupBy("t1", "t2").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
        packed = keyed.join(materialize(every, "hits"), ["t1", "t2"], "left").select("row", *[F.coalesce(k, v).alias(k) if k in every.columns else v.alias(k) for k, v in none.items()])
    else:
        packed = packed.select("row", *[v.alias(k) for k, v in none.items()])
    return passed(packed, last)[1]


def n_hit(hits: str = "hits") -> Column:
    """Words inside hits."""
    return F.aggregate(F.transform(hits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", **how) -> DataFrame:
    """The documents without contaminated ones ("documents"), or with the hit words cut from their texts ("spans").

    In mode "spans" all else of a text stays as it is, and other columns are not changed.
    """
    found = scan(docs, benchmark, text, **how)
    if mode == "documents":
        return found.where(F.size("hits") == 0).select("row.*")
    if mode != "spans":
        raise ValueError(f"mode: {mode!r}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).field(text).to_pylist()
            for i, h in enumerate(b.column(1).to_pylist()):
                if h:
                    raw = texts[i].encode()
                    s, e, _ = word_bounds(LOWER_WORDS[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]))
                    keep = [0, *(int(x) for a, z in zip(h[::2], h[1::2], strict=True) for x in (s[a], e[z - 1])), len(raw)]
                    texts[i] = b"".join(raw[a:z] for a, z in zip(keep[::2], keep[1::2], strict=True)).decode()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "clean"])

    schema = found.select("row", F.lit("").alias("clean")).schema
    out = found.select("row", "hits").mapInArrow(cut, schema)
    return out.select(*[F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    found = scan(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), benchmark, "text", **how)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH docs AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), items AS (
  SELECT item_id, ws, least({WINDOW}, len(ws)) AS n FROM (SELECT item_id, {_WORDS.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL) WHERE len(ws) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS said FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM items)
), places AS (
  SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS said FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)
), hits AS (
  SELECT doc_id, n, s, item_id FROM places JOIN windows USING (n, said)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY 1
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

"""Exact substring removal: every byte covered by a string of ``length`` bytes that also starts elsewhere.

Texts are UTF-8 bytes. The least hash of the 32-byte pieces of a window (a string of ``length`` bytes) is its anchor, so
equal windows have equal anchors. The windows of a text fall into runs of neighbours with one anchor; the bytes of such a
run are a fragment. Windows can only be equal if their fragments' anchors are, which deals the work by anchor:

1. Fragments are described by hashes, without their bytes. An anchor met once has nothing equal: it is dropped.
2. Fragments that are equal as a whole are one from here on, and repeated. Equal means the first 128 bits of their SHA-256:
   to compare these byte by byte, the bytes of all copies would have to be shuffled.
3. The remaining fragments of an anchor are compared byte by byte. Windows whose hash isn't met again are left out, and of
   stretches of equal bytes all but one. The Burrows-Wheeler transform of what is left is taken (suffixes
   sorted as far as ``length``), and intervals are extended backwards, breadth first, level by level: an extension whose
   right border is new gives the common prefix there. Values come in increasing order and the work stops at ``length``:
   borders without a value separate suffixes that share ``length`` bytes or more.
4. An anchor with more than ``hot`` different fragments is not compared in one task: the hashes of its windows (128 bits of
   two bases) are counted as rows instead, which Spark pre-aggregates and splits.

Spans of covered bytes are gathered by text, a text being known by a 128-bit hash of its content, so equal rows share
their result. Nothing is capped or sampled, and matches never cross texts.

Defined results: a null text is an empty one; texts shorter than ``length`` lose nothing; copies of a text each lose all
that is covered; ids may be null or repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .arrow_text import BASE, BLOCK, blocks, range_sums, slice_hash

LENGTH, PIECE, HOT = 200, 32, 4096
#: Bytes of fragments that one transform takes.
TOGETHER = 1 << 20
_OTHER_BASE = 0xC2B2AE3D27D4EB4F
_PARTED = 0xFF  # no byte of UTF-8
RUNS = "t1 long, t2 long, start int, size int, anchor long, whole long, whole2 long"
#: A fragment with more than one in so many of all rows is found by a broadcast of at most so many such fragments.
PLACES = 5000


def _runs(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start in data, size, anchor, 128 bits of the fragment's SHA-256) of the runs of windows with one anchor."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    prefix = range_sums(data)
    at = np.arange(len(data) - PIECE + 1)
    piece = slice_hash(prefix, at, at + PIECE)
    width, least, have = length - PIECE + 1, piece, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    long = np.flatnonzero(np.diff(off) >= length)
    step = np.bincount(off[long], minlength=n + 1)[: n + 1] - np.bincount(off[long + 1] - length + 1, minlength=n + 1)[: n + 1]
    valid = np.cumsum(step)[:n] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (piece[: n - 1] == least[:-1])
    starts = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    size = np.flatnonzero(last) - starts + length
    raw, sha = memoryview(data), hashlib.sha256
    whole = np.frombuffer(b"".join([sha(raw[s:e]).digest()[:16] for s, e in zip(starts.tolist(), (starts + size).tolist(), strict=True)]), np.int64)
    return np.searchsorted(off, starts, "right") - 1, starts, size, least[starts].view(np.int64), whole[::2], whole[1::2]


def _pieces(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the piece, bytes, offsets); a single long text is cut so that each window is in one piece."""
    if len(off) > 2 or len(data) <= 2 * BLOCK:
        yield 0, data, off
        return
    for at in range(0, max(1, len(data) - length + 1), BLOCK):
        part = data[at : at + BLOCK + length - 1]
        yield at, part, np.array([0, len(part)])


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """(row, text, t1, t2): t1 and t2 are a 128-bit hash of the text's content."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.struct(*others, F.lit(0).alias("_")).alias("row"), body.alias("text"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2"))


def _described(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1, t2 = (c.to_numpy(zero_copy_only=False) for c in b.columns[:2])
            for lo, _, data, off in blocks(b.column(2)):
                for at, part, ends in _pieces(data, off, length):
                    text, start, size, *keys = _runs(part, ends, length)
                    own = start - ends[text] + at
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t1[lo + text], t2[lo + text], own.astype(np.int32), size.astype(np.int32), *keys)], [x.split()[0] for x in RUNS.split(", ")])

    return texts.select("t1", "t2", "text").mapInArrow(run, RUNS)


def _sorted_rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """The rotations of the text in the order of their first ``depth`` bytes at least."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.roll(text, -k).astype(np.uint64)
    done = 8
    while True:
        order = np.argsort(key)
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if done >= depth or rank.max() == n - 1:
            return order
        key = (rank * n + np.roll(rank, -done)).astype(np.uint64)
        done *= 2


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from each place on occur in the (circular) text more than once."""
    n = len(text)
    number = np.int32 if n < 1 << 22 else np.int64  # rows times 256 must fit
    order = _sorted_rotations(text, length + 1)
    place = np.empty(n, number)
    place[order] = np.arange(n, dtype=number)
    before = order - 1  # -1 is the last place
    back = place[before]  # the row of the rotation that starts one byte earlier
    transform = text[before].astype(number)
    border = np.zeros(n + 1, bool)  # whether row i is known to share less than ``length`` bytes with row i - 1
    border[[0, n]] = True
    low, size = np.array([0], number), np.array([n], number)
    for _ in range(length):
        # One step extends every interval of the level by each byte that stands before its rows.
        own = np.repeat(np.arange(len(low), dtype=number), size)
        rows = np.arange(len(own), dtype=number) + np.repeat(low + size - np.cumsum(size, dtype=number), size)
        to = back[rows]
        by = np.argsort(to)
        to, kind = to[by], (own * 256 + transform[rows])[by]
        first = np.ones(len(to), bool)
        first[1:] = kind[1:] != kind[:-1]
        at = np.flatnonzero(first)
        ends = np.append(at[1:], len(to))
        new = ~border[to[ends - 1] + 1]
        low, size = to[at[new]], (ends - at)[new].astype(number)
        border[low + size] = True
        if not len(low):
            break
    out = np.zeros(n, bool)
    same = np.flatnonzero(~border[:n])
    out[order[same]] = True
    out[order[same - 1]] = True
    return out


def _spans(starts: np.ndarray, length: int) -> list[int]:
    """Flat spans [start, end) that the windows at these ascending starts cover."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length], 1).ravel().tolist() if len(starts) else []


def _candidates(text: np.ndarray, off: np.ndarray, once: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches whose windows may be repeated: no others have a hash that is met again.

    Fragment k is text[off[k]:off[k + 1] - 1], a separator behind it; windows met in no fragment that is ``once`` are left out.
    """
    own = np.repeat(np.arange(len(off) - 1), np.diff(off))
    n = max(0, len(text) - length + 1)
    at = np.arange(n)
    at = at[at + length < off[own[:n] + 1]]
    h = slice_hash(range_sums(text), at, at + length)
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    first = np.flatnonzero(new)
    if not len(first):
        return at, at
    asked = np.logical_or.reduceat(once[own[at[order]]], first) & (np.diff(np.append(first, len(h))) > 1)
    found = np.zeros(len(h), bool)
    found[order] = np.repeat(asked, np.diff(np.append(first, len(h))))
    at = at[found]
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.append(0, cut + 1)[: len(at)]], at[np.append(cut, len(at) - 1)[: len(at)]] + length


def _compare(fragments: list[tuple], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(t1, t2, start, end) of repeated spans of fragments (t1, t2, start, once, bytes), which may be of several anchors.

    Stretches without a candidate don't enter the transform; stretches of equal bytes enter it once.
    """
    raw = b"".join(f[4] + bytes([_PARTED]) for f in fragments)
    off = np.concatenate([[0], np.cumsum([len(f[4]) + 1 for f in fragments])])
    starts, ends = _candidates(np.frombuffer(raw, np.uint8), off, np.array([f[3] for f in fragments], bool), length)
    places: dict[bytes, list[int]] = {}
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        places.setdefault(raw[s:e], []).append(s)
    if not places:
        return
    found = repeated_starts(np.frombuffer(b"".join(x + bytes([_PARTED]) for x in places), np.uint8), length)
    at = 0
    for piece, where in places.items():
        spans = [0, len(piece)] if len(where) > 1 else _spans(np.flatnonzero(found[at : at + len(piece) - length + 1]), length)
        at += len(piece) + 1
        for s in where:
            k = int(np.searchsorted(off, s, "right")) - 1
            t1, t2, start, once, _ = fragments[k]
            if once:
                for lo, hi in zip(spans[::2], spans[1::2], strict=True):
                    yield t1, t2, start + s - int(off[k]) + lo, start + s - int(off[k]) + hi


SPANS = "t1 long, t2 long, start int, end int"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["t1", "t2", "start", "end"])


def _cut(b: pa.RecordBatch) -> Iterator[tuple]:
    """(anchor, once, hot, t1, t2, start, bytes) of the fragments asked for of each text."""
    for raw, t1, t2, asked in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("t1").to_pylist(), b.column("t2").to_pylist(), b.column("asked").to_pylist(), strict=True):
        for x in asked:
            yield x["anchor"], x["once"], x["hot"], t1, t2, x["start"], raw[x["start"] : x["start"] + x["size"]]


def covered(texts: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(t1, t2, start, end): spans of bytes to remove of each text; they may overlap."""
    runs = _described(texts, length)
    often = runs.groupBy("anchor").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{k}") for c in ("whole", "whole2") for k, f in (("lo", F.min), ("hi", F.max))]).where("n > 1")
    # Written, so that the join below shuffles two tables and Spark can split a hot anchor's rows.
    often = materialize(often.select("anchor", F.expr("whole_lo != whole_hi or whole2_lo != whole2_hi").alias("mixed")), "anchors")
    met = materialize(_described(texts, length).join(often, "anchor"), "runs")
    spans = lambda df: df.select("t1", "t2", "start", (F.col("start") + F.col("size")).alias("end"))

    mixed = met.where("mixed")
    kind = ["anchor", "whole", "whole2"]
    kinds = mixed.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "start", "size")).alias("one"))
    kinds = materialize(kinds, "fragments")
    # The few fragments with a large share of the rows, of which there can be no more than PLACES, need no shuffle.
    hot_n = (kinds.agg(F.sum("n")).first()[0] or 0) // PLACES + 1
    told = mixed.join(F.broadcast(kinds.where(F.col("n") > hot_n).select(*kind, F.lit(True).alias("known"))), kind, "left")
    rest = told.where("known is null").drop("known").join(kinds.where(f"n > 1 and n <= {hot_n}").select(*kind), kind)
    equal = told.where("known").drop("known").unionByName(rest.select(*[c for c in told.columns if c != "known"]))

    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("different"), F.min("n").alias("least")).where("different > 1 and least = 1")
    open_ = materialize(open_, "open")  # so that Spark can split a hot anchor's rows in the join
    wanted = kinds.join(open_, "anchor").select("one.t1", "one.t2", F.struct("anchor", (F.col("n") == 1).alias("once"), (F.col("different") > hot).alias("hot"), "one.start", "one.size").alias("x"))
    wanted = wanted.groupBy("t1", "t2").agg(F.collect_list("x").alias("asked"))
    # Copies of a text are one here, so that no fragment is cut twice and its bytes are shuffled once.
    source = texts.select("t1", "t2", "text").dropDuplicates(["t1", "t2"]).join(wanted, ["t1", "t2"]).select("text", "t1", "t2", "asked")
    cut_schema = "anchor long, once boolean, hot boolean, t1 long, t2 long, start int, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            rows = list(_cut(b))
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in cut_schema.split(", ")])

    fragments = materialize(source.mapInArrow(cut, cut_schema), "bytes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, group = 0, None
        for b in batches:
            for anchor, *rest in zip(*(b.column(k).to_pylist() for k in ("anchor", "t1", "t2", "start", "once", "bytes")), strict=True):
                if anchor != group and size >= TOGETHER:
                    yield _span_batch(list(_compare(held, length)))
                    held, size = [], 0
                group = anchor
                held.append(tuple(rest))
                size += len(rest[-1])
        if held:
            yield _span_batch(list(_compare(held, length)))

    compared = fragments.where("not hot").select("anchor", "t1", "t2", "start", "once", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, SPANS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, once, t1, t2 = (b.column(k).to_numpy(zero_copy_only=False) for k in ("start", "once", "t1", "t2"))
            for lo, hi, data, off in blocks(b.column("bytes"), BLOCK // 8):
                count = np.maximum(np.diff(off) - length + 1, 0)
                own = np.repeat(np.arange(hi - lo), count)
                inside = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                at = off[own] + inside
                h1, h2 = (slice_hash(range_sums(data, base), at, at + length, base).view(np.int64) for base in (BASE, _OTHER_BASE))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, t1[lo + own], t2[lo + own], (start[lo + own] + inside).astype(np.int32), once[lo + own])], ["h1", "h2", "t1", "t2", "start", "once"])

    windows = fragments.where("hot").select("t1", "t2", "start", "once", "bytes").mapInArrow(each, "h1 long, h2 long, t1 long, t2 long, start int, once boolean")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    counted = windows.where("once").join(twice, ["h1", "h2"]).select("t1", "t2", "start", (F.col("start") + length).alias("end"))
    return spans(met.where("not mixed")).unionByName(spans(equal)).unionByName(compared).unionByName(counted)


def remove(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): kept are the remaining bytes, row the document's other columns as a struct.

    n_spans counts the maximal runs of removed bytes. kept is binary: a span may start or end inside a character.
    """
    texts = keyed(docs, text)
    found = covered(texts, length, hot).distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = texts.join(found, ["t1", "t2"], "left").select("row", "text", "spans")
    row = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for raw, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                at, parts, count, gone = 0, [], 0, 0
                last = -1
                for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                    if s > last:
                        count += 1
                        parts.append(raw[at:s])
                        gone += e - s
                        at = last = e
                    elif e > last:
                        gone += e - last
                        at = last = e
                parts.append(raw[at:])
                n_bytes.append(len(raw))
                n_removed.append(gone)
                n_spans.append(count)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"row {row}, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document."""
    found = remove(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), "text", length, hot)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the form that each goes back to.

Words are counted in Arrow batches. Two near words have an edit position p, so that they agree before it and behind it. The
class L holds the words of length L and, for insertions, those of length L - 1, and each half of its positions deals the
words by what near words then have in common: the half of the word that is left. A bucket that holds too many letters is
dealt again by halves of its positions, at the end by single positions, where a bucket holds one word for each letter that
can stand there. So no bucket grows with the vocabulary, and no link is lost.

Inside a bucket the words of length L are sorted forwards and backwards. They are points: a word's place in one order and
its place in the other. For each edit position of a word, what agrees with it before the position is an interval of the
forward order, what agrees behind it one of the backward order, and a wavelet tree reports the points inside both. Of an insertion's equal
places (a letter beside its like) the first counts. A position is only asked where some word agrees on each side.

Defined results: a null text has no words, a null id is the empty text in the check sum that damages words, and rows that repeat an id are texts of
their own. Without words of MIN_CHARS letters and MIN_COUNT places there are no rows. Other columns than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .arrow_text import blocks, word_bounds

MIN_CHARS, MIN_COUNT, TIMES, DAMAGE = 5, 3, 2, 97
#: Letters of a bucket's words; of more, its positions are halved.
BUCKET = 1 << 20
#: Letters of the buckets that are compared in one go, and bytes of the searches of one go.
GO, SEARCH = 1 << 20, 1 << 24
#: Distinct words that a task counts before it hands them on.
HELD = 500_000

#: a-z and A-Z in lower case; C3 begins U+00C0 to U+00FF, whose second byte is kept where it stands; all else parts words.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = _LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0xC3] = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of slices, each going on from a check sum."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, state = starts[order], begun[order] ^ np.uint32(0xFFFFFFFF)
    longer = np.searchsorted(-size[order], -np.arange(1, min(64, int(size.max(initial=0))) + 1), "right")  # slices with a j-th byte
    for j, n in enumerate(longer.tolist()):
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    for k in range(int(np.searchsorted(-size[order], -64, "left"))):  # the rest of those of more than 64 bytes
        state[k] = zlib.crc32(data[at[k] + 64 : at[k] + size[order[k]]].tobytes(), int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _met(texts: pa.Array, ids: list[str | None], damage: int, least: int) -> Iterator[tuple[list[str], list[int]]]:
    """Words of blocks of texts and how often they stand there."""
    prefixes = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in ids], np.uint32)
    for lo, _, raw, offsets in blocks(texts):
        data = _LETTERS[raw]
        second = np.flatnonzero(raw[:-1] == 0xC3) + 1
        data[second] = raw[second]
        starts, ends, own = word_bounds(data, offsets)
        hurt = np.zeros(len(starts), bool)
        if damage:
            sums = _checksums(data, starts, ends, prefixes[lo + own])
            hurt = sums % np.uint32(damage) == 0
            words = []
            for s, e, h in zip(starts[hurt].tolist(), ends[hurt].tolist(), sums[hurt].tolist(), strict=True):
                word = data[s:e].tobytes().decode()
                at = h % len(word)
                words.append(word[:at] + word[at + 1 :])
            counted = Counter(w for w in words if len(w) >= least)
            yield list(counted), list(counted.values())
        wide = np.concatenate([[0], np.cumsum(data == 0xC3)])
        kept = ~hurt & (ends - starts - (wide[ends] - wide[starts]) >= least)
        starts, ends = starts[kept], ends[kept]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1
        flat = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        array = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(flat))
        counts = pc.value_counts(array)
        yield counts.field(0).to_pylist(), counts.field(1).to_pylist()


def words(docs: DataFrame, doc: str = "doc_id", text: str = "text", damage: int = DAMAGE, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts and their places. Where ``damage`` divides the CRC-32 of ``id:word``, the word has
    lost one letter, told by that number; 0 damages none."""
    rows = docs.select(F.col(f"`{doc}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], ["word", "n"])
        met: Counter[str] = Counter()
        for b in batches:
            for found, n in _met(b.column("text"), b.column("id").to_pylist(), damage, min_chars):
                met.update(dict(zip(found, n, strict=True)))
                if len(met) >= HELD:
                    yield told()
                    met.clear()
        yield told()

    counted = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


class WaveletTree:
    """Values 0 to n - 1, each once, which are at the places of a range and inside a range of values."""

    def __init__(self, values: np.ndarray):
        self.bits = max(0, int(len(values) - 1).bit_length())
        self.zeros = []
        for k in range(self.bits - 1, -1, -1):
            one = (values >> k) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, first: np.ndarray, last: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the question, value): half-open ranges of places and of values."""
        q = np.flatnonzero((first < last) & (least < most))
        first, last, base = first[q], last[q], np.zeros(len(q), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - level - 1)
            a, b = zeros[first], zeros[last]
            q = np.concatenate([q, q])
            first, last = np.concatenate([a, zeros[-1] + first - a]), np.concatenate([b, zeros[-1] + last - b])
            base = np.concatenate([base, base + half])
            kept = (first < last) & (base < most[q]) & (base + half > least[q])
            q, first, last, base = q[kept], first[kept], last[kept], base[kept]
        kept = (base >= least[q]) & (base < most[q])
        return q[kept], base[kept]


class _Order:
    """Words of length L of all buckets, sorted bucket by bucket, and intervals of those that begin alike."""

    HEAD = 5  # bytes that number the bucket, none of them zero

    def __init__(self, letters: np.ndarray, bucket: np.ndarray, whole: np.ndarray):
        head = np.stack([(bucket >> (7 * k)) & 127 for k in range(self.HEAD - 1, -1, -1)], 1).astype(np.uint8) + 1
        self.rows = np.ascontiguousarray(np.concatenate([head, letters], 1))
        self.kind = f"S{self.rows.shape[1]}"
        keys = self.rows.view(self.kind).ravel()
        points = np.flatnonzero(whole)
        order = np.argsort(keys[points], kind="stable")
        self.points, self.sorted = points[order], keys[points][order]
        self.place = np.empty(len(whole), np.int64)
        self.place[self.points] = np.arange(len(points))
        at = np.searchsorted(self.sorted, keys)
        self.common = np.full(len(whole), -1)
        if len(points):
            for near in (at - 1, np.where(whole, at + 1, at)):  # the neighbours of the word among the points
                there = (near >= 0) & (near < len(points))
                own, theirs = self.rows[there], self.rows[self.points[near[there]]]
                differ = np.concatenate([own != theirs, np.ones((len(own), 1), bool)], 1).argmax(1)
                self.common[there] = np.maximum(self.common[there], differ - self.HEAD)

    def interval(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.rows[rows]
        behind = np.arange(own.shape[1]) >= self.HEAD + length[:, None]
        own[behind] = 0
        first = np.searchsorted(self.sorted, own.view(self.kind).ravel(), "left")
        own[behind] = 255
        return first, np.searchsorted(self.sorted, own.view(self.kind).ravel(), "right")


def near(texts: list[bytes], bucket: np.ndarray, whole: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs (row, row) of near words whose edit position is one of the bucket's, from ``first`` to before ``last``.

    texts: words in Latin-1; whole: the word has the class's length, else it is one shorter.
    """
    size = np.array([len(t) for t in texts])
    length = size + ~whole
    width = int(length.max())
    letters = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width)
    back = np.frombuffer(b"".join(t[::-1].ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width)
    forward, backward = _Order(letters, bucket, whole), _Order(back, bucket, whole)
    tree = WaveletTree(backward.place[forward.points])
    low, high = np.maximum(first, length - 1 - backward.common), np.minimum(last - 1, forward.common)
    n = np.where((forward.common >= 0) & (backward.common >= 0), np.maximum(0, high - low + 1), 0)
    rows = np.repeat(np.arange(len(texts)), n)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + low[rows]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, SEARCH // (width + _Order.HEAD))
    for k in range(0, len(rows), step):
        row, p = rows[k : k + step], places[k : k + step]
        q, value = tree.report(*forward.interval(row, p), *backward.interval(row, length[row] - 1 - p))
        a, b, p = row[q], backward.points[value], p[q]
        inserted = ~whole[a] & ((p == 0) | (letters[b, p] != letters[b, np.maximum(p - 1, 0)]))
        replaced = whole[a] & (a != b)
        found += [(a[replaced], b[replaced]), (a[inserted], b[inserted]), (b[inserted], a[inserted])]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _best(texts: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the words on the left of pairs: the most frequent one on the right, of equally frequent ones the least."""
    rank = np.empty(len(texts), np.int64)
    rank[np.argsort(np.array(texts, object), kind="stable")] = np.arange(len(texts))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(a)))
    word = lambda rows: pa.array([texts[i].decode("latin-1") for i in rows.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([word(a[begin]), pa.array(count, pa.int64()), pa.array(n[b[begin]], pa.int64()), word(b[begin])], ["word", "n_near", "best_n", "best"])


def _dealt(vocabulary: DataFrame) -> DataFrame:
    """(key, word, n, whole, first, last): the words in buckets, each for a range of edit positions of a class."""
    size = F.char_length("word")
    classes = F.array(F.struct(F.lit(True).alias("whole"), size.alias("size")), F.struct(F.lit(False).alias("whole"), (size + 1).alias("size")))
    rows = vocabulary.select("word", "n", F.explode(classes).alias("c")).select("word", "n", "c.whole", "c.size", F.lit(0).alias("first"), F.col("c.size").alias("last"))

    def halved(rows: DataFrame) -> DataFrame:
        middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        ranges = F.array(F.struct("first", middle.alias("last")), F.struct(middle.alias("first"), "last"))
        out = rows.select("word", "n", "whole", "size", F.explode(ranges).alias("r")).select("word", "n", "whole", "size", "r.first", "r.last")
        behind = F.substr("word", F.col("last") + F.col("whole").cast("int"))
        return out.withColumn("key", F.concat_ws(" ", "size", "first", "last", F.substr("word", F.lit(1), F.col("first")), behind))

    done = []
    rows = halved(rows)
    while True:
        rows = materialize(rows, "buckets")
        large = rows.groupBy("key", "first", "last").agg(F.sum(size).alias("letters")).where((F.col("letters") > BUCKET) & (F.col("last") - F.col("first") > 1))
        large = materialize(large.select("key"), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        done.append(rows.join(large, "key", "left_anti"))
        rows = halved(rows.join(large, "key", "left_semi").drop("key"))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have near words: their number, and the most frequent of them."""
    rows = _dealt(vocabulary).select("key", "word", "n", "whole", "first", "last")

    def compared(table: pa.Table) -> pa.RecordBatch:
        keys = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        own = np.bincount(keys)[keys] > 1
        texts = [w.encode("latin-1") for w, kept in zip(table.column("word").to_pylist(), own.tolist(), strict=True) if kept]
        bucket, n, whole, first, last = keys[own].astype(np.int64), *(table.column(c).to_numpy()[own] for c in ("n", "whole", "first", "last"))
        if not texts:
            return _best([], n, np.zeros(0, np.int64), np.zeros(0, np.int64))
        return _best(texts, n, *near(texts, bucket, whole.astype(bool), first.astype(np.int64), last.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        letters = 0
        for b in batches:
            held.append(b)
            letters += pc.sum(pc.binary_length(b.column("word"))).as_py() or 0
            if letters >= GO:
                table = pa.Table.from_batches(held)
                keys = table.column("key").combine_chunks()
                ends = pc.index(pc.equal(keys, keys[-1]), True).as_py()  # the last bucket may go on
                if ends:
                    yield compared(table.slice(0, ends))
                    held = table.slice(ends).to_batches()
                    letters = pc.sum(pc.binary_length(table.column("word").slice(ends))).as_py() or 0
        if held:
            yield compared(pa.Table.from_batches(held))

    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("x")).select("word", "n_near", (-F.col("x.minus")).alias("best_n"), "x.best")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain. Each round doubles the way that is gone; chains hold no circle."""
    now = materialize(links.select("word", F.col("form").alias("root")), "links")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "links")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def report(docs: DataFrame, doc: str = "doc_id", text: str = "text", damage: int = DAMAGE, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word: the form is the near word met most often, if ``times`` as often at least."""
    vocabulary = materialize(words(docs, doc, text, damage, min_chars, min_count), "words")
    told = vocabulary.join(neighbours(vocabulary), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    told = materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    found = told.join(roots(told.where("form is not null").select("word", "form")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

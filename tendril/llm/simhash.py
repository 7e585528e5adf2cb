"""SimHash near-duplicate detection by tiled exact comparison.

A fingerprint has a bit set if more than half of the hashes (XXH64, seed 42) of the text's word shingles have it set,
repeats included. Two fingerprints are linked if they differ in ``radius`` bits or fewer; links are exact and complete.

Comparison: equal fingerprints are one (so a group of exact copies is one row). Fingerprints within the radius agree in
at least one of radius + 1 bit ranges, which deals them into buckets without losing a pair. The rows of a bucket, in the
order of their population counts, are cut into tiles; two tiles are compared by numpy exclusive-or and bit counts, and
skipped if their population counts differ by more than the radius. A bucket of more than ``bucket_rows`` rows is dealt
into parts, and every two parts are compared in a task of their own. Out of a bucket comes a forest that joins what is
linked, at most one edge a row, never all pairs.

Defined results: a text of fewer words than a shingle is one shingle; a null or wordless text has fingerprint zero and is
linked like any other; a null id keeps its fingerprint, takes part in no minimum, and gets the component's least id, or
null.

``keep_near`` links texts by the share of their shingle sets, which lies far beyond three bits. Ranges of a radius that wide
hold too few bits to part a large corpus, so it deals the sets by keys of least hashes instead, compares fingerprints in
tiles inside these buckets, and then the sets of what lies within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .arrow_text import LOWER_SPACED, blocks, mix
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: ``keep_near``: shingles, the share of two texts' shingles that makes them near copies, and how far apart these may lie.
NEAR_SHINGLE, NEAR_SHARE, NEAR_RADIUS = 5, 0.8, 18
#: ``keep_near`` deals sets by ``BANDS`` keys of ``BAND_ROWS`` least hashes each.
BANDS, BAND_ROWS, NEAR_BUCKET_ROWS = 16, 4, 4000
TILE, BUCKET_ROWS = 256, 20_000


def _shingles(data: np.ndarray, off: np.ndarray, shingle: int) -> tuple[list[bytes], np.ndarray]:
    """The hashes of all texts' word shingles, repeats included, and how many each text has."""
    raw = LOWER_SPACED[data].tobytes()
    n = len(off) - 1
    digest = xxhash.xxh64_digest
    hashes: list[bytes] = []
    counts = np.zeros(n, np.int64)
    for k in range(n):
        words = raw[off[k] : off[k + 1]].split()
        if not words:
            continue
        line = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda at, size: at + 1 + size))
        starts = [0, *(e + 1 for e in ends[:-1])]
        before = len(hashes)
        hashes += [digest(line[s:e], SEED) for s, e in zip(starts, ends[min(shingle, len(words)) - 1 :], strict=False)]
        counts[k] = len(hashes) - before
    return hashes, counts


def _fingerprints(data: np.ndarray, off: np.ndarray, shingle: int) -> np.ndarray:
    return _signed(*_shingles(data, off, shingle))


def _signed(hashes: list[bytes], counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
        at = np.cumsum(counts[some]) - counts[some]
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1).view(">u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(row, fp): the document as a struct and its fingerprint, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_fingerprints(data, off, shingle) for _, _, data, off in blocks(b.column(1))]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["row", "fp"])

    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*others).alias("row"), F.col(text).alias("text"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, fp long")


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the sets of a[i] and b[i]; root[x] is the least member of the set of x."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        parent = np.arange(len(root))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
        root = parent[root]


def linked(keys: np.ndarray, parts: np.ndarray, crossing: np.ndarray, fp: np.ndarray, radius: int, tile: int = TILE) -> np.ndarray:
    """For each row the least row that it is joined with inside its group of equal keys.

    keys are in ascending order. Where crossing, only rows of different parts are compared.
    """
    pop = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((pop, keys))
    keys, parts, crossing, fp, pop = keys[order], parts[order], crossing[order], fp[order], pop[order]
    n = len(fp)
    root = np.arange(n)
    starts = np.arange(0, n, tile)
    for s in starts.tolist():
        e = min(s + tile, n)
        for t in range(s, n, tile):
            u = min(t + tile, n)
            if keys[t] > keys[e - 1]:
                break
            alone = keys[s] == keys[u - 1]  # both tiles lie in one group, so in the order of the counts
            if alone and pop[t] - pop[e - 1] > radius:
                break
            near = np.bitwise_count(fp[s:e, None] ^ fp[None, t:u]) <= radius
            i, j = np.nonzero(near)
            i, j = i + s, j + t
            good = (i < j) & (keys[i] == keys[j]) & (~crossing[i] | (parts[i] != parts[j]))
            root = _hook(root, i[good], j[good])
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _ranges(radius: int) -> tuple[list[int], list[int]]:
    """Widths and shifts of radius + 1 bit ranges."""
    widths = [64 // (radius + 1) + (k < 64 % (radius + 1)) for k in range(radius + 1)]
    return widths, [sum(widths[:k]) for k in range(radius + 1)]


def links(prints: DataFrame, fp: str = "fp", radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): edges that join all fingerprints within the radius, at most one for each row of a bucket."""
    widths, shifts = _ranges(radius)
    ranges = [F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("v")) for k, (s, w) in enumerate(zip(shifts, widths, strict=True))]
    distinct = prints.select(F.col(fp).alias("fp")).distinct()
    dealt = distinct.select("fp", F.explode(F.array(*ranges)).alias("bucket")).select("fp", "bucket.k", "bucket.v")
    full = dealt.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    rows = dealt.join(full, ["k", "v"]).withColumn("parts", F.ceil(F.col("n") / bucket_rows).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other).select("k", "v", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(block: np.ndarray) -> pa.RecordBatch:
            key = block[:, :4]
            new = np.ones(len(block), bool)
            new[1:] = (key[1:] != key[:-1]).any(1)
            fp = block[:, 5].view(np.uint64)
            to = linked(np.cumsum(new), block[:, 4], block[:, 2] != block[:, 3], fp, radius)
            own = np.flatnonzero(to != np.arange(len(to)))
            return pa.RecordBatch.from_arrays([pa.array(block[own, 5]), pa.array(block[to[own], 5])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1))
            last = held[-1][-1, :4]
            if (held[0][0, :4] != last).any():  # groups that are whole by now; the last one goes on
                block = np.ascontiguousarray(np.concatenate(held))
                cut = len(block) - int((block[:, :4] == last).all(1).sum())
                held = [block[cut:]]
                yield edges(np.ascontiguousarray(block[:cut]))
        if held:
            yield edges(np.ascontiguousarray(np.concatenate(held)))

    key = ["k", "v", "p", "q"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def _placed(prints: DataFrame, doc: str, fp: str, radius: int) -> DataFrame:
    """(fp, least, component) of all fingerprints; least: the least id of its documents, component: its least fingerprint."""
    nodes = prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc).alias("least"))
    found = components(links(nodes, "fp", radius)).withColumnRenamed("node", "fp")
    placed = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return materialize(placed, "components")


def group(prints: DataFrame, doc: str = "doc_id", fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) of all fingerprints; component_id: the least document id reachable."""
    placed = _placed(prints, doc, fp, radius)
    return placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")


def report(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each document."""
    prints = fingerprints(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), "text", shingle)
    prints = materialize(prints.select("row.doc_id", "fp"), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(group(prints, radius=radius), "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents without those that are linked, over any number of steps, with one of a lesser id; rows that repeat an
    id or have none as in ``keep_near``."""
    named, own = _named(docs, doc, text)
    prints = fingerprints(named.select(F.col(doc).alias("id"), F.col(text).alias("text"), F.col(own[0]).alias("t"), F.col(own[1]).alias("r")), "text", shingle)
    prints = materialize(prints.select("row.id", "row.t", "row.r", "fp"), "fingerprints")
    placed = prints.join(_placed(prints, "id", "fp", radius).select("fp", "component"), "fp")
    return _with_least(docs, named, own, placed.groupBy("component").agg(F.min(F.struct("id", "t", "r")).alias("least")), doc)


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches in the order of the key."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in key], 1)
        own = np.flatnonzero((keys != keys[-1]).any(1))
        cut = int(own[-1]) + 1 if len(own) else 0  # rows before the batch's last group
        if held and (cut or (keys[0] != last).any()):
            whole = cut if (keys[-1] != last).any() else 0
            yield pa.Table.from_batches([*held, b.slice(0, whole)])
            held, b = [], b.slice(whole)
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
            b = b.slice(cut)
        held.append(b)
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def _group_numbers(t: pa.Table, key: list[str]) -> np.ndarray:
    keys = np.stack([t.column(c).to_numpy() for c in key], 1)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(1)
    return np.cumsum(new)


def _met_before(bands: np.ndarray, k: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j agree in a band before the k-th, so that another bucket compares them."""
    out = np.zeros(len(i), bool)
    left = np.arange(len(i))
    for band in range(bands.shape[1]):
        left = left[k[left] > band]
        if not len(left):
            break
        same = bands[i[left], band] == bands[j[left], band]
        out[left[same]] = True
        left = left[~same]
    return out


def partnered(keys: np.ndarray, k: np.ndarray, parts: np.ndarray, crossing: np.ndarray, fp: np.ndarray, sizes: np.ndarray, bands: np.ndarray, radius: int, share: float, tile: int = TILE) -> np.ndarray:
    """Whether a row lies within the radius of another of its group whose size allows the share.

    keys are in ascending order. A pair counts in the first band it agrees in; ``k`` says which one the group is of.
    """
    pop = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((pop, keys))
    keys, k, parts, crossing, fp, sizes, bands, pop = (x[order] for x in (keys, k, parts, crossing, fp, sizes, bands, pop))
    n = len(fp)
    met = np.zeros(n, bool)
    for s in range(0, n, tile):
        e = min(s + tile, n)
        for t in range(s, n, tile):
            u = min(t + tile, n)
            if keys[t] > keys[e - 1]:
                break
            if keys[s] == keys[u - 1] and pop[t] - pop[e - 1] > radius:
                break
            if met[s:e].all() and met[t:u].all():
                continue
            i, j = np.nonzero(np.bitwise_count(fp[s:e, None] ^ fp[None, t:u]) <= radius)
            i, j = i + s, j + t
            good = (i < j) & (keys[i] == keys[j]) & ~(met[i] & met[j]) & (~crossing[i] | (parts[i] != parts[j]))
            good &= np.minimum(sizes[i], sizes[j]) >= share * np.maximum(sizes[i], sizes[j]) - 1e-9
            i, j = i[good], j[good]
            own = ~_met_before(bands, k[i], i, j)
            met[i[own]] = met[j[own]] = True
    out = np.empty(n, bool)
    out[order] = met
    return out


def alike(fp: np.ndarray, k: int, bands: np.ndarray, parts: np.ndarray, crossing: bool, values: np.ndarray, off: np.ndarray, radius: int, share: float, limit: int = 1 << 20) -> np.ndarray:
    """For each row of a group of the k-th band the number of a row it is joined with, by pairs within the radius that have
    the share of their sets in common and meet in this band first; row x has the set values[off[x]:off[x + 1]]."""
    n, sizes = len(fp), np.diff(off)
    label = np.arange(n)
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    for at, i in enumerate(order.tolist()):
        js = order[at + 1 : np.searchsorted(share * ordered - 1e-9, ordered[at], "right")]
        js = js[(label[js] != label[i]) & (np.bitwise_count(fp[js] ^ fp[i]) <= radius)]
        if crossing:
            js = js[parts[js] != parts[i]]
        js = js[~(bands[js, :k] == bands[i, :k]).any(1)]
        own = values[off[i] : off[i + 1]]
        step = max(1, limit // max(1, int(sizes[js].max()) if len(js) else 1))
        for lo in range(0, len(js), step):
            some = js[lo : lo + step]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            ends = np.cumsum(sizes[some])
            theirs = values[np.repeat(off[some] - ends + sizes[some], sizes[some]) + np.arange(ends[-1])]
            place = np.minimum(np.searchsorted(own, theirs), max(0, len(own) - 1))
            hits = np.concatenate([[0], np.cumsum(own[place] == theirs)]) if len(own) else np.zeros(ends[-1] + 1, np.int64)
            both = hits[ends] - hits[ends - sizes[some]]
            near = both >= share * (sizes[i] + sizes[some] - both) - 1e-9
            if near.any():
                label[np.isin(label, label[some[near]])] = label[i]
    return label


_ODD = np.random.default_rng(SEED).integers(1 << 63, size=BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, BANDS): for each band a hash of its least hashes; sets with a share of 0.8 agree in one of the bands with
    1 - (1 - 0.8 ** 4) ** 16 = 0.9998."""
    out = np.zeros((len(counts), BANDS), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        at = (np.cumsum(counts) - counts)[some]
        for x, odd in enumerate(_ODD):
            out[some, x // BAND_ROWS] = mix(out[some, x // BAND_ROWS] + np.minimum.reduceat(hashes * odd, at))
    return out


def shingle_sets(docs: DataFrame, text: str, shingle: int, whole: bool) -> DataFrame:
    """(row, s, fp, size, bands) or, if whole, (row, s, shingles): the document as a struct, a hash of its set of shingles,
    its fingerprint, the set's size and the keys of its bands, or its hashes in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in blocks(b.column(1)):
                hashes, counts = _shingles(data, off, shingle)
                flat = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64)
                sets = [np.unique(x) for x in np.split(flat, np.cumsum(counts)[:-1])]
                size = np.array([len(x) for x in sets], np.int32)
                columns = [b.column(0).slice(lo, hi - lo), pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64))]
                if whole:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64))))
                else:
                    keys = band_keys(flat, counts).view(np.int64)
                    columns += [pa.array(_signed(hashes, counts).view(np.int64)), pa.array(size), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "s", "shingles"] if whole else ["row", "s", "fp", "size", "bands"])

    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*others).alias("row"), F.col(text).alias("text"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, s long, " + ("shingles array<long>" if whole else "fp long, size int, bands array<long>"))


def _bands_of(t: pa.Table) -> np.ndarray:
    return t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)


def near_links(texts: DataFrame, nodes: DataFrame, shingle: int = NEAR_SHINGLE, share: float = NEAR_SHARE, radius: int = NEAR_RADIUS, bucket_rows: int = NEAR_BUCKET_ROWS) -> DataFrame:
    """(a, b): edges that join all shingle sets within the radius that have the share in common and agree in a band.

    texts: (t, text); nodes: (s, fp, size, bands, t), where t names a text with the shingle set s. Sets are cut for those
    rows alone that have a partner within the radius; a pair is compared in the bucket of the first band it agrees in.
    """
    dealt = nodes.where("size > 0").select("s", F.posexplode("bands").alias("k", "v"))
    # Written, so that the join shuffles two tables and Spark can split a hot bucket's rows. What a bucket's rows need besides
    # their keys is joined to the few that share one.
    full = materialize(dealt.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    rows = dealt.join(full, ["k", "v"]).join(nodes.select("s", "fp", "size", "t", "bands"), "s").withColumn("parts", F.ceil(F.col("n") / bucket_rows).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("s", F.lit(7)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("k", "v", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "s", "fp", "size", "t", "bands")
    key = ["k", "v", "p", "q"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, key):
            of = {c: t.column(c).to_numpy() for c in t.column_names if c != "bands"}
            met = partnered(_group_numbers(t, key), of["k"], of["part"], of["p"] != of["q"], of["fp"].view(np.uint64), of["size"], _bands_of(t), radius, share)
            yield from t.filter(pa.array(met)).drop_columns(["size"]).combine_chunks().to_batches()

    schema = "k int, v long, p int, q int, part int, s long, fp long, t long, bands array<long>"
    met = rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(meet, schema)
    met = materialize(met, "partnered")
    sets = texts.join(met.select("t").distinct(), "t").dropDuplicates(["t"])
    sets = materialize(shingle_sets(sets, "text", shingle, True).select("s", "shingles").dropDuplicates(["s"]), "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, key):
            t = t.combine_chunks()
            number = _group_numbers(t, key)
            of = {c: t.column(c).to_numpy() for c in t.column_names if c not in ("shingles", "bands")}
            bands = _bands_of(t)
            lists = t.column("shingles").combine_chunks()
            off = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(number)], strict=True):
                label = alike(of["fp"][lo:hi].view(np.uint64), int(of["k"][lo]), bands[lo:hi], of["part"][lo:hi], of["p"][lo] != of["q"][lo], values, off[lo : hi + 1], radius, share)
                own = np.flatnonzero(label != np.arange(hi - lo))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(of["s"][lo + own]), pa.array(of["s"][lo + label[own]])], ["a", "b"])

    return met.drop("t").join(sets, "s").select(*key, "part", "s", "fp", "bands", "shingles").repartition(*key).sortWithinPartitions(*key).mapInArrow(verify, "a long, b long")


def _named(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, list[str]]:
    """The documents with an id and, under names of their own, a hash of the text and one of the whole row."""
    own = ["t", "r"]
    while set(own) & set(docs.columns):
        own = [f"_{c}" for c in own]
    named = docs.where(F.col(doc).isNotNull())
    return named.withColumns({own[0]: F.xxhash64(text), own[1]: F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])}), own


def _with_least(docs: DataFrame, named: DataFrame, own: list[str], least: DataFrame, doc: str) -> DataFrame:
    """The rows that ``least`` (least: struct<id, t, r>) names, of equal ones one, and the rows without an id."""
    reps = least.select(F.col("least.id").alias(doc), F.col("least.t").alias(own[0]), F.col("least.r").alias(own[1]))
    kept = named.join(reps, [doc, *own], "left_semi").dropDuplicates([doc, *own])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(doc).isNull()))


def keep_near(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = NEAR_SHINGLE, share: float = NEAR_SHARE, radius: int = NEAR_RADIUS, bucket_rows: int = NEAR_BUCKET_ROWS) -> DataFrame:
    """The documents without near copies of one of a lesser id, over any number of steps.

    Near copies have ``share`` of their sets of shingles in common (Jaccard) and fingerprints within the radius; texts with
    one set of shingles always are. Of a group one row stays: that of the least id, then of the least hash of its text, then
    of its row. Rows that repeat an id with texts that are no near copies all stay; rows without an id stay.
    """
    named, own = _named(docs, doc, text)
    short = named.select(F.col(doc).alias("id"), F.col(text).alias("text"), F.col(own[0]).alias("t"), F.col(own[1]).alias("r"))
    prints = materialize(shingle_sets(short, "text", shingle, False).select("row.id", "row.t", "row.r", "s", "fp", "size", "bands"), "fingerprints")
    nodes = prints.groupBy("s").agg(F.min(F.struct("id", "t", "r")).alias("least"), F.min(F.struct("fp", "t", "size", "bands")).alias("x"))
    nodes = materialize(nodes.select("s", "least", "x.*"), "nodes")
    found = components(near_links(short.select("t", "text"), nodes, shingle, share, radius, bucket_rows)).withColumnRenamed("node", "s")
    placed = nodes.select("s", "least").join(found, "s", "left").withColumn("component", F.coalesce("component", "s"))
    return _with_least(docs, named, own, placed.groupBy("component").agg(F.min("least").alias("least")), doc)

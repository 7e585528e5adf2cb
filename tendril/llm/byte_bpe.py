"""Byte-level byte-pair encoding with a file of ranks, whose merges Spark's higher-order functions fold, and decoding.

While it is merged, a piece is a string with one character for each token: the character of token t is U+1000 + t, behind
the surrogates where it would meet them. It begins as the characters of its single bytes. Since UTF-8 keeps the order of
code points, the pair to merge next is the one with the least merged character. The ranks are a map from two neighbouring
characters to the merged one, a literal row that reaches the tasks with the plan; Spark scans a map from its front, so it is
held as many small maps, chosen by the CRC of the key.

A piece that is a token is that token. Any other is folded: each step finds the least merged character of all neighbours and
replaces its leftmost pair. Where that pair stands several times, all its places are replaced at once if no pair that this
makes, on the way or at the end, comes earlier in rank, and no other pair has the same rank; then one step does what as many
single ones would. So a run of one character takes as many steps as its length has bits.

Words are counted over all texts. The pieces of the most frequent, at most SENT of up to LONGEST characters, are encoded once each, as
distinct words, and sent as a map, which these two numbers bound. What is not in it is folded where it stands, by the same
expression. No text is shuffled, only counts of pieces.

The texts themselves are parted into pieces in Arrow batches, where sent pieces are told at once and the rest is handed to
Spark's functions, text by text. Decoding concatenates the byte strings of the tokens.

Defined results: a null text is encoded as an empty one, without tokens, and a null list of ids is decoded as an empty one. Letters, numbers and white space are those of Unicode 16.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialize
from . import classes
from .arrow_text import blocks

#: The first token's character; the characters that are no code points; the last of all, which no token has.
FIRST, SURROGATES, NONE = 0x1000, (0xD800, 0xE000), "\U0010ffff"
#: Entries of one small map, about.
SMALL = 4
#: Pieces that are sent at most; characters of the longest of them.
SENT, LONGEST = 1_000_000, 32
#: Pieces that one task folds.
FOLDED = 8192
#: Bytes of the longest word that is looked into for pieces to be sent, and of texts whose words are counted at once.
LONGEST_WORD, COUNTED = 1 << 10, 1 << 23


def char(token: int) -> str:
    at = token + FIRST
    return chr(at if at < SURROGATES[0] else at + SURROGATES[1] - SURROGATES[0])


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of fixed size, read by the driver."""
    with open(path, "rb") as f:
        found = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if any(bytes([b]) not in found for b in range(256)):
        raise ValueError("every byte must have a rank")
    return found


def _bucket(key: Column, size: int) -> Column:
    return F.crc32(key.cast("binary")).bitwiseAND(F.lit(size - 1))


def _look(maps: Column, size: int, key: Column) -> Column:
    """The value of a key in an array of small maps; null if there is none."""
    return F.get(maps, _bucket(key, size))[key]


def _size(entries: int) -> int:
    """Small maps for so many entries: a power of two."""
    return 1 << (entries // SMALL).bit_length()


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed and held once."""
    return F.element_at(F.transform(F.array(value), use), 1)


class Ranks:
    """What a rank file says: one row of tables, and expressions that use them."""

    def __init__(self, spark: SparkSession, path: str):
        ranks = read_ranks(path)
        self.most = max(ranks.values())
        self.bytes = "".join(char(ranks[bytes([b])]) for b in range(256))
        pairs = {}
        for token, merged in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[char(left) + char(right)] = char(merged)
        tokens = {token.decode("latin-1"): char(r) for token, r in ranks.items()}
        self.n_pairs, self.n_tokens = _size(len(pairs)), _size(len(tokens))
        row = (self._maps(pairs, self.n_pairs), self._maps(tokens, self.n_tokens))
        self.row = spark.createDataFrame([row], "pairs array<map<string,string>>, tokens array<map<string,string>>").select(F.struct("pairs", "tokens").alias("_ranks"))

    @staticmethod
    def _maps(entries: dict[str, str], size: int) -> list[dict[str, str]]:
        out: list[dict[str, str]] = [{} for _ in range(size)]
        for k, v in entries.items():
            out[zlib.crc32(k.encode()) & (size - 1)][k] = v
        return out

    def beside(self, rows: DataFrame) -> DataFrame:
        """The rows with the ranks in a column ``_ranks``: a scalar subquery, whose one value reaches the tasks with the plan."""
        return rows.withColumn("_ranks", self.row.scalar())

    def ids(self, pieces: Column) -> Column:
        """array<array<int>>: the tokens of each piece, by the column ``_ranks``."""
        return _bound(F.col("_ranks"), lambda t: F.transform(pieces, lambda p: _ids(self.encoded(p, t))))

    def encoded(self, piece: Column, tables: Column) -> Column:
        """The characters of a piece's tokens."""
        begun = lambda raw: F.translate(raw, "".join(map(chr, range(256))), self.bytes)
        found = lambda raw: F.coalesce(_look(tables["tokens"], self.n_tokens, raw), self._folded(begun(raw), tables["pairs"]))
        return _bound(F.decode(piece.cast("binary"), "ISO-8859-1"), found)

    def _merged(self, pairs: Column, key: Column) -> Column:
        return F.coalesce(_look(pairs, self.n_pairs, key), F.lit(NONE))

    def _state(self, text: Column, pairs: Column) -> Column:
        """(s, every, z): the text, the merged characters of all neighbours, and the least of them."""
        every = lambda s: _bound(F.split(s, ""), lambda a: F.transform(a, lambda x, i: self._merged(pairs, F.concat(x, F.get(a, i + 1)))))
        return _bound(text, lambda s: _bound(every(s), lambda e: F.struct(s.alias("s"), F.array_join(e, "").alias("every"), F.array_min(e).alias("z"))))

    def _one(self, state: Column, at: Column, pairs: Column) -> Column:
        """The pair at that place is merged; only its two neighbours are looked up again."""
        s, every, z = state["s"], state["every"], state["z"]
        before = F.when(at > 1, self._merged(pairs, F.concat(F.substr(s, at - 1, F.lit(1)), z))).otherwise("")
        behind = self._merged(pairs, F.concat(z, F.substr(s, at + 2, F.lit(1))))
        merged = F.concat(F.substr(every, F.lit(1), at - 2), before, behind, F.substr(every, at + 2))
        text = F.concat(F.substr(s, F.lit(1), at - 1), z, F.substr(s, at + 2))
        return _bound(merged, lambda e: F.struct(text.alias("s"), e.alias("every"), F.array_min(F.split(e, "")).alias("z")))

    def _several(self, state: Column, at: Column, one: Column, pairs: Column) -> Column:
        """All places of the pair at once, if all have the same pair, and neither what the merges leave nor a merged
        character with the next place's left one, which stand side by side between two merges, comes earlier."""
        s, z = state["s"], state["z"]
        every = F.split(state["every"], "")
        same = lambda xy: F.forall(F.transform(every, lambda q, i: (q != z) | (F.substr(s, i + 1, F.lit(2)) == xy)), lambda ok: ok)
        between = lambda xy: self._merged(pairs, F.concat(z, F.left(xy, F.lit(1)))) >= z
        checked = lambda t: F.when(t["z"] >= z, t).otherwise(one)
        replaced = lambda xy: _bound(self._state(F.replace(s, xy, z), pairs), checked)
        return _bound(F.substr(s, at, F.lit(2)), lambda xy: F.when(between(xy) & same(xy), replaced(xy)).otherwise(one))

    def _folded(self, begun: Column, pairs: Column) -> Column:
        def merge(state: Column, at: Column) -> Column:
            s, z = state["s"], state["z"]
            one = self._one(state, at, pairs)
            return F.when(F.position(z, state["every"], at + 1) == 0, one).otherwise(self._several(state, at, one, pairs))

        step = lambda state, _: F.when(state["z"] == NONE, state).otherwise(_bound(F.position(state["z"], state["every"]), lambda at: merge(state, at)))
        fold = lambda s: F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(s) - 1, F.lit(1))), self._state(s, pairs), step, lambda x: x["s"])
        return _bound(begun, fold)


def _ids(chars: Column) -> Column:
    at = lambda c: F.ascii(c) - F.when(F.ascii(c) >= SURROGATES[1], FIRST + SURROGATES[1] - SURROGATES[0]).otherwise(FIRST)
    return _bound(chars, lambda s: F.when(s == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(s, ""), at)))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    for lo, hi, data, off in blocks(column):
        raw = data.tobytes()
        yield lo, hi, [raw[s:e].decode() for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def _pieces(text: str, pattern: str) -> list[str]:
    return classes.finder(pattern, classes.is_latin(text)).findall(text)


def count_pieces(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(piece, n): the pieces of all texts that are met more than once, about. Words between spaces are counted, and what the
    pattern makes of a distinct word behind a space counts as often; so pieces that hold several spaces, or begin a text, are
    counted otherwise."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, size = b.column(0), pc.binary_length(b.column(0)).fill_null(0).to_numpy()
            ends = np.unique(np.append(np.flatnonzero(np.diff(np.cumsum(size) // COUNTED)) + 1, len(texts)))
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                words = pc.split_pattern(texts.slice(lo, hi - lo), " ").flatten()
                found = pc.value_counts(words.filter(pc.less_equal(pc.binary_length(words), LONGEST_WORD)))
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])
        pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_pieces(f" {w}", pattern) for w in b.column("word").to_pylist()]
            own = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array([p for x in found for p in x], pa.string()), b.column("n").take(pa.array(own))], ["piece", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    words = rows.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return words.mapInArrow(run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, ranks: Ranks, pattern: str, text: str = "text") -> DataFrame:
    """(piece, ids): the most frequent pieces, those met at least as often as the least count, on a scale of quarter powers
    of two, that no more than SENT of them reach."""
    met = count_pieces(docs, pattern, text)
    met = materialize(met.where((F.col("n") > 1) & (F.char_length("piece") <= LONGEST)), "pieces")
    reach, least, kept = 0, None, 0
    for r in met.groupBy(F.floor(F.log2("n") * 4).alias("level")).agg(F.count("*").alias("n"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():
        reach += r.n
        if reach > SENT:
            break
        least, kept = r.least, reach
    often = met.where(F.col("n") >= least) if least else met.where("false")
    often = often.repartition(1 + kept // FOLDED)
    return materialize(ranks.beside(often).select("piece", F.element_at(ranks.ids(F.array("piece")), 1).alias("ids")), "vocabulary")


class _Known(dict):
    """The ids of known pieces as bytes, two for each where that is enough; the largest number stands for a piece that isn't
    known, and the numbers of a text's distinct unknown pieces are kept in order."""

    def __init__(self, sent: bytes, kind: str):
        super().__init__()
        self.kind, self.hole = np.dtype(kind), b"\xff" * np.dtype(kind).itemsize
        for b in pa.ipc.open_stream(sent):
            lists = b.column("ids")
            raw, ends = lists.values.to_numpy(zero_copy_only=False).astype(kind).tobytes(), (self.kind.itemsize * lists.offsets.to_numpy()).tolist()
            self.update(zip(b.column("piece").to_pylist(), map(raw.__getitem__, map(slice, ends[:-1], ends[1:])), strict=True))
        self.rare: dict[str, int] = {}
        self.which: list[int] = []

    def __missing__(self, piece: str) -> bytes:
        self.which.append(self.rare.setdefault(piece, len(self.rare)))
        return self.hole

    def encode(self, pieces: list[str]) -> tuple[bytes, list[str], list[int]]:
        """(ids, distinct unknown pieces, which of them stands at each hole)."""
        self.rare, self.which = {}, []
        return b"".join(map(self.__getitem__, pieces)), list(self.rare), self.which


#: The map that this worker has read last, by the name of what was sent.
_READ: dict[str, _Known] = {}


def _spliced(ids: np.ndarray, rare: list[np.ndarray], which: np.ndarray) -> np.ndarray:
    if not rare:
        return ids.astype(np.int32)
    sizes = np.array([len(x) for x in rare], np.int64)
    hole = ids == np.iinfo(ids.dtype).max
    n = np.ones(len(ids), np.int64)
    n[hole] = own = sizes[which]
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]), np.int32)
    out[ends[~hole] - 1] = ids[~hole]
    begin = np.cumsum(sizes) - sizes
    inside = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    out[np.repeat(ends[hole] - own, own) + inside] = np.concatenate(rare)[np.repeat(begin[which], own) + inside]
    return out


def _struct(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _encoded(docs: DataFrame, path: str, pattern: str, text: str, keep: bool = True) -> tuple[DataFrame, str]:
    """((row, ids, rare, which), kind of number): the document as a struct, on demand without its text, its ids as bytes with
    holes for rare pieces, the ids of its distinct rare pieces, and which of these stands at each hole."""
    ranks = Ranks(docs.sparkSession, path)
    kind = "<u2" if ranks.most < 0xFFFF else "<u4"
    sink = pa.BufferOutputStream()
    table = vocabulary(docs, ranks, pattern, text).toArrow()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table, max_chunksize=4096)
    sent, name = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    if not keep:
        packed = packed.withColumn("row", F.col("row").dropFields(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _READ:
            _READ.clear()
            _READ[name] = _Known(sent.value, kind)
        known = _READ[name]
        for b in batches:
            for lo, hi, texts in _texts(b.column(1)):
                ids, rare, which = zip(*(known.encode(_pieces(t, pattern)) for t in texts), strict=True)
                columns = [b.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.string())), pa.array(which, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "ids", "rare", "which"])
    found = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, ids binary, rare array<string>, which array<int>")
    # Written, so that no task holds two Python workers, one of them with the map.
    return materialize(ranks.beside(found).select("row", "ids", ranks.ids(F.col("rare")).alias("rare"), "which"), "encoded"), kind


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _parts(lists: pa.Array) -> Iterator[np.ndarray]:
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    return (flat[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


def _whole(b: pa.RecordBatch, kind: str) -> Iterator[np.ndarray]:
    rare = b.column("rare")
    inner, ends = list(_parts(rare.values)), rare.offsets.to_numpy().tolist()
    for k, (ids, which) in enumerate(zip(b.column("ids"), _parts(b.column("which")), strict=True)):
        yield _spliced(np.frombuffer(ids.as_buffer(), kind), inner[ends[k] : ends[k + 1]], which)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(row, ids): the document as a struct, and its token ids, array<int>."""
    found, kind = _encoded(docs, path, pattern, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), _lists(list(_whole(b, kind)))], ["row", "ids"])

    return found.mapInArrow(run, f"row {found.schema['row'].dataType.simpleString()}, ids array<int>")


def _names(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    names = [b""] * (1 + max(ranks.values()))
    for token, r in ranks.items():
        names[r] = token
    return names


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """(row, decoded): the row as a struct, and its tokens' byte strings one after another, binary."""
    sent, packed = encoded.sparkSession.sparkContext.broadcast(_names(path)), _struct(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b"".join(map(sent.value.__getitem__, x or ())) for x in b.column(0).field(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["row", "decoded"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""
    rows = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(_names(path))
    found, kind = _encoded(rows, path, pattern, "text", keep=False)
    found = found.select(F.col("row.doc_id").alias("doc_id"), "ids", "rare", "which")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        for b in batches:
            n, ids_sha, decoded_sha = [], [], []
            for ids in _whole(b, kind):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(b"".join(map(names.__getitem__, ids.tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

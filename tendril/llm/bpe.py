"""Byte-pair encoding with a vocabulary file, and decoding.

Encoding is a backtracking search: an Aho-Corasick automaton over all tokens gives the longest token at each place of a
word; a token is taken if it is compatible with the one before, that is, if the merges of both side by side would keep
their boundary; else the next shorter token is tried, and where none is left the last token is given up and its end is
marked as unreachable. Each place is marked once, so the work is linear, and the result is exactly that of the merges.
Compatibility comes from a table of token pairs, filled from the merges as pairs are met.

Decoding gathers slices of one byte string by an offset table.

Texts pass the vocabulary's normaliser (NFC, lower case; white space only parts words) and its split into words. The
strings of special tokens in a text are taken as these tokens, as the tokenizers library does by default.

Defined results: a null text is encoded as an empty one, without tokens; no token is ever unknown
(all 256 bytes are in the vocabulary). Extra columns pass through inside ``row``. All code points give the library's ids:
where its tables of letters, capitals and compositions are of other Unicode versions than Python's, the difference is fixed here.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classes
from .arrow_text import blocks

#: Words of the pre-tokenizer; all else is dropped. Letters and numbers are those of Unicode 16.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Added to the code of the byte that ends a word.
END = 0x400
#: Words and pairs that a task remembers, and the characters of the longest such word.
REMEMBERED, LONGEST = 250_000, 64

# Marks that the tokenizers library's tables of composition, of Unicode 9, don't know. They part what stands
# before and behind them, as a character without a combining class does. (U+11930 would compose with U+11935.)
NEWER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF),
    (0x1E4EC, 0x1E4EF),
)
# Capitals of Unicode 16 and 17 (first, last, distance of the small letter), which Python's tables may not know.
NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -0xA567), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, -0xA641), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)
_SMALL = {c: c + d for a, b, d in NEWER_CAPITALS for c in range(a, b + 1)}
_NEWER = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER_MARKS) + "])")


def byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: token strings in the order of ids, merges, special tokens."""

    def __init__(self, text: str):
        told = json.loads(text)
        model = told["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in chain(ids.items(), self.special.items()):
            self.tokens[i] = t
        end = model["end_of_word_suffix"]
        symbol: dict[int, str] = {}
        for b, c in enumerate(byte_symbols()):
            symbol[ids[c]], symbol[ids[c + end]] = chr(b), chr(b + END)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = ids[a], ids[b]
            new = ids[a + b]
            self.merges[left, right] = rank, new
            if new not in symbol:
                symbol[new] = symbol[left] + symbol[right]
                self.parts[new] = rank, left, right
        self.symbol = symbol


class _Words(dict):
    """Tokens of the words that were met. When it is full it becomes the older half, whose words come back when met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word) or self.encode(word)
        if len(word) <= LONGEST:
            self[word] = found
        return found


def composed(text: str) -> str:
    """NFC by the tables of the tokenizers library; nothing of Latin-1 changes."""
    if _NEWER.search(text) is None:
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", part) for part in _NEWER.split(text))


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        by_text = {s: i for i, s in vocabulary.symbol.items()}
        for s, i in by_text.items():
            self.automaton.add_word(s, (i, len(s)))
            self.length[i] = len(s)
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for s, i in by_text.items():
            self.shorter[i] = next((by_text[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by_text), None)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = _Words(self.word)
        self.find = classes.finder(WORDS).findall
        self.find_latin = classes.finder(WORDS, True).findall
        self.split = regex.compile("|".join(regex.escape(x) for x in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None

    def _keeps_boundary(self, left: int, right: int) -> bool:
        """Undo the merges on both sides of the boundary, latest first: none between may come before those it undoes."""
        parts, merges = self.v.parts, self.v.merges
        limit = len(merges) + 1
        while True:
            met = merges.get((left, right))
            if met is not None and met[0] < limit:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            # Of equal ranks the leftmost merges first: it counts as later than the boundary's pair only from the right.
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= 5 * REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self._keeps_boundary(left, right)
        return known

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        text = raw[:-1].decode("latin-1") + chr(raw[-1] + END)
        size, length, shorter, pairs = len(text), self.length, self.shorter, self.pairs
        longest = [-1] * size
        most = [0] * size
        for end, (i, n) in self.automaton.iter(text):
            start = end - n + 1
            if n > most[start]:
                most[start], longest[start] = n, i
        reachable = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if reachable[end]:
                fits = not out or pairs.get((out[-1], token))
                if fits is None:
                    fits = self.compatible(out[-1], token)
                if fits:
                    out.append(token)
                    if end == size:
                        return tuple(out)
                    at, token = end, longest[end]
                    continue
            less = shorter[token]
            if less is not None:
                token = less
            else:
                reachable[at] = 0
                token = out.pop()
                at -= length[token]

    def _plain(self, text: str) -> Iterator[int]:
        if not classes.is_latin(text):
            text = composed(text).replace("Σ", "σ").translate(_SMALL)
        text = text.lower()
        found = self.find_latin(text) if classes.is_latin(text) else self.find(text)
        return chain.from_iterable(map(self.words.__getitem__, found))

    def encode(self, text: str) -> np.ndarray:
        special = self.v.special
        if self.split is None or not any(s in text for s in special):
            return np.fromiter(self._plain(text), np.int32)
        out: list[int] = []
        at = 0
        for m in self.split.finditer(text):
            out += [*self._plain(text[at : m.start()]), special[m[0]]]
            at = m.end()
        return np.array([*out, *self._plain(text[at:])], np.int32)


class Decoder:
    """Token strings parted by one space: the file names no decoder."""

    def __init__(self, vocabulary: Vocabulary):
        raw = [t.encode() + b" " for t in vocabulary.tokens]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        start = self.offsets[ids]
        n = self.offsets[ids + 1] - start
        out = np.cumsum(n)
        place = np.arange(out[-1] if len(out) else 0) + np.repeat(start - (out - n), n)
        return self.data[place].tobytes()[:-1]


def load(spark: SparkSession, path: str):
    """A broadcast vocabulary: a file of fixed size, read by the driver."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """(row, ids[, decoded]): the document as a struct, its token ids, and on demand what decoding these gives."""
    sent = load(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(sent.value)
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for b in batches:
            texts = b.column(0).field(text)
            for lo, hi, data, off in blocks(texts):
                raw = data.tobytes()
                ids = [encoder.encode(raw[s:e].decode()) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns = [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                if decoded:
                    columns.append(pa.array([decoder.decode(x).decode() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["row", "ids", "decoded"][: len(columns)])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """(row, decoded) of a table with a column of token ids; a null list is decoded as an empty one."""
    sent = load(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary(sent.value))
        for b in batches:
            out = [decoder.decode(np.array(x or [], np.int64)).decode() for x in b.column(0).field(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["row", "decoded"])

    packed = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("row"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, decoded string")


def digest(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""
    found = encode(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), path, "text", decoded=True)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Language identification by hierarchical discrimination.

A text is the square-rooted, normalised counts of its byte trigrams (A-Z lower-cased, all but letters and bytes beyond
ASCII parted by blanks), hashed to ``DIMENSIONS`` places. Linear support vector machines tell language families apart
first, one family against the rest; inside the chosen family one machine for each two languages votes, the larger sum of
margins deciding between equal votes. The machines are trained here, in numpy, by accelerated gradient descent on the
squared hinge loss.

Every language is learned. Training takes a bounded sample of labelled rows: ``per_language`` documents of each language,
and ``MAX_TRAIN`` in all but at least one of each, chosen by a hash of their ids; what reaches the driver are their trigram counts, at most ``DIMENSIONS`` each. Prediction
reads every text whole and needs nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if no row is labelled;
with one language learned it is always that one; rows with a null id or language are not learned from; repeated rows are
learned from and predicted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import blocks

DIMENSIONS, PER_LANGUAGE, MAX_TRAIN = 1 << 13, 600, 4800
#: Strength of the margin against the size of the weights, and rounds of descent.
COST, ROUNDS, TOGETHER = 20.0, 100, 16

# Language codes by family; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_FAMILY = {x: f for f, xs in FAMILIES.items() for x in xs}

_LETTERS = np.full(256, 0x20, np.uint32)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_TEXTS = 64


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def _counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Trigram counts (texts x DIMENSIONS); each text stands between blanks."""
    n = len(off) - 1
    text = np.repeat(np.arange(n), np.diff(off))
    at = np.arange(len(data)) + 2 * text + 1
    padded = np.full(len(data) + 2 * n, 0x20, np.uint32)
    padded[at] = _LETTERS[data]
    owner = np.repeat(np.arange(n), np.diff(off) + 2)
    code = padded[:-2] | (padded[1:-1] << np.uint32(8)) | (padded[2:] << np.uint32(16))
    good = (owner[:-2] == owner[2:]) & (code != 0x202020)
    place = (code * np.uint32(0x9E3779B1)) >> _SHIFT
    return np.bincount(owner[:-2][good] * DIMENSIONS + place[good].astype(np.int64), minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)


def _features(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def _has_letter(raw: bytes) -> bool:
    return _ASCII_LETTER.search(raw) is not None or (not raw.isascii() and any(c.isalpha() for c in raw.decode(errors="replace")))


def svm(x: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (a column a machine) that part the rows with y = 1 from those with y = -1; rows with y = 0 take no part.

    The last column of x is 1, and its weight the bias. Machines are trained ``TOGETHER`` at a time, so that these share each
    pass over x.
    """
    out = np.zeros((x.shape[1], y.shape[1]), np.float32)
    square = np.einsum("ij,ij->i", x, x)
    for lo in range(0, y.shape[1], TOGETHER):
        own = y[:, lo : lo + TOGETHER].astype(np.float32)
        share = lambda side: side * (cost / np.maximum(1, side.sum(0)))
        weight = (share(own > 0) + share(own < 0)).astype(np.float32)
        rate = (1 / (1 + 2 * (square @ weight))).astype(np.float32)
        w = before = np.zeros((x.shape[1], own.shape[1]), np.float32)
        for k in range(rounds):
            ahead = w + (k / (k + 3)) * (w - before)
            slack = np.maximum(0, 1 - own * (x @ ahead))
            before, w = w, ahead - rate * (ahead - 2 * (x.T @ (weight * slack * own)))
        out[:, lo : lo + TOGETHER] = w
    return out


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
        lang = np.array(langs)
        group = np.array([family(x) for x in langs])
        self.families = sorted(set(group.tolist()))
        self.members = [[k for k, x in enumerate(self.langs) if family(x) == f] for f in self.families]
        sides: list[np.ndarray] = []
        self.of_family: list[int] = []
        for f in self.families if len(self.families) > 1 else ():
            self.of_family.append(len(sides))
            sides.append(np.where(group == f, 1, -1))
        self.of_pair: dict[tuple[int, int], int] = {}
        for members in self.members:
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    self.of_pair[a, b] = len(sides)
                    sides.append((lang == self.langs[a]).astype(int) - (lang == self.langs[b]))
        self.weights = svm(x, np.stack(sides, 1)) if sides else np.zeros((DIMENSIONS + 1, 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the languages, scores between 0 and 1)."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        if self.of_family:
            m = margins[:, self.of_family]
            chosen, sure = m.argmax(1), m.max(1)
        else:
            chosen, sure = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        out = np.zeros(len(x), np.int64)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(chosen == f)
            votes = np.zeros((len(rows), len(members)))
            total = np.zeros_like(votes)
            least = np.full_like(votes, np.inf)
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    m = margins[rows, self.of_pair[a, members[j]]]
                    for side, v in ((i, m), (j, -m)):
                        votes[:, side] += v > 0
                        total[:, side] += v
                        least[:, side] = np.minimum(least[:, side], v)
            best = np.lexsort((total, votes), axis=1)[:, -1]
            out[rows] = np.array(members)[best]
            sure[rows] = np.minimum(sure[rows], least[np.arange(len(rows)), best])
        return out, 1 / (1 + np.exp(-2 * np.clip(sure, -30, 30)))


def held_out(doc: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, max_train: int = MAX_TRAIN) -> Model | None:
    """Learn from the documents that aren't held out; None if there is nothing to learn from."""
    known = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).dropna().where(~held_out(F.col("id")))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not sizes:
        return None
    each = max(1, min(per_language, max_train // len(sizes)))
    share = F.element_at(F.map_from_arrays(F.lit([r.lang for r in sizes]), F.lit([min(1.0, 1.5 * each / r.n + 20 / r.n) for r in sizes])), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    some = known.where(drawn < share * (1 << 30)).withColumn("drawn", drawn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _TEXTS):
                part = b.slice(at, _TEXTS)
                for lo, hi, data, off in blocks(part.column(0)):
                    c = _counts(data, off)
                    found = [np.flatnonzero(x) for x in c]
                    rest = [part.column(k).slice(lo, hi - lo) for k in (1, 2)]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array([x.tolist() for x in found], pa.list_(pa.int32())), pa.array([c[i, x].tolist() for i, x in enumerate(found)], pa.list_(pa.int32()))], ["lang", "drawn", "place", "n"])

    rows = some.select("text", "lang", "drawn").mapInArrow(count, "lang string, drawn long, place array<int>, n array<int>").collect()
    taken: dict[str, int] = {}
    counts, langs = [], []
    for r in sorted(rows, key=lambda r: (r.lang, r.drawn, r.place)):
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= each and r.place:
            row = np.zeros(DIMENSIONS, np.float32)
            row[r.place] = r.n
            counts.append(row)
            langs.append(r.lang)
    return Model(_features(np.stack(counts)), langs) if counts else None


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """(row, lang_pred, score): the document as a struct and its predicted language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            pred, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for at in range(0, b.num_rows if model else 0, _TEXTS):
                texts = b.column(0).field(text).slice(at, _TEXTS)
                for lo, hi, data, off in blocks(texts):
                    raw = data.tobytes()
                    some = np.flatnonzero([_has_letter(raw[s:e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
                    if len(some):
                        which, sure = model.predict(_features(_counts(data, off)[some]))
                        pred[at + lo + some] = np.array(model.langs, object)[which]
                        score[at + lo + some] = sure
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def report(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    found = predict(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), fit(docs, doc, text, lang))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")

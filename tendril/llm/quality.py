"""Quality rules: base rules, and how far a text diverges from the language references.

A reference per language holds two histograms over all its documents: characters by class, and the language's
``common`` most frequent words with one bin for all other words. A document is compared with every reference by the
Jensen-Shannon distance (base 2), for characters and for words apart, and its divergence is the least over the
references. The distance of words is told as a share of that of a text without any common word (``word_js`` is 1 there). Each comparison has a minimum length below which it does not judge: histograms of a few words are noise.

kept is false for a document that fails a base rule (fewer than ``min_words`` words, or more than ``max_repeat`` percent
of its words in repeated windows of five), or that diverges beyond ``max_char`` or ``max_word``.

Defined results: a null, empty or blank text has no words and fails; documents without a language are judged but do not
shape the references; without any reference no text diverges; repeated rows count each. Every language
has a reference. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .arrow_text import LOWER_SPACED, SPACED, blocks, mix, range_sums, run_hash, slice_hash, word_bounds

MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
COMMON = 50
#: (least length, most distance) for characters and for words.
MIN_CHARS, MAX_CHAR = 300, 0.30
#: Words: the distance is taken as a share of that of a text without any common word.
MIN_HIST_WORDS, MAX_WORD = 80, 0.95
#: Distinct words that a task counts before it hands the counts on.
FLUSH = 200_000
#: Counts of known words that a task holds at once, over all texts of a block.
CELLS = 1 << 23

#: Classes: 0 lower, 1 upper, 2 beyond ASCII, 3 digit, 4 white space, 5 sentence marks, 6 symbols, 7 other, 8 inside a character.
CLASS = np.full(256, 7, np.uint8)
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0xC0:], CLASS[0x30:0x3A], CLASS[0x80:0xC0] = 0, 1, 2, 3, 8
CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 4
CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
CLASS[[ord(c) for c in "#*$%&|<>"]] = 6
N_CLASSES, _SPACE, _SYMBOL, _INSIDE = 9, 4, 6, 8


def _classes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return np.bincount(text * N_CLASSES + CLASS[data], minlength=(len(off) - 1) * N_CLASSES).reshape(-1, N_CLASSES)


def language_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, kind, bin, n): characters by class ("char") and words ("word") of all documents with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            out = [(l, "char", str(k), int(n)) for l, h in chars.items() for k, n in enumerate(h) if n and k != _INSIDE]
            out += [(l, "word", w.decode(), n) for l, c in words.items() for w, n in c.items()]
            words.clear()
            chars.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "kind", "bin", "n"])

        for b in batches:
            langs = b.column(1).to_pylist()
            for lo, hi, data, off in blocks(b.column(0)):
                for k, h in enumerate(_classes(data, off)):
                    chars[langs[lo + k]] = chars.get(langs[lo + k], 0) + h
                lower = LOWER_SPACED[data].tobytes()
                for k in range(hi - lo):
                    words.setdefault(langs[lo + k], Counter()).update(lower[off[k] : off[k + 1]].split(b" "))
                for c in words.values():
                    c.pop(b"", None)
                if sum(map(len, words.values())) > FLUSH:
                    yield rows()
        yield rows()

    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    return known.mapInArrow(count, "lang string, kind string, bin string, n long").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON) -> dict:
    """Per language: shares of character classes, its common words and their shares (the last is for all other words).

    What reaches the driver is bounded: ``common`` words and a few counts a language.
    """
    counts = materialize(language_counts(docs, text, lang), "language-counts")
    total = counts.groupBy("lang").pivot("kind", ["char", "word"]).agg(F.sum("n")).select("lang", F.col("word").alias("total"))
    by_rank = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "bin")
    top = counts.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= F.greatest(F.lit(common), F.lit(N_CLASSES)))
    found: dict[str, dict] = {}
    for r in top.join(total, "lang").orderBy("lang", "kind", "rank").collect():
        x = found.setdefault(r.lang, {"chars": np.zeros(N_CLASSES - 1), "words": [], "n": [], "total": r.total or 0})
        if r.kind == "char":
            x["chars"][int(r.bin)] = r.n
        elif r["rank"] <= common:
            x["words"].append(r.bin.encode())
            x["n"].append(r.n)
    for x in found.values():
        x["chars"] = x["chars"] / max(1, x["chars"].sum())
        x["shares"] = np.array([*x.pop("n"), 0.0])
        x["shares"][-1] = x.pop("total") - x["shares"].sum()
        x["shares"] = x["shares"] / max(1, x["shares"].sum())
        x["bare"] = float(jensen_shannon(np.eye(len(x["shares"]))[-1:], x["shares"])[0])
    return {k: x for k, x in found.items() if x["words"]}


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the rows of p, counts, from the shares q."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.maximum((a + b) / 2, 0))


def _hash_word(word: bytes) -> int:
    return int(slice_hash(range_sums(np.frombuffer(word, np.uint8)), np.array([0]), np.array([len(word)]))[0])


def _repeat_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """Words in windows that a text holds twice or more. Windows are matched by hash, then held against each other word by
    word; a text with windows of one hash and other words is counted by the words alone."""
    if len(starts) < WINDOW:
        return np.zeros(n, np.int64)
    h = run_hash(slice_hash(range_sums(data), starts, ends), WINDOW)
    whole = np.flatnonzero(texts[: len(h)] == texts[WINDOW - 1 :])
    h = h[whole] ^ mix(texts[whole].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[order[1:]] == h[order[:-1]]
    twice = whole[order[same[1:] | same[:-1]]]
    cover = np.bincount(twice, minlength=len(starts) + 1) - np.bincount(twice + WINDOW, minlength=len(starts) + 1)[: len(starts) + 1]
    out = np.bincount(texts[np.cumsum(cover)[:-1] > 0], minlength=n)
    after = np.flatnonzero(same[1:-1]) + 1  # places in the order whose window has the hash of the one before
    one, two = whole[order[after - 1]], whole[order[after]]
    apart = texts[one] != texts[two]
    size = ends - starts
    for k in range(WINDOW):
        apart |= size[one + k] != size[two + k]
    for k in range(WINDOW):
        i = np.flatnonzero(~apart)
        length = size[one[i] + k]
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        differs = data[np.repeat(starts[one[i] + k], length) + step] != data[np.repeat(starts[two[i] + k], length) + step]
        apart[i[np.unique(np.repeat(np.arange(len(i)), length)[differs])]] = True
    for t in np.unique(texts[np.concatenate([one[apart], two[apart]])]).tolist():
        own = np.flatnonzero(texts == t)
        said = [data[s:e].tobytes() for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
        runs = [tuple(said[k : k + WINDOW]) for k in range(len(said) - WINDOW + 1)]
        count = Counter(runs)
        out[t] = len({j for k, x in enumerate(runs) if count[x] > 1 for j in range(k, k + WINDOW)})
    return out


def _measure(data: np.ndarray, off: np.ndarray, refs: dict, known: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    cls = _classes(data, off)
    starts, ends, texts = word_bounds(SPACED[data], off)
    out = {"n_words": np.bincount(texts, minlength=n), "word_chars": cls.sum(1) - cls[:, _INSIDE] - cls[:, _SPACE], "n_symbols": cls[:, _SYMBOL]}
    out["n_repeat_words"] = _repeat_words(data, starts, ends, texts, n)
    out["char_js"], out["word_js"] = np.zeros(n), np.zeros(n)
    if refs:
        chars = cls[:, :_INSIDE].astype(float)
        out["char_js"] = np.min([jensen_shannon(chars, x["chars"]) for x in refs.values()], axis=0)
        lower = slice_hash(range_sums(LOWER_SPACED[data]), starts, ends)
        at = np.minimum(np.searchsorted(known, lower), len(known) - 1)
        hit = known[at] == lower
        bins = np.bincount(texts[hit] * len(known) + at[hit], minlength=n * len(known)).reshape(n, -1).astype(float)
        dist = []
        for x in refs.values():
            own = bins[:, x["at"]]
            d = jensen_shannon(np.concatenate([own, out["n_words"][:, None] - own.sum(1, keepdims=True)], 1), x["shares"])
            dist.append(d / max(1e-9, x["bare"]))
        out["word_js"] = np.min(dist, axis=0)
    return out


def _dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\v\f")]
    return len(lines) - len(set(lines))


def some_texts(column: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of blocks of ``most`` texts or fewer."""
    for _, _, data, off in blocks(column):
        for lo in range(0, len(off) - 1, most):
            own = off[lo : lo + most + 1]
            yield data[own[0] : own[-1]], own - own[0]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, refs: dict, text: str = "text") -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_js, word_js); row: the document as a struct."""
    known = np.unique(np.array([_hash_word(w) for x in refs.values() for w in x["words"]], np.uint64))
    refs = {k: x | {"at": np.searchsorted(known, np.array([_hash_word(w) for w in x["words"]], np.uint64))} for k, x in refs.items()}
    sent = docs.sparkSession.sparkContext.broadcast((refs, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, known = sent.value
        for b in batches:
            parts: list[dict[str, np.ndarray]] = []
            for data, off in some_texts(b.column(0).field(text), max(1, CELLS // max(1, len(known)))):
                got = _measure(data, off, refs, known)
                raw = data.tobytes()
                got["n_dup_lines"] = np.array([_dup_lines(raw[s:e]) for s, e in zip(off[:-1], off[1:], strict=True)])
                parts.append(got)
            whole = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (*MEASURES, "char_js", "word_js")}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(whole[k].astype(np.int64)) for k in MEASURES), pa.array(whole["char_js"]), pa.array(whole["word_js"])], ["row", *MEASURES, "char_js", "word_js"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.mapInArrow(run, "row " + packed.schema["row"].dataType.simpleString() + "".join(f", {k} long" for k in MEASURES) + ", char_js double, word_js double")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", refs: dict | None = None, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, min_chars: int = MIN_CHARS, max_char: float = MAX_CHAR, min_hist_words: int = MIN_HIST_WORDS, max_word: float = MAX_WORD) -> DataFrame:
    """``measure`` with base_failed and kept; the references come from the documents themselves unless given."""
    found = measure(docs, references(docs, text, lang) if refs is None else refs, text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    far = ((F.col("word_chars") >= min_chars) & (F.col("char_js") > max_char)) | ((F.col("n_words") >= min_hist_words) & (F.col("word_js") > max_word))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judge(docs, text, lang, **how).where("kept").select("row.*")

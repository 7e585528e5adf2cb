"""Scoring texts by a log-bilinear language model, trained with noise-contrastive estimation.

Tokens are lower-cased (A-Z) words parted by ASCII white space, and one end for each text. The model predicts a token's
slot from the contexts of the two tokens before. A word counted ``slot_count`` times or more, and the end, has a slot of
its own, so their number grows with the corpus (to ``FREQUENT``, what the tasks hold); every other word falls into one of
``SUFFIX_SLOTS`` by its last three bytes, in which it has its smoothed share: (c + 0.5) / (C + 0.5 (V + 1)), with C and V
the tokens and distinct tokens of the slot. So each token has a probability, seen or not. As a context a word is one of
the ``CONTEXT_WORDS`` most frequent ones or its suffix, which keeps the number of pairs of contexts fixed.

The score of slot w after (u, v) is (a * R[u] + b * R[v]) . Q[w] + bias[w]. Training reads every learned text once: the
texts are dealt over ``ROUNDS`` rounds by a hash, in each round every task trains a replica on its texts (noise samples
shared by a batch, AdaGrad), and the replicas' mean, each row weighted by how often a replica met it, starts the next
round. Afterwards the normaliser of every pair of contexts comes from batched matrix products, so scores are normalised
exactly.

Counts cover all learned texts. The words counted at least as often as a threshold, at most ``FREQUENT`` of them, go to
the tasks with their counts; the occurrences of all other words are joined with the table of counts. No word is dropped.

Defined results: a null text is an empty one (an end alone); a null id is learned from, as its remainder isn't 1; repeated
rows count each; with no learned text the score comes from the untrained model and the base score is 0. Replicas follow
the partitions of the table, so a table laid out in other files gets slightly other parameters and scores.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .arrow_text import blocks

CONTEXT_WORDS, SUFFIX_SLOTS, WIDTH = 768, 256, 32
CONTEXTS = CONTEXT_WORDS + SUFFIX_SLOTS
FREQUENT, SLOT_COUNT = 200_000, 1000
ROUNDS, NOISE, BATCH, RATE = 2, 32, 4096, 0.1
#: Distinct words that a task counts, or remembers the slots of, before it starts anew.
FLUSH = 200_000
#: Scores that a task computes at once for the normalisers.
CELLS = 1 << 21
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
_END = b""  # not a word


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string")) % 5 == 1, F.lit(False))


def _words(data: np.ndarray, off: np.ndarray) -> Iterator[list[bytes]]:
    raw = data.tobytes().translate(_LOWER)
    for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield raw[s:e].split()


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a table of one column of texts; the end is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])
        for b in batches:
            for lo, hi, data, off in blocks(b.column(0)):
                for words in _words(data, off):
                    found.update(words)
                found[_END] += hi - lo
                if len(found) > FLUSH:
                    yield rows()
                    found.clear()
        yield rows()

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _suffix(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SUFFIX_SLOTS


class Lexicon:
    """Frequent words with counts, and what is known of all slots: those of ``own`` words, then those of suffixes."""

    def __init__(self, frequent: list[tuple[bytes, int]], by_suffix: dict[int, tuple[int, int]], total: int, distinct: int, slot_count: int = SLOT_COUNT):
        ordered = sorted(frequent, key=lambda x: (x[0] != _END, -x[1], x[0]))
        if not ordered or ordered[0][0] != _END:
            ordered.insert(0, (_END, 0))
        self.words = [w for w, _ in ordered]
        c = np.array([n for _, n in ordered], float)
        self.met = c > 0
        self.total, self.distinct = total, distinct
        self.base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        # At least as many as there are contexts of words, whatever the counts.
        self.own = min(len(ordered), max(CONTEXT_WORDS, 1 + int((c[1:] >= slot_count).sum())))
        suffix = np.array([_suffix(w) for w in self.words])
        place = np.arange(len(ordered))
        self.slot = np.where(place < self.own, place, self.own + suffix)
        self.context = np.where(place < CONTEXT_WORDS, place, CONTEXT_WORDS + suffix)
        rest = np.zeros((SUFFIX_SLOTS, 2))  # tokens and distinct tokens of the words without a slot of their own
        for k, (n, v) in by_suffix.items():
            rest[k] = n, v
        for w, n in ordered[: self.own]:
            rest[_suffix(w)] -= n, n > 0
        self.size = rest[:, 0] + 0.5 * (rest[:, 1] + 1)
        self.inner = np.where(place < self.own, 0, np.log10((c + 0.5) / self.size[suffix]))
        self.counts = np.concatenate([c[: self.own], rest[:, 0]])

    def places(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, contexts) of codes: numbers of frequent words, -1 - suffix for all others."""
        often = np.maximum(code, 0)
        return np.where(code >= 0, self.slot[often], self.own - 1 - code), np.where(code >= 0, self.context[often], CONTEXT_WORDS - 1 - code)


class _Lookup(dict):
    """Codes of words."""

    def __init__(self, lexicon: Lexicon):
        super().__init__((w, k) for k, w in enumerate(lexicon.words))
        self.room = len(self) + FLUSH

    def __missing__(self, word: bytes) -> int:
        found = -1 - _suffix(word)
        if len(self) < self.room:
            self[word] = found
        return found


def lexicon(counts: DataFrame, frequent: int = FREQUENT, slot_count: int = SLOT_COUNT) -> Lexicon:
    """What goes to the tasks; at most ``frequent`` words reach the driver."""
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    by_suffix = counts.groupBy((F.crc32(F.substring("word", -3, 3)) % SUFFIX_SLOTS).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    # The least count at which no more than ``frequent`` words are left, from the number of words for each count by powers.
    least, levels = 1, counts.groupBy(F.floor(F.log2("c") * 4).alias("level")).agg(F.count("*").alias("v"), F.min("c").alias("c")).orderBy(F.desc("level")).collect()
    have = 0
    for r in levels:
        have += r.v
        if have > frequent:
            break
        least = r.c
    else:
        least = 1
    rows = counts.where((F.col("c") >= least) | (F.col("word") == F.lit(_END))).select("word", "c").toArrow() if levels and (have <= frequent or least > 1) else None
    words = list(zip(*(rows.column(k).to_pylist() for k in ("word", "c")), strict=True)) if rows is not None else []
    return Lexicon(words, {r.k: (r.n, r.v) for r in by_suffix}, sums.n or 0, sums.v, slot_count)


def initial(lex: Lexicon) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(0)
    q = (lex.counts + 0.5) / (lex.counts + 0.5).sum()
    small = lambda *size: (rng.standard_normal(size) * 0.1).astype(np.float32)
    return {"R": small(CONTEXTS, WIDTH), "Q": small(len(q), WIDTH), "bias": np.log(q).astype(np.float32), "a": np.ones(WIDTH, np.float32), "b": np.full(WIDTH, 0.5, np.float32)}


def _codes(block_words: Iterator[list[bytes]], lookup: _Lookup) -> tuple[np.ndarray, list[list[bytes]]]:
    """(codes of all tokens with two ends ahead of each text, words of each text)."""
    codes: list[int] = []
    texts: list[list[bytes]] = []
    get = lookup.__getitem__
    for words in block_words:
        codes += [0, 0]
        codes += map(get, words)
        codes.append(0)
        texts.append(words)
    return np.array(codes, np.int64), texts


def _targets(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(places of the predicted tokens, their texts)."""
    n = np.array([len(w) + 1 for w in texts], np.int64)
    own = np.repeat(np.arange(len(texts)), n)
    return np.arange(len(own)) + 2 * (own + 1), own


def _summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct places, sums of the values there)."""
    rows, inverse = np.unique(at, return_inverse=True)
    width = values.shape[1]
    flat = (inverse[:, None] * width + np.arange(width)).ravel()
    return rows, np.bincount(flat, values.ravel(), len(rows) * width).reshape(-1, width).astype(np.float32)


class Trainer:
    def __init__(self, start: dict[str, np.ndarray], counts: np.ndarray):
        self.p = {k: x.copy() for k, x in start.items()}
        self.seen = {k: np.full_like(x, 1e-2) for k, x in self.p.items()}
        q = (counts + 0.5) / (counts + 0.5).sum()
        self.log_noise = np.log(NOISE * q).astype(np.float32)
        self.edges = np.cumsum(q)
        self.rng = np.random.default_rng(1)
        self.met = {"Q": np.zeros(len(q)), "R": np.zeros(CONTEXTS)}
        self.tokens = 0

    def _move(self, k: str, at, g: np.ndarray) -> None:
        self.seen[k][at] += g * g
        self.p[k][at] += RATE * g / np.sqrt(self.seen[k][at])

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        """One batch: v stands right before w, and u before v."""
        p = self.p
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(self.edges) - 1)
        rv, ru, qw, qn = p["R"][v], p["R"][u], p["Q"][w], p["Q"][noise]
        h = p["a"] * rv + p["b"] * ru
        good = np.einsum("ij,ij->i", h, qw) + p["bias"][w] - self.log_noise[w]
        bad = h @ qn.T + (p["bias"][noise] - self.log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        down = 1 / (1 + np.exp(np.clip(-bad, -30, 30)))
        dh = up[:, None] * qw - down @ qn
        n = np.float32(1 / np.sqrt(len(w)))
        # The last column is the bias's.
        own = np.concatenate([up[:, None] * h, up[:, None]], 1)
        theirs = -np.concatenate([down.T @ h, down.sum(0)[:, None]], 1)
        slots, dq = _summed(np.concatenate([w, noise]), np.concatenate([own, theirs]))
        contexts, dr = _summed(np.concatenate([v, u]), np.concatenate([dh * p["a"], dh * p["b"]]))
        da, db = (dh * rv).sum(0), (dh * ru).sum(0)
        self._move("Q", slots, dq[:, :-1] * n)
        self._move("bias", slots, dq[:, -1] * n)
        self._move("R", contexts, dr * n)
        self._move("a", slice(None), da * n)
        self._move("b", slice(None), db * n)
        self.met["Q"] += np.bincount(w, minlength=len(self.edges))
        self.met["R"] += np.bincount(v, minlength=CONTEXTS) + np.bincount(u, minlength=CONTEXTS)
        self.tokens += len(w)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(parameters, a row for each slot, each context, and what all share; how much each row weighs in the mean)."""
        return _packed(self.p), np.concatenate([self.met["Q"], self.met["R"], [self.tokens] * 2]) + 1e-3


def _packed(p: dict[str, np.ndarray]) -> np.ndarray:
    """Rows: of slots with their bias, of contexts, a, b."""
    plain = np.concatenate([p["R"], p["a"][None], p["b"][None]])
    return np.concatenate([np.concatenate([p["Q"], p["bias"][:, None]], 1), np.pad(plain, ((0, 0), (0, 1)))]).astype(np.float32)


def _unpacked(rows: np.ndarray) -> dict[str, np.ndarray]:
    slots = len(rows) - CONTEXTS - 2
    x = np.ascontiguousarray(rows[:, :WIDTH])
    return {"Q": x[:slots].copy(), "bias": rows[:slots, WIDTH].copy(), "R": x[slots:-2].copy(), "a": x[-2].copy(), "b": x[-1].copy()}


def train(texts: DataFrame, lex: Lexicon, deal: Column, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Train on a column of texts, each in the round that ``deal`` (a number of at least 0) modulo ``rounds`` says."""
    context = texts.sparkSession.sparkContext
    sent = context.broadcast(lex)
    now = initial(lex)
    for r in range(rounds):
        start = context.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            lex = sent.value
            lookup, trainer = _Lookup(lex), Trainer(start.value, lex.counts)
            for b in batches:
                for _, _, data, off in blocks(b.column(0)):
                    code, found = _codes(_words(data, off), lookup)
                    slot, context = lex.places(code)
                    at, _ = _targets(found)
                    at = at[trainer.rng.permutation(len(at))]
                    for k in range(0, len(at), BATCH):
                        x = at[k : k + BATCH]
                        trainer.step(context[x - 2], context[x - 1], slot[x])
            if trainer.tokens:
                rows, weight = trainer.rows()
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), x, pa.array(weight)], ["slot", "x", "n"])

        def mean(part: pa.Table) -> pa.Table:
            x = np.stack(part.column("x").to_numpy())
            n = part.column("n").to_numpy()
            return pa.table({"slot": part.column("slot")[:1], "x": pa.array([(n @ x / n.sum()).astype(np.float32)], pa.list_(pa.float32()))})

        found = texts.where(F.pmod(deal, F.lit(rounds)) == r).mapInArrow(run, "slot int, x array<float>, n double").groupBy("slot").applyInArrow(mean, "slot int, x array<float>").collect()
        if found:
            now = _unpacked(np.array([x.x for x in sorted(found, key=lambda x: x.slot)], np.float32))
    return now


def normalisers(docs: DataFrame, p: dict[str, np.ndarray]) -> np.ndarray:
    """Logarithms of the sums over all slots, for each pair of contexts (that right before, the one before that)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        far, turned = p["b"] * p["R"], np.ascontiguousarray(p["Q"].T)
        step = max(1, CELLS // len(p["Q"]))
        for b in batches:
            for v in b.column(0).to_pylist():
                z = np.empty(CONTEXTS, np.float32)
                for lo in range(0, CONTEXTS, step):
                    s = (p["a"] * p["R"][v] + far[lo : lo + step]) @ turned
                    s += p["bias"]
                    top = s.max(1, keepdims=True)
                    s -= top
                    z[lo : lo + step] = np.log(np.exp(s, out=s).sum(1)) + top[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()), pa.array([z], pa.list_(pa.float32()))], ["v", "z"])

    rows = spark.range(0, CONTEXTS, 1, 32).mapInArrow(run, "v long, z array<float>").collect()
    return np.array([r.z for r in sorted(rows, key=lambda r: r.v)], np.float32)


@dataclass
class Model:
    """The table of counts, what is known of frequent words and slots, the parameters, and the normalisers' logarithms."""

    counts: DataFrame
    lexicon: Lexicon
    parameters: dict[str, np.ndarray]
    normalisers: np.ndarray


def learn(texts: DataFrame, frequent: int = FREQUENT, rounds: int = ROUNDS, slot_count: int = SLOT_COUNT) -> Model:
    """Learn from a table with one column, ``text``, without nulls."""
    counts = materialize(token_counts(texts), "counts")
    lex = lexicon(counts, frequent, slot_count)
    p = train(texts, lex, F.xxhash64("text"), rounds)
    return Model(counts, lex, p, normalisers(texts, p))


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text", frequent: int = FREQUENT, rounds: int = ROUNDS, slot_count: int = SLOT_COUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document, learned from those not held out."""
    learned = docs.where(~held_out(F.col(doc))).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    return apply(docs, learn(learned, frequent, rounds, slot_count), doc, text)


def apply(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` by a model at hand."""
    texts = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    counts, lex = model.counts, model.lexicon
    sent = docs.sparkSession.sparkContext.broadcast((lex, model.parameters, model.normalisers))
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "model", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, p, z = sent.value
        lookup = _Lookup(lex)
        for b in batches:
            for lo, hi, data, off in blocks(b.column(1)):
                code, found = _codes(_words(data, off), lookup)
                slot, context = lex.places(code)
                at, own = _targets(found)
                total = np.zeros(hi - lo)
                for k in range(0, len(at), 1 << 16):
                    x, t = at[k : k + (1 << 16)], own[k : k + (1 << 16)]
                    u, v, w = context[x - 2], context[x - 1], slot[x]
                    s = np.einsum("ij,ij->i", p["a"] * p["R"][v] + p["b"] * p["R"][u], p["Q"][w]) + p["bias"][w] - z[v, u]
                    total += np.bincount(t, s.astype(float), hi - lo)
                c = code[at]
                often = c >= 0
                n = np.bincount(own, minlength=hi - lo)
                known = np.bincount(own[often & lex.met[np.maximum(c, 0)]], minlength=hi - lo)
                base = np.bincount(own[often], lex.base[c[often]], hi - lo)
                inner = np.bincount(own[often], lex.inner[c[often]], hi - lo)
                rare = [Counter() for _ in found]
                first = np.cumsum(n) - n
                for k in np.flatnonzero(~often).tolist():
                    rare[own[k]][found[own[k]][k - first[own[k]]]] += 1
                columns = [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(n), pa.array(known), pa.array(base), pa.array(total / np.log(10) + inner)]
                columns += [pa.array([list(x) for x in rare], pa.list_(pa.binary())), pa.array([list(x.values()) for x in rare], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, base double, model double, rare array<binary>, times array<int>"
    # Numbered before they are written, so that both readers below see the same numbers.
    parts = materialize(texts.select("doc_id", "text", "held_out").mapInArrow(run, schema).withColumn("at", F.monotonically_increasing_id()), "scores")
    words = parts.select("at", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("at", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    size = F.element_at(F.array(*[F.lit(float(x)) for x in lex.size]), (F.crc32(F.substring("word", -3, 3)) % SUFFIX_SLOTS + 1).cast("int"))
    rest = words.join(counts, "word", "left").groupBy("at").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((c + 0.5) / (lex.total + 0.5 * (lex.distinct + 1)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((c + 0.5) / size)).alias("rare_inner"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return parts.join(rest, "at", "left").select("doc_id", "held_out", "n_tokens", plus("known", "rare_known").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), plus("base", "rare_base").alias("base_score"), plus("model", "rare_inner").alias("score"))

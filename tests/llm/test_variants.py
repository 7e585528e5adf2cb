"""Spelling variants against plain loops over all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tendril.llm import variants
from tendril.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(rows, damage=97):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain(rows, damage=97):
    n = plain_words(rows, damage)
    by_hole = defaultdict(set)  # words that agree around one letter, which may be missing
    for w in n:
        for i in range(len(w)):
            by_hole[len(w), w[:i], w[i + 1 :]].add(w)
        for i in range(len(w) + 1):
            by_hole[len(w) + 1, w[:i], w[i:]].add(w)
    near = defaultdict(set)
    for group in by_hole.values():
        for w in group:
            near[w] |= {x for x in group if x != w and abs(len(x) - len(w)) <= 1}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def told(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, word string").repartition(3)


def texts(seed, letters, low, high, n, often=6):
    draw = random.Random(seed)
    stems = ["".join(draw.choice(letters) for _ in range(draw.randint(low, high))) for _ in range(n)]
    words = []
    for s in stems:
        for _ in range(draw.randint(1, 6)):
            i = draw.randrange(len(s))
            c = draw.choice(letters)
            words += [draw.choice([s, s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :], s[:i] + c + s[i:]])] * draw.choice([1, 3, 3, often])
        words += [s] * draw.choice([3, 12, 30])
    draw.shuffle(words)
    return [(k, draw.choice(" .\n1").join(words[k::60])) for k in range(60)]


@pytest.mark.parametrize("letters, low, high, n", [("ab", 4, 9, 120), ("abcdé", 5, 8, 200), ("etaoinÀÿ÷ß", 4, 14, 200), ("a", 5, 30, 20)])
def test_equals_plain_loops(spark, monkeypatch, letters, low, high, n):
    rows = texts(n, letters, low, high, n)
    assert told(variants.report(frame(spark, rows))) == plain(rows)
    monkeypatch.setattr(variants, "BUCKET", 40)  # many buckets are dealt again, down to single positions
    monkeypatch.setattr(variants, "GO", 300)
    monkeypatch.setattr(variants, "SEARCH", 64)
    monkeypatch.setattr(variants, "HELD", 50)
    assert told(variants.report(frame(spark, rows))) == plain(rows)


def test_odd_rows(spark):
    long = "q" * 9000
    rows = [(1, None), (2, ""), (None, "lamps lamps Lamps lampß"), (3, "...,,1"), (4, f"{long} {long} {long} {long}q {long}q {long}q"), (4, "lamp lamp lamp lampe LAMPE lampe"), (5, "a" * 300 + "b"), (5, "ÀÉÎÕÜ ÀÉÎÕÜ àéîõü àéîõü ÀÉÎÕÜ àéîõü")]
    for damage in (97, 2, 1):
        assert told(variants.report(frame(spark, rows), damage=damage)) == plain(rows, damage)
    assert told(variants.report(frame(spark, rows).where("false"))) == []
    assert told(variants.report(frame(spark, [(1, "one two three")]))) == []


def test_checksums():
    draw = np.random.default_rng(1)
    data = draw.integers(0, 256, 5000).astype(np.uint8)
    starts = draw.integers(0, 4000, 300)
    ends = starts + draw.choice([0, 1, 5, 63, 64, 65, 900], 300)
    begun = np.array([zlib.crc32(b"%d:" % k) for k in range(300)], np.uint32)
    got = variants._checksums(data, starts, ends, begun)
    assert got.tolist() == [zlib.crc32(b"%d:" % k + data[s:e].tobytes()) for k, (s, e) in enumerate(zip(starts, ends))]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 301])
def test_wavelet_tree(n):
    draw = np.random.default_rng(n)
    values = draw.permutation(n)
    ask = draw.integers(0, n + 1, (4, 200))
    q, v = variants.WaveletTree(values).report(*ask)
    want = sorted((k, x) for k, (a, b, c, d) in enumerate(ask.T.tolist()) for x in values[a:b].tolist() if c <= x < d)
    assert sorted(zip(q.tolist(), v.tolist())) == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert told(QUERIES["op12_variants"](spark, sf)) == plain(rows)

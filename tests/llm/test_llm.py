"""The operators of tendril.llm against brute force, on small fixtures with nulls, empties, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tendril.llm import bpe, components, decontaminate, langid, licenses, line_dedup, lm, quality, queries, simhash, substrings, warc
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "a", "AÉé 中文 \U0001f600", "x " * 40, "same text here", "same text here", "l1\nl2\nl3\n" * 30, "\x1c\x85  b"]


def words(x):
    return re.findall(rb"[^\x20\x09-\x0d]+", (x or "").encode())


def lower(x):
    return (x or "").encode().lower().decode()  # A-Z only


@pytest.fixture(scope="module")
def docs(spark):
    """Ids that repeat or are null, odd texts, names that clash with the operators' own."""
    long = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta"]) + str(k % 977) for k in range(60_000))
    rows = [(k, t) for k, t in enumerate([*ODD, long])] + [(None, "no id"), (3, "a"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).alias("n_words"), F.lit(1).alias("ids"), F.lit("r").alias("row"), F.lit(2).alias("fp"), F.lit(3).alias("gone"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1


def leaks(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(lower(t))
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for t in texts:
        w = word.findall(lower(t))
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    ids |= windows[tuple(w[s : s + n])] - {"None"}
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short, ITEM!"), (10, "one two three four five six seven eight nine ten"), (None, "no id"), (4, None), (5, "..."), (2, "Short, ITEM!"), (7, "same")]


@pytest.mark.parametrize("most", [200_000, 3])
def test_decontaminate(spark, docs, most):
    own = ["x one two three. four five six SEVEN eight nine ten eleven short item", "short; item short item", "two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine"]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(own)], "doc_id long, text string"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = more.collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(texts, leaks([r.text for r in texts], ITEMS), strict=True))
    got = decontaminate.report(more, bench, max_windows=most)
    assert str(got._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1  # whatever the number of blocks
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want


def test_decontaminate_window_of_many_items(spark):
    """A window that all items share: its list is sent in parts, and every item is told."""
    shared = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(k, f"{shared} w{k}") for k in range(60)] + [(99, "other short")], "item_id long, text string")
    rows = [(1, f"a {shared} b"), (2, "other short one"), (3, "clean"), (4, f"{shared} w7")]
    for most in (200_000, 7):
        blocks = decontaminate._window_blocks(bench, 10, "item_id", "text", most)
        assert max(sum(len(r["items"]) for r in b.collect()) for b in blocks) <= max(4 * most, 0) and len(blocks) == -(-121 // most)
        got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"), bench, max_windows=most).collect()}
        assert got == {1: (10, 60), 2: (2, 1), 3: (0, 0), 4: (11, 60)}


def test_decontaminate_sql(spark):
    same(duck(SF), queries.QUERIES["op1_decontaminate"](spark, SF), queries.ORACLE_SQL["op1_decontaminate"])


def test_decontaminate_removal(spark, docs, empty):
    bench = spark.createDataFrame([(1, "bad words")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Keep this, bad WORDS! and that"), (2, "clean")], "doc_id long, text string")
    assert [r.text for r in decontaminate.remove(df, bench, "spans").orderBy("doc_id").collect()] == ["Keep this, ! and that", "clean"]
    assert [r.doc_id for r in decontaminate.remove(df, bench).collect()] == [2]
    kept = decontaminate.remove(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(empty, bench).count() == 0


# 2


@pytest.mark.parametrize("frequent", [200_000, 50])
def test_lm_base_and_counts(spark, small, docs, frequent):
    more = small.select("doc_id", "text").unionByName(docs.where("doc_id is not null and doc_id != 3").select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    rows = more.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    toks = [words(lower(r.text)) + [b""] for r in rows]
    c = Counter(w for r, t in zip(rows, toks, strict=True) if not held(r.doc_id) for w in t)
    n = sum(c.values())
    den = n + 0.5 * (len(c) + 1)
    got = {r.doc_id: r for r in lm.score(more, frequent=frequent).collect()}
    assert len(got) == len(rows)
    for r, t in zip(rows, toks, strict=True):
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r.doc_id), len(t), sum(c[w] > 0 for w in t), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / den) for w in t), rel=1e-9)
        assert g.score < 0
    out = [g for g in got.values() if g.held_out]
    if frequent > 1000:  # else few words have slots of their own
        assert sum(g.score for g in out) > sum(g.base_score for g in out)  # the model knows more than the counts


def test_lm_is_normalised(spark):
    own = [(b"", 5), (b"a", 3), (b"b", 2)]
    lex = lm.Lexicon(own, {lm._suffix(w): (n, 1) for w, n in own}, 10, 3)
    p = lm.initial(lex)
    z = lm.normalisers(spark.range(1), p)
    h = p["a"] * p["R"][1] + p["b"] * p["R"][0]
    assert np.exp(h @ p["Q"].T + p["bias"] - z[1, 0]).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize(("frequent", "slot_count"), [(200_000, 1000), (200_000, 2), (40, 1000)])
def test_lm_score_from_its_parameters(spark, small, frequent, slot_count):
    """Scores against sums over all slots, by hand, from counts of our own."""
    some = small.select("doc_id", "text").where("doc_id < 60").unionByName(spark.createDataFrame([(900, None), (901, "never seen wordzz"), (902, "The the THE")], "doc_id long, text string"))
    learned = [r.text or "" for r in some.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    c = Counter(w for t in learned for w in words(lower(t)) + [b""])
    model = lm.learn(spark.createDataFrame([(t,) for t in learned], "text string"), frequent, slot_count=slot_count)
    own = {w: k for k, w in enumerate(model.lexicon.words[: model.lexicon.own])}
    assert model.lexicon.words[0] == b"" and all(w in c for w in own)
    assert frequent == 40 or {w for w, n in c.items() if n >= slot_count} <= set(own) and len(own) >= lm.CONTEXT_WORDS
    suffix = lambda w: zlib.crc32(w[-3:]) % lm.SUFFIX_SLOTS
    slot = lambda w: own.get(w, len(own) + suffix(w))
    context = lambda w: own[w] if own.get(w, lm.CONTEXT_WORDS) < lm.CONTEXT_WORDS else lm.CONTEXT_WORDS + suffix(w)
    size, kinds = Counter(), Counter()
    for w, n in c.items():
        if w not in own:
            size[suffix(w)] += n
            kinds[suffix(w)] += 1
    p = {k: x.astype(float) for k, x in model.parameters.items()}
    got = {r.doc_id: r.score for r in lm.apply(some, model).collect()}
    for r in some.collect():
        u = v = 0
        want = 0.0
        for w in words(lower(r.text)) + [b""]:
            s = (p["a"] * p["R"][v] + p["b"] * p["R"][u]) @ p["Q"].T + p["bias"]
            top = s.max()
            want += (s[slot(w)] - top - math.log(np.exp(s - top).sum())) / math.log(10)
            if w not in own:
                want += math.log10((c[w] + 0.5) / (size[suffix(w)] + 0.5 * (kinds[suffix(w)] + 1)))
            u, v = v, context(w)
        assert got[r.doc_id] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_lm_of_nothing(empty, docs):
    assert lm.score(empty).count() == 0
    assert lm.score(docs).count() == docs.count()
    held = docs.where(lm.held_out(F.col("doc_id"))).limit(3)
    for r in lm.score(held).collect():
        assert (r.held_out, r.n_known, r.train_tokens) == (True, 0, 0) and r.n_tokens > 0


# 3


def test_line_dedup_sql(spark, small):
    same(duck(SF), queries.QUERIES["op3_line_dedup"](spark, SF), queries.ORACLE_SQL["op3_line_dedup"])


def chunked(text):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, now = [], []
    for k, x in enumerate(lines):
        now.append(x)
        if (h[k] + 31 * (h[k - 1] if k else 0)) % 3 == 0 or len(x) >= 250 or k == len(lines) - 1:
            out.append(now)
            now = []
    return out


def several(chunk):
    marked = [x for x in chunk if re.search(r"[^ \t\r\f\v]", x)]
    return len(marked) >= 2 or any(len(x) >= 250 for x in marked)


def test_line_dedup_odd(spark, docs, empty):
    block = "\n".join(f"line {k} of a block" for k in range(20)) + "\n" + "a paragraph " * 30
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(200 + k, f"start {k}\n{block}\nend {k}") for k in range(5)], "doc_id long, text string"))
    kept = {}
    first = {}
    rows = sorted({(r.doc_id, r.text) for r in more.collect()}, key=lambda r: (r[0] is not None, r[0] or 0, xxhash_key(r[1])))
    for i, t in rows:
        parts = chunked(t)
        stay = []
        for no, c in enumerate(parts):
            if several(c) and first.setdefault("\n".join(c), (i, t, no)) != (i, t, no):
                continue
            stay += c
        kept[i, t] = "\n".join(stay)
    for r in line_dedup.dedup(more).select("row.doc_id", "row.text", "clean").collect():
        if r.doc_id is not None and r.doc_id >= 200 or r.text in ("l1\nl2\nl3\n" * 30,):
            assert (r.clean or "") == kept[r.doc_id, r.text]
    assert line_dedup.keep(docs).columns == docs.columns
    assert line_dedup.report(empty).count() == 0
    assert line_dedup.report(docs).count() == docs.count()


def xxhash_key(t):
    return t or ""


def test_line_dedup_is_native(small):
    plan = line_dedup.report(small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 4


def measured(text):
    w = words(text)
    t = text or ""
    chars = sum(len(x.decode()) for x in w)
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    c = Counter(grams)
    cover = {j for k, g in enumerate(grams) if c[g] > 1 for j in range(k, k + 5)}
    return len(w), chars, sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(small, docs, empty):
    both = docs.select("doc_id", "text", "lang").unionByName(small.select("doc_id", "text", "lang"))
    for r in quality.judge(both).select("row.text", *quality.MEASURES, "base_failed", "kept").collect():
        want = measured(r.text)
        assert tuple(r[1:6]) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0
    assert quality.keep(docs).columns == docs.columns


def test_quality_verdict(spark):
    sf = "/root/testdata/sf0.01"
    judged = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.QUERIES["op4_quality"](spark, sf).join(judged, "doc_id").where("not base_failed and n_words >= 80").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_repeated_windows_by_their_words(bits, monkeypatch):
    """Also where hashes of windows collide."""
    real = quality.run_hash
    monkeypatch.setattr(quality, "run_hash", lambda h, n: real(h, n) & np.uint64((1 << bits) - 1))
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") + rng.choice(["", "c"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    raw = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(raw, np.uint8)
    found = quality._repeat_words(data, *quality.word_bounds(data, off), len(texts))
    assert found.tolist() == [measured(t)[4] for t in texts]


def distance(p, q):
    """Jensen-Shannon, base 2, of two dicts of counts."""
    p, q = ({k: n / sum(x.values()) for k, n in x.items() if n} if sum(x.values()) else {} for x in (p, q))
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    return math.sqrt(max(0, sum(x * math.log2(x / m[k]) for y in (p, q) for k, x in y.items()) / 2))


def char_class(c):
    if c in " \t\n\v\f\r":
        return "space"
    if not c.isascii():
        return "beyond"
    return "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "mark" if c in ".,;:!?'\"()-" else "symbol" if c in "#*$%&|<>" else "other"


def test_quality_distances(spark, small, docs):
    """Distances and verdicts of every document against references counted by hand."""
    both = small.select("doc_id", "text", "lang").unionByName(docs.select("doc_id", "text", "lang")).unionByName(spark.createDataFrame([(7000, "no language here " * 40, None), (7001, "x", "xx")], "doc_id long, text string, lang string"))
    rows = both.collect()
    chars, tokens = {}, {}
    for r in rows:
        if r.lang is not None and r.text is not None:
            chars.setdefault(r.lang, Counter()).update(map(char_class, r.text))
            tokens.setdefault(r.lang, Counter()).update(words(lower(r.text)))
    refs = {}
    for lang, c in tokens.items():
        if c:
            common = dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON])
            refs[lang] = chars[lang], common, {**common, None: sum(c.values()) - sum(common.values())}
    assert len(refs) >= 5
    got = sorted((str(r.doc_id), r.text or "", r.char_js, r.word_js, r.base_failed, r.kept, r.n_words, r.word_chars) for r in quality.judge(both).select("row.doc_id", "row.text", "char_js", "word_js", "base_failed", "kept", "n_words", "word_chars").collect())
    assert len(got) == len(rows)
    for _, text, char_js, word_js, failed, kept, n, size in got:
        own = Counter(words(lower(text)))
        want_char = min(distance(Counter(map(char_class, text)), x[0]) for x in refs.values())
        want_word = min(distance({**{w: own[w] for w in x[1]}, None: sum(own.values()) - sum(own[w] for w in x[1])}, x[2]) / max(1e-9, distance({None: 1}, x[2])) for x in refs.values())
        assert char_js == pytest.approx(want_char, abs=1e-6) and word_js == pytest.approx(want_word, abs=1e-6)
        assert kept == (not failed and not (size >= 300 and char_js > 0.30) and not (n >= 80 and word_js > 0.95))


def test_quality_of_many_languages(spark):
    """The last of 70 languages is known by its own words too."""
    rows = [(f"l{k:02}", " ".join(f"{w}{k:02}" for w in ("ba", "ce", "di", "fo") for _ in range(30 + (k < 69)))) for k in range(70)]
    refs = quality.references(spark.createDataFrame(rows, "lang string, text string"))
    assert len(refs) == 70 and {f"{w}69".encode() for w in ("ba", "ce", "di", "fo")} == set(refs["l69"]["words"])
    got = quality.judge(spark.createDataFrame(rows[-1:], "lang string, text string"), refs=refs).first()
    assert got.n_words >= quality.MIN_HIST_WORDS and got.word_js < 0.01


def test_jensen_shannon():
    d = quality.jensen_shannon(np.array([[1.0, 0], [0, 2.0], [0, 0]]), np.array([1.0, 0]))
    assert d[0] == 0 and d[1] == pytest.approx(1) and 0 <= d[2] <= 1


# 5


def test_bpe_equals_the_library(spark, small, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    rng = random.Random(2)
    extra = ["".join(rng.choice("abcdeé Ñ'!  \n\t01ßΣσİ中\U0001f600</w>") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    extra += ["a" * 300, "rrrrra" * 20, "x<|endoftext|>Y <|startoftext|>", "'S it'LL"]
    more = docs.select("doc_id", "text").unionByName(small.select("doc_id", "text")).unionByName(spark.createDataFrame([(k, x) for k, x in enumerate(extra)], "doc_id long, text string"))
    rows = bpe.encode(more, VOCAB, decoded=True).select("row.text", "ids", "decoded").collect()
    assert len(rows) == more.count()
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    coded = bpe.encode(docs, VOCAB).select("row.doc_id", "ids")
    assert bpe.decode(coded, VOCAB).count() == docs.count()
    assert bpe.digest(empty, VOCAB).count() == 0


def test_bpe_of_all_code_points():
    """Every code point alone and beside letters, and marks among others of higher and lower classes, before and behind a letter."""
    import unicodedata

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    with open(VOCAB, encoding="utf-8") as f:
        mine = bpe.Encoder(bpe.Vocabulary(f.read()))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assigned = [c for c in every if unicodedata.category(c) != "Cn"]
    marks = [c for c in assigned if unicodedata.combining(c) or c in "\U00011930\U00011935"]
    assert len(marks) > 800
    rng = random.Random(7)
    texts = [" ".join(f"{c} a{c}b 1{c}." for c in every[k : k + 500]) for k in range(0, len(every), 500)]
    texts += ["".join(rng.choice(every) for _ in range(40)) for _ in range(4000)]
    texts += [" ".join(["a\u0345" + c, "a" + c + "\u0327", "e" + c + "\u0301", c + "\u0316\u0301", "o\u0328" + c + "\u0304", unicodedata.normalize("NFD", c)]) for c in marks]
    texts += ["e" + "".join(rng.choice(marks) for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    texts += [unicodedata.normalize("NFD", x) for x in texts[:300]]
    for x, y in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.encode(x).tolist() == y.ids


# 6


def test_warc_sql(spark):
    same(duck(SF), queries.QUERIES["op6_warc_fixity"](spark, SF), queries.ORACLE_SQL["op6_warc_fixity"])


def test_warc_audit(spark, tmp_path):
    schema = "page_id long, url string, html string"
    left = spark.createDataFrame([(1, "u", "a"), (2, None, None), (3000, "v", "b"), (None, "w", "c"), (5, "d", "d"), (5, "d", "d"), (6, "e", "e")], schema)
    right = spark.createDataFrame([(1, "u", "A"), (2, None, None), (3000, "v", "b"), (None, "w", "c"), (5, "d", "d"), (7, "n", "n")], schema)
    a, b = warc.catalogue(left), warc.catalogue(right)
    found = sorted((r.page_id, r.damage) for r in warc.audit(a, b).collect())
    assert found == [(1, "changed"), (5, "copies"), (6, "missing"), (7, "extra")]
    assert warc.audit(a, a).count() == 0
    assert warc.audit(a, warc.catalogue(right.limit(0))).count() == a.count()
    told = warc.fixity(a, b).collect()
    assert len(told) == a.count() + 1 == 7
    assert sorted((r.page_id, r.damage) for r in told if r.damage != "none") == found
    assert {r.damage for r in warc.fixity(a.limit(0), b).collect()} == {"extra"} and warc.fixity(a.limit(0), b).count() == b.count()
    assert {r.damage for r in warc.fixity(a, a).collect()} == {"none"}
    warc.write(left, f"{tmp_path}/w")
    back = warc.read(spark, f"{tmp_path}/w")
    assert sorted((r.url, r.body) for r in back.collect()) == sorted((r.url or "", r.html or "") for r in left.collect())
    offsets = {r.start_offset for r in back.where("file like '%file_no=0/%'").collect()}
    assert offsets >= {r.start_offset for r in a.where("file_no = 0").collect()}


def test_warc_odd_pages(spark):
    """Pages without an id, a very long one, repeats, and columns whose names the operator uses itself."""
    long = "é<p>" * 300_000
    rows = [(None, "u", f"body {k}") for k in range(200)] + [(1, "u", long), (1, "u", long), (1, "u", "other"), (2, "\n", "")]
    left = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit("x"), "length": F.lit(1), "slot": F.lit(2), "file_no": F.lit(3)})
    a = warc.catalogue(left)
    assert a.count() == 203 and a.where("page_id is null").select("file_no").distinct().count() > 100
    hurt = left.where("html != 'body 7'").withColumn("html", F.when(F.length("html") > 100, F.concat("html", F.lit("."))).otherwise(F.col("html")))
    found = sorted((str(r.page_id), r.damage, r.copies) for r in warc.fixity(a, warc.catalogue(hurt)).where("damage != 'none'").collect())
    assert found == [("1", "changed", 2), ("None", "missing", 1)]


def test_warc_records_that_are_hurt():
    good = b"WARC/1.0\r\nWARC-Target-URI: u\r\nContent-Length: 3\r\n\r\na\xffb\r\n\r\n"
    assert list(warc.records(good)) == [(0, "u", "a\ufffdb", None)]
    for tail, fault in ((b"junk", "no header"), (b"WARC/1.0\r\nX: 1\r\n\r\n", "no length"), (b"WARC/1.1\r\ncontent-length: 9\r\n\r\nabc", "cut off"), (b"WARC/1.0\r\nContent-Length: -1\r\n\r\n", "no length")):
        assert [x[-1] for x in warc.records(good + tail)] == [None, fault]
    assert list(warc.records(b"")) == []


def test_warc_ids_of_any_type(spark):
    """Text ids, whole numbers among them, other columns, and an empty side."""
    rows = [("a", "u", "<p>1"), ("b", None, None), ("12", "v", "x"), ("1.5", "w", "y"), (None, "n", "z"), ("a", "u", "<p>2")]
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id string, url string, html string, sha string")
    found = lambda left, right: sorted(r.damage for r in warc.report(left, right).collect())
    assert found(pages, pages) == ["none"] * 6
    hurt = pages.withColumn("html", F.when(F.col("page_id") == "b", "hurt").otherwise(F.col("html")))
    assert found(pages, hurt) == ["changed"] + ["none"] * 5
    assert found(pages.where("false"), pages) == ["extra"] * 6 and found(pages.where("false"), pages.where("false")) == []
    assert warc.catalogue(pages).count() == 6 and warc.catalogue(pages).where("page_id = 12 and file_no = 0 and slot = 12").count() == 1


# 7


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), seed=42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, small, docs, empty):
    more = small.select("doc_id", "text").unionByName(docs.where("doc_id is null or doc_id < 9").select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    rows = more.collect()
    fp = [fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                root[of(i)] = of(j)
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[of(k)] = min(least.get(of(k), r.doc_id), r.doc_id)
    want = sorted(map(str, ((r.doc_id, f"{fp[k]:016x}", least.get(of(k))) for k, r in enumerate(rows))))
    assert sorted(str(tuple(r)) for r in simhash.report(more).collect()) == want
    assert simhash.report(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({r.component_id for r in simhash.report(docs).where("doc_id is not null").collect()})


@pytest.mark.parametrize(("tile", "rows"), [(4, 20_000), (256, 5)])
def test_links_are_complete(spark, tile, rows):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(12)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    comp = {r.node: r.component for r in components.components(simhash.links(df, bucket_rows=rows)).collect()}
    label = {x: comp.get(x, x) for x in signed}
    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 3:
                assert label[signed[i]] == label[signed[j]]
    got = simhash.linked(np.zeros(len(fps)), np.zeros(len(fps)), np.zeros(len(fps), bool), np.array(fps, np.uint64), 3, tile)
    for i, x in enumerate(fps):
        assert all(got[i] == got[j] for j in range(i) if (x ^ fps[j]).bit_count() <= 3)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 50), (51, None), (None, None)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8


def test_langid(spark, docs, empty):
    got = queries.QUERIES["op8_langid"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    odd = langid.report(docs).collect()
    assert len(odd) == docs.count()
    assert {r.lang_pred for r in odd} == {"en", "und"} and all(0 <= r.score <= 1 for r in odd)
    assert langid.report(empty).count() == 0
    assert {r.lang_pred for r in langid.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_langid_decisions(spark, small):
    """Each decision by hand from the machines' weights: family first, then a vote of the family's pairs."""
    texts = small.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(5000, "\u00e9\u4e2d", None), (5001, None, "en"), (5002, "12 34", "en"), (5003, "the und les THE", "de")], "doc_id long, text string, lang string"))
    model = langid.fit(texts)
    assert len(model.langs) >= 4
    for r in langid.predict(texts, model).collect():
        raw = "".join(" " if c.isascii() and not c.isalpha() else c for c in lower(r.row.text)).encode()
        if not any(c.isalpha() for c in r.row.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        x = np.zeros(langid.DIMENSIONS)
        grams = [g for k in range(len(raw)) if (g := (b" " + raw + b" ")[k : k + 3]) != b"   "]
        for g in grams:
            x[(int.from_bytes(g, "little") * 0x9E3779B1 % (1 << 32)) >> 19] += 1
        m = np.sqrt(x / len(grams)) @ model.weights[:-1] + model.weights[-1]
        f = max(range(len(model.families)), key=lambda k: (m[model.of_family[k]], -k))
        best = None
        for a in model.members[f]:
            duels = [m[model.of_pair[a, b]] if a < b else -m[model.of_pair[b, a]] for b in model.members[f] if b != a]
            rank = (sum(d > 0 for d in duels), sum(duels), a)
            if best is None or rank > best[0]:
                best = rank, a, min([*duels, m[model.of_family[f]]])
        assert r.lang_pred == model.langs[best[1]]
        assert r.score == pytest.approx(1 / (1 + math.exp(-2 * min(30, max(-30, best[2])))), abs=1e-4)


def test_langid_of_many_languages(spark):
    words_of = [["".join(random.Random(f"{k} {j}").choices("abcdefghijklmnopqrstuvwxyz", k=6)) for j in range(8)] for k in range(64)]
    rows = [(k * 10 + j, " ".join(ws), f"x{k:02}") for k, ws in enumerate(words_of) for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.langs) == 64
    assert all(r.row.lang == r.lang_pred for r in langid.predict(df, model).collect())


def test_langid_families():
    assert [langid.family(x) for x in ("en", "de", "fr", "zz")] == ["germanic", "germanic", "romance", "zz"]


# 9


def covered(texts, n):
    c = Counter(x[k : k + n] for x in texts for k in range(len(x) - n + 1))
    out = []
    for x in texts:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - n + 1):
            if c[x[k : k + n]] > 1:
                gone[k : k + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "places"), [(4096, 5000), (2, 1)])
def test_substrings(spark, docs, empty, hot, places, monkeypatch):
    monkeypatch.setattr(substrings, "PLACES", places)
    rng = random.Random(5)
    base = "".join(rng.choice("abc dé") for _ in range(2500))
    texts = ["x" * 199, "x" * 200, "x" * 700, "ab" * 300] + [base[rng.randint(0, 1200) :][: rng.randint(100, 1200)] + str(rng.random()) for _ in range(40)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    rows = more.collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(rows, covered([(r.text or "").encode() for r in rows], 200), strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in substrings.report(more, hot=hot).collect()) == want
    assert substrings.report(empty).count() == 0


def test_interval_expansion():
    rng = random.Random(6)
    for _ in range(100):
        n, size = rng.choice([9, 12, 20]), rng.randint(2, 120)
        t = bytes(rng.choice(b"ab") for _ in range(size)) + b"\xff"
        round_ = t * (1 + n // len(t) + 1)
        c = Counter(round_[k : k + n] for k in range(len(t)))
        assert substrings.repeated_starts(np.frombuffer(t, np.uint8), n).tolist() == [c[round_[k : k + n]] > 1 for k in range(len(t))]


# 10


def test_licenses(spark, docs, small, empty):
    own = ["Released under the MIT License. mit license", "Apache-License, General; public LICENSE", "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause */", "SPDX-License-Identifier: MIT OR", "summit license", "Licensed under CC BY-NC 4.0."]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(300 + k, t) for k, t in enumerate(own)], "doc_id long, text string")).unionByName(small.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = licenses.report(more).collect()
    assert len(got) == more.count()
    texts = {(r.doc_id, r.text) for r in more.collect()}
    by = {}
    for i, t in texts:
        w = word.findall(lower(t))
        at = [(k, name) for p, name in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        by.setdefault(i, []).append((len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({n for _, n in at}))))
    for r in got:
        assert tuple(r[1:6]) in by[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    named = {r.doc_id: r for r in got}
    assert named[302].labels == "bsd,gpl,mit" and named[302].allowed and named[303].score > 0 and not named[303].allowed
    assert named[304].n_base == 0 and named[305].labels == "cc-by-nc"
    assert licenses.report(empty).count() == 0


def read_expression(said):
    """(value, labels) of an expression by recursive descent; ValueError if it is malformed."""
    parts = re.findall(r"[()]|[A-Za-z0-9.+:_-]+", said)
    at = 0

    def peek():
        return parts[at].lower() if at < len(parts) and parts[at] != "--" else ""

    def operand():
        nonlocal at
        if peek() in ("", ")", "and", "or", "with"):
            raise ValueError
        at += 1
        if parts[at - 1] == "(":
            found = either()
            if peek() != ")":
                raise ValueError
            at += 1
        else:
            name = licenses.label(parts[at - 1])
            found = name in licenses.ALLOWED, {name} - {None}
        if peek() == "with":
            at += 1
            if peek() in ("", "(", ")", "and", "or", "with"):
                raise ValueError
            found = found[0] and licenses.is_exception(parts[at]), found[1]
            at += 1
        return found

    def chain(one, word, join):
        nonlocal at
        value, names = one()
        while peek() == word:
            at += 1
            other, more = one()
            value, names = join(value, other), names | more
        return value, names

    def either():
        return chain(lambda: chain(operand, "and", lambda a, b: a and b), "or", lambda a, b: a or b)

    out = either()
    if peek():
        raise ValueError
    return out


def test_license_labels_and_scores(spark):
    """Labels, scores and verdicts of mixed texts against regular expressions and a recursive parser."""
    rng = random.Random(11)
    ids = ["MIT", "Apache-2.0", "GPL-3.0-or-later", "LGPL-2.1+", "CC-BY-NC-4.0", "Zlib", "nonsense", "LicenseRef-own"]
    phrases = list(licenses.BASE) + list(licenses.NOTICES)

    def expression(depth=0):
        x = rng.random()
        if depth > 2 or x < 0.4:
            return rng.choice(ids) + (" WITH Some-exception" if rng.random() < 0.2 else "")
        y = f"{expression(depth + 1)} {rng.choice(['AND', 'or', 'OR'])} {expression(depth + 1)}"
        return f"({y})" if x < 0.7 else y + rng.choice(["", "", "", " )", " AND"])

    texts = []
    for _ in range(300):
        pieces = [rng.choice(["some words", "mit", "license", rng.choice(phrases).upper(), rng.choice(phrases).replace(" ", ", "), f"\n# SPDX-License-Identifier: {expression()} -->\n", f"\nspdx-license-identifier:{expression()}\n"]) for _ in range(rng.randint(0, 6))]
        texts.append(" ".join(pieces))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df).select("row.text", "labels", "score", "allowed").collect():
        said = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))) + " "
        names, weights, values = set(), {}, []
        for kind, table in (("base", licenses.BASE), ("notice", licenses.NOTICES)):
            for phrase, name in table.items():
                if f" {phrase} " in said:
                    names.add(name)
                    weights[kind, phrase] = 0.6 if kind == "base" else 0.8
        for line in re.findall(r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)", r.text):
            try:
                value, own = read_expression(line)
                names |= own
                weights["tag", str(licenses.postfix(line))] = 0.95 if own else 0.3
            except ValueError:
                value = False
                weights["tag", "None"] = 0.3
            values.append(value)
        assert set(r.labels) == names
        assert r.score == pytest.approx(1 - math.prod(1 - w for w in weights.values()))
        assert r.allowed == (all(values) if values else names <= set(licenses.ALLOWED) if names else None)


@pytest.mark.parametrize(("said", "parts"), [("MIT", ["MIT"]), ("a OR b AND c", ["a", "b", "c", "and", "or"]), ("(a or b) and c", ["a", "b", "or", "c", "and"]), ("a with x or b", ["a", "x", "with", "b", "or"]), ("a b", None), ("(a", None), ("or a", None), ("", None), ("MIT -->", ["MIT"])])
def test_expressions(said, parts):
    assert licenses.postfix(said) == parts


def test_expression_values():
    ok = frozenset({"mit"})
    assert licenses.evaluate(licenses.postfix("MIT OR GPL-3.0"), ok) == (True, {"mit", "gpl"})
    assert licenses.evaluate(licenses.postfix("MIT AND GPL-3.0"), ok) == (False, {"mit", "gpl"})
    assert licenses.evaluate(licenses.postfix("LGPL-2.1 WITH exception"), ok) == (False, {"lgpl"})
    assert licenses.evaluate(licenses.postfix("MIT OR banana-7"), ok) == (True, {"mit"})
    assert licenses.evaluate(licenses.postfix("MIT AND banana-7"), ok) == (False, {"mit"})
    assert licenses.evaluate(licenses.postfix("MIT WITH Classpath-exception-2.0"), ok) == (True, {"mit"})
    assert licenses.evaluate(licenses.postfix("MIT WITH nonsense"), ok) == (False, {"mit"})


@pytest.mark.parametrize(
    ("licence", "name"),
    [
        ("MIT", "mit"), ("MIT-0", "mit"), ("GPL-2.0-only", "gpl"), ("GPL-2.0+", "gpl"), ("LGPL-2.1-or-later", "lgpl"), ("BSD-3-Clause", "bsd"), ("BSD-3-Clause-No-Nuclear-License-2014", "bsd"),
        ("CC-BY-NC-SA-3.0-IGO", "cc-by-nc-sa"), ("Apache-2.0", "apache"), ("Beerware", "beerware"), ("NTP", "ntp"), ("AAL", "aal"), ("Zend-2.0", "zend"), ("NASA-1.3", "nasa"), ("Intel", "intel"),
        ("SISSL-1.2", "sissl"), ("Watcom-1.0", "watcom"), ("RPL-1.5", "rpl"), ("Xnet", "xnet"), ("CATOSL-1.1", "catosl"), ("CNRI-Python", "cnri-python"), ("LiLiQ-P-1.1", "liliq-p"), ("Fair", "fair"),
        ("Frameworx-1.0", "frameworx"), ("SimPL-2.0", "simpl"), ("LicenseRef-own", "licenseref"), ("DocumentRef-a:LicenseRef-b", "licenseref"), ("LicenseRef", None),
        ("MIT-nonsense", None), ("GPL-banana-7", None), ("MITX", None), ("Apache 2", None), ("GPL-", None), ("", None), ("banana", None),
    ],
)
def test_licence_ids(licence, name):
    assert licenses.label(licence) == name


def near(have):
    """(whether row k is the first of its group, pairs within the radius but over three bits, pairs beyond it) of rows (id, text) in the order of ids."""
    runs = [words(lower(t)) for _, t in have]
    grams = [[tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else [] for w in runs]
    sets = [set(g) for g in grams]
    fp = []
    for g in grams:
        h = [xxhash.xxh64_intdigest(b" ".join(x), seed=42) for x in g]
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(have)))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    missed = far = 0
    for j in range(len(have)):
        for i in range(j):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                apart = (fp[i] ^ fp[j]).bit_count()
                missed, far = missed + (apart > simhash.NEAR_RADIUS), far + (3 < apart <= simhash.NEAR_RADIUS)
                if sets[i] == sets[j] or apart <= simhash.NEAR_RADIUS:
                    x, y = sorted((of(i), of(j)))
                    root[y] = x
    return [of(k) == k for k in range(len(have))], far, missed


@pytest.mark.parametrize("rows", [20_000, 7])
def test_near_copies(spark, small, docs, rows):
    """Copies with up to seven of 120 words changed, and texts that share less than 0.8, against all pairs."""
    rng = random.Random(5)
    texts = []
    for g in range(6):
        base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
        for k in range(8):
            copy = list(base)
            for at in rng.sample(range(120), k):
                copy[at] = f"v{rng.randrange(10_000)}"
            texts.append(" ".join(copy) + (" \n" if g % 2 else ""))
    more = spark.createDataFrame([(9000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    more = more.unionByName(small.select("doc_id", "text")).unionByName(docs.where("doc_id is null or doc_id = 4 or doc_id > 6").select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    have = sorted((r.doc_id, r.text) for r in more.where("doc_id is not null").collect())
    first, far, missed = near(have)
    assert far > 10 > missed
    kept = simhash.keep_near(more, bucket_rows=rows)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [i for (i, _), x in zip(have, first, strict=True) if x]
    assert kept.where("doc_id is null").count() == more.where("doc_id is null").count()


def test_rows_that_repeat_an_id(spark, docs):
    """Two texts under one id are two documents; of equal rows one stays; columns of any name pass."""
    one, two = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    df = spark.createDataFrame([(1, one, 1, 2), (1, two, 1, 2), (1, two, 1, 2), (2, two + " end", 1, 2), (3, None, 1, 2), (4, " ", 1, 2)], "doc_id long, text string, t int, r int")
    for keep in (simhash.keep_near, simhash.keep_one):
        kept = keep(df)
        assert kept.columns == df.columns
        got = sorted((r.doc_id, r.text or "") for r in kept.collect())
        assert got[:2] == [(1, one), (1, two)] and got[-1] == (3, "")
        assert len(got) == 3 or keep is simhash.keep_one  # one word of 51 more can be over three bits
    assert simhash.keep_near(docs.limit(0)).count() == 0


# The pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    kept = {r.doc_id for r in quality.judge(small).where("kept").select("row.doc_id").collect()}
    rows = sorted((r.doc_id, r.text) for r in small.collect() if r.doc_id in kept)
    seen, texts = set(), {}
    for i, t in rows:
        out = []
        for c in chunked(t):
            multi = several(c)
            if multi and "\n".join(c) in seen:
                continue
            if multi:
                seen.add("\n".join(c))
            out += c
        clean = "\n".join(out)
        if clean == t or re.search(r"[^ \t\r\f\v\n]", clean):
            texts[i] = clean
    have = sorted(texts.items())
    left = [i for (i, _), x in zip(have, near(have)[0], strict=True) if x]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [i for i, x in zip(left, leaks([texts[i] for i in left], items), strict=True) if not x[-1]]
    assert sorted(got) == left
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    assert all(list(got[i].ids) == t.encode(texts[i], add_special_tokens=False).ids for i in left)


def test_stages_of_odd_rows(spark, docs):
    """Null and repeated ids, null, empty and very long texts, repeated rows, and columns with the stages' own names."""
    import corpus_pipeline

    plain = [f"{w} and some more words of a plain text, number {k} of a few, told in a line of its own" for k, w in enumerate(("one", "two", "three", "four"))]
    more = spark.createDataFrame([(50, plain[0]), (50, plain[1]), (50, plain[1]), (None, plain[2]), (None, plain[2]), (51, plain[3]), (None, None), (52, "")], "doc_id long, text string")
    now = docs.unionByName(more, allowMissingColumns=True).withColumns({"n_chars": F.lit(1).cast("long"), "t": F.lit(1), "s": F.lit(2), "hits": F.lit(3), "clean": F.lit("x"), "_1": F.lit(4)})
    names = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, SF)
        assert k == 4 or now.columns == names
    got = Counter((r.doc_id, r.n_tokens > 0) for r in now.collect())
    assert got[50, True] == 2 and got[51, True] == 1 and got[None, True] == 2 and got[52, True] == got[52, False] == 0


def test_stages_of_an_empty_table(spark, empty):
    import corpus_pipeline

    now = empty.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0
        if "text" not in now.columns:
            break

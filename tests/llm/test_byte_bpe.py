"""Byte-level encoding against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tendril.llm import byte_bpe, classes
from tendril.llm.queries import QUERIES

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(spark, library, texts, pattern=P.PATTERN, path=PATH):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.row.doc_id: r.ids for r in byte_bpe.encode(df, path, pattern).collect()}
    for i, t in enumerate(texts):
        assert got[i] == library.encode_ordinary(t or ""), t


def test_every_code_point(spark, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[k : k + 4096])) for k in range(0, len(points), 4096)]
    some = random.Random(1).sample(points, 3000) + [c for table in (classes.LETTERS, classes.NUMBERS) for a, b in table for c in {a - 1, a, b, b + 1}]
    same(spark, library, texts[:40] + ["".join(f"a{chr(c)} {chr(c)}1{chr(c)}." for c in some[k : k + 200]) for k in range(0, len(some), 200)])


def test_classes_of_all_code_points():
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    ranks = {bytes([b]): b for b in range(256)}
    for pattern in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]", r"\S"):
        theirs = bytes(tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)).decode()
        assert "".join(classes.finder(pattern).findall(text)) == theirs
        assert "".join(classes.finder(pattern, True).findall(text[:256])) == "".join(c for c in theirs if ord(c) < 256)


def test_odd_texts(spark, library):
    same(spark, library, [None, "", " ", "  \n\n  ", "a", "'s 'S don't we'll", " " * 3000, "a" * 5000, "ab" * 2000, "aaab" * 700, "　x\u0085y", "é" * 999, "😀" * 400, "日本語" * 300, "<|endoftext|>"])
    draw = random.Random(2)
    same(spark, library, ["".join(draw.choice("abcdeßñ") for _ in range(n)) for n in (10, 33, 100, 700)])


def test_random_texts(spark, library):
    met = []

    @settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.text(st.sampled_from("aabbcetinos  \n'.,1é日😀ſ"), max_size=60))
    def draw(t):
        met.append(t)

    draw()
    same(spark, library, met)


def test_pairs_that_come_earlier_than_what_made_them(spark, tmp_path):
    """Ranks that no training gives: a merge makes a pair of a lower rank, so that several places may not be merged at once."""
    tokens = [bytes([b]) for b in range(256)] + [b"cab", b"bab", b"aba", b"abab", b"ab", b"bb", b"aa", b"aaa", b"ca", b"aac", b"caa", b"ba", b"abb"]
    draw = random.Random(3)
    texts = ["".join(draw.choice("abc") for _ in range(draw.randint(2, 24))) for _ in range(400)]
    for k in range(4):
        own = tokens[256:]
        draw.shuffle(own)
        path = tmp_path / f"{k}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens[:256] + own)))
        ranks = {t: i for i, t in enumerate(tokens[:256] + own)}
        same(spark, tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}), texts, r"\S+", str(path))


def test_rare_pieces_stand_where_they_were(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SENT", 3)
    same(spark, library, ["the cat the cat the zzyxq the zzyxq cat", "qqqjj the", "qqqjj qqqjj zzyxq", None, "the the the"] * 3)


def test_decode_round_trip(spark):
    texts = ["a b", None, "ünï\n\n x", "😀"]
    df = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)], "doc_id bigint, text string, decoded binary")
    back = byte_bpe.decode(byte_bpe.encode(df, PATH, P.PATTERN), PATH)
    assert {r.row.row.doc_id: bytes(r.decoded) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert bytes(byte_bpe.decode(nothing, PATH).first().decoded) == b""
    assert byte_bpe.encode(df.where("false"), PATH, P.PATTERN).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_byte_bpe"](spark, sf).collect()
    assert len(got) == len(truth)
    for r in got:
        ids = library.encode_ordinary(truth[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(truth[r.doc_id].encode()).hexdigest())

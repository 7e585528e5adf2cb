"""The kept index against scoring everything."""

import random
from collections import Counter

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.operators import kept_index, lexical
from tendril.operators.kept_index import KeptIndex

TOPICS = ("a", "b")


def texts(seed, n, words=40):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(n):
        size = draw.choice([0, 1, 3, 20, 200])
        text = " ".join(draw.choices(vocabulary, [1 / (k + 1) for k in range(words)], k=size))
        rows.append((i, draw.choice(["n1", "n1", "n1", "n2", None]), draw.choice(["a", "b", "c", None]), draw.choice([text] * 9 + [None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, notice_id string, l_topic string, content string").repartition(3)


def ask(spark, *queries):
    return spark.createDataFrame([(str(k), q) for k, q in enumerate(queries)], "query_id string, text string")


def told(df):
    return sorted((r.query_id, str(r.notice_id), r.rank, r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("by_notice, topics, limit", [(False, None, 5), (True, None, 3), (False, TOPICS, 40), (True, TOPICS, 1000)])
def test_equals_full_scoring(spark, tmp_path, by_notice, topics, limit):
    chunks = frame(spark, texts(1, 900))
    queries = ask(spark, "w0", "w1 w30 w30", "w5 w39 none", "", "w38", None, " ".join(f"w{k}" for k in range(40)), "absent")
    index = KeptIndex(spark, f"{tmp_path}/i")
    for k in range(3):
        index.append(chunks.where(F.col("chunk_id") % 3 == k))
    found, read = index.best(queries, limit, by_notice=by_notice, topics=topics)
    group = ["query_id", "notice_id"] if by_notice else ["query_id"]
    assert told(found) == told(lexical.top(lexical.search(lexical.build_index(chunks), queries, topics=topics), limit, group))
    counts = read.first()
    assert 0 < counts.n_read <= counts.n_postings
    once = KeptIndex(spark, f"{tmp_path}/once")
    once.append(chunks)
    assert told(once.best(queries, limit, by_notice=by_notice, topics=topics)[0]) == told(found)


def test_skips_blocks(spark, tmp_path):
    """A frequent term says much in few chunks, and a rare one leads to chunks whose other postings are looked up."""
    rows = [(i, "n", "a", "common " * (30 if i % 200 == 0 else 1) + ("rare " if i % 1000 == 7 else "") + "other " * 20) for i in range(6000)]
    chunks = frame(spark, rows)
    index = KeptIndex(spark, f"{tmp_path}/i")
    index.append(chunks)
    queries = ask(spark, "common", "rare common", "rare")
    found, read = index.best(queries, 4)
    assert told(found) == told(lexical.top(lexical.search(lexical.build_index(chunks), queries), 4, ["query_id"]))
    counts = read.first()
    assert counts.n_postings == 2 * 6000 + 2 * 6 and counts.n_read < 0.1 * counts.n_postings


def test_uncommitted_rows_are_not_read(spark, tmp_path):
    chunks = frame(spark, texts(2, 200))
    index = KeptIndex(spark, f"{tmp_path}/i")
    index.append(chunks)
    before = told(index.best(ask(spark, "w0 w7"), 10)[0])
    for name in ("blocks", "terms"):
        lost = spark.read.parquet(f"{tmp_path}/i/{name}").withColumn("generation", F.lit("lost"))
        lost.write.partitionBy("generation", "folder").mode("append").parquet(f"{tmp_path}/i/{name}")
    assert told(index.best(ask(spark, "w0 w7"), 10)[0]) == before and len(before) == 10
    index.append(frame(spark, [(1000, "n9", "a", "w0 " * 50)]))
    assert 1000 in {r[3] for r in told(index.best(ask(spark, "w0 w7"), 1000)[0])}


def test_tokens_are_a_parameter(spark, tmp_path):
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))
    index = KeptIndex(spark, f"{tmp_path}/i", pairs)
    index.append(frame(spark, [(1, "n", "a", "abc"), (2, "n", "a", "xbcx"), (3, "n", "a", "zz")]))
    assert [r[3] for r in told(index.best(ask(spark, "bc"), 10)[0])] == [1, 2]


def test_nothing(spark, tmp_path):
    index = KeptIndex(spark, f"{tmp_path}/i")
    index.append(frame(spark, [(1, "n", "a", None), (2, None, None, "")]))
    assert told(index.best(ask(spark, "w0", ""), 3)[0]) == []


def test_blocks_are_dealt_and_not_postings(spark, tmp_path, monkeypatch):
    """Chunks that come once are put into blocks where they stand, by runs of words, null words left out of the postings alone."""
    monkeypatch.setattr(kept_index, "RUN", 50)
    rows = texts(3, 300) + [(300, None, None, "w0 w0 w3")]
    words = lambda c: F.transform(F.split(c, " "), lambda w: F.nullif(w, F.lit("w1")))
    index = KeptIndex(spark, f"{tmp_path}/i", words)
    dealt = []
    counted = DataFrame.groupBy
    monkeypatch.setattr(DataFrame, "groupBy", lambda self, *by: dealt.append(by) or counted(self, *by))
    index.append(frame(spark, rows))
    assert not any("chunk_id" in by and "term" in by for by in dealt)
    split = [(i, n, t, text.split(" ")) for i, n, t, text in rows if text is not None]
    held = spark.read.parquet(f"{tmp_path}/i/blocks").where("term is not null")
    found = held.select("term", "notice_id", "n", F.explode(F.arrays_zip("chunk_ids", "topics", "dls", "tfs")).alias("p"))
    expected = Counter((w, n, i, t, len(ws)) for i, n, t, ws in split for w in ws if w != "w1")
    assert Counter((r.term, r.notice_id, r.p.chunk_ids, r.p.topics, r.p.dls, r.p.tfs) for r in found.collect()) == Counter((*k, v) for k, v in expected.items())
    assert index.corpus()[1:] == (301, sum(len(ws) for *_, ws in split) / len(split))


def test_chunks_that_come_twice(spark, tmp_path):
    """Rows of one chunk count together, as in a search without an index."""
    chunks = frame(spark, texts(4, 200) + texts(4, 200)[:50] + [(0, "n1", "a", "w2 w2")])
    index = KeptIndex(spark, f"{tmp_path}/i")
    index.append(chunks)
    found = index.best(ask(spark, "w0 w2", "w30"), 10)[0]
    lengths = chunks.groupBy("chunk_id", "notice_id", "l_topic").agg(F.max(F.size(index.tokens("content"))).alias("dl")).agg(F.count("*"), F.avg("dl")).first()
    assert index.corpus()[1:] == tuple(lengths) and found.count() > 10

"""The feed as a stream: late pages, pages that fill up, failures, restarts."""

import json
import os

import pytest

from tendril.sources import feed_stream

ROWS = 3


@pytest.fixture
def feed(spark, tmp_path):
    folder = f"{tmp_path}/feed"
    os.makedirs(folder)

    def fetch(page):
        if os.path.exists(f"{folder}/broken-{page}"):
            raise OSError("cannot reach the feed")
        path = f"{folder}/{page}.json"
        return open(path, encoding="utf-8").read() if os.path.exists(path) else None

    def publish(n):
        for page in range(-(-n // ROWS)):
            items = [{"no": k, "title": f"공고 {k}"} for k in range(page * ROWS, min(n, (page + 1) * ROWS))]
            with open(f"{folder}/{page + 1}.json", "w", encoding="utf-8") as f:
                json.dump({"response": {"body": {"totalCount": n, "items": items}}}, f)

    spark.dataSource.register(feed_stream.item_stream("late_feed", fetch, ROWS))

    def run():
        q = spark.readStream.format("late_feed").load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted((json.loads(r.item)["no"], r.page, r.pos) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    return publish, run, folder


def want(n):
    return [(k, k // ROWS + 1, k % ROWS) for k in range(n)]


def test_late_pages(feed):
    publish, run, _ = feed
    publish(5)
    assert run() == want(5)
    assert run() == want(5)
    publish(6)  # the second page fills up
    assert run() == want(6)
    publish(14)
    assert run() == want(14)
    publish(2)  # a total that falls takes nothing back
    assert run() == want(14)


def test_failures(feed):
    publish, run, folder = feed
    publish(4)
    assert run() == want(4)
    publish(11)
    open(f"{folder}/broken-3", "w").close()
    with pytest.raises(Exception, match="cannot reach the feed|STREAM_FAILED"):
        run()
    os.remove(f"{folder}/broken-3")
    assert run() == want(11)
    os.rename(f"{folder}/4.json", f"{folder}/4.lost")
    publish(12)
    os.remove(f"{folder}/4.json")
    with pytest.raises(Exception, match="holds 0 items|STREAM_FAILED"):
        run()
    publish(13)
    got = run()
    assert got in (want(12), want(13))  # a restart may end behind the batch that it repeats
    assert run() == want(13)

"""The paged feed as a stream that goes on where it stopped.

An offset is the number of the feed's items that have been read. The first page tells how many there are now; a batch is what
lies between two offsets, one task for each page that holds some of it, each of which takes its own slice. So a page that was
half full is read again when it has more, from the place behind what was read. The feed must append at its end. A page that
can't be read, or holds fewer items than the total said, fails its task and after its retries the query, whose checkpoint
then has the offsets of the batch: a restart reads the same items again, and none twice into the sink.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .feed import PAGE_ROWS, total_count


class _Slice(InputPartition):
    def __init__(self, page: int, first: int, last: int):
        self.page, self.first, self.last = page, first, last


class _Reader(DataSourceStreamReader):
    def __init__(self, fetch: Callable[[int], str | None], rows: int):
        self.fetch, self.rows, self.seen = fetch, rows, 0

    def initialOffset(self) -> dict:
        return {"items": 0}

    def latestOffset(self) -> dict:
        """What the feed says now, but never less than it said before."""
        self.seen = max(self.seen, total_count(self.fetch(1)))
        return {"items": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["items"], max(start["items"], end["items"])
        pages = range(first // self.rows, -(-last // self.rows))
        return [_Slice(k + 1, max(first - k * self.rows, 0), min(last - k * self.rows, self.rows)) for k in pages]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        body = self.fetch(partition.page)
        items = json.loads(body)["response"]["body"]["items"] if body is not None else []
        own = items[partition.first : partition.last]
        if len(own) < partition.last - partition.first:
            raise OSError(f"page {partition.page} holds {len(items)} items, not {partition.last}")
        for k, item in enumerate(own, partition.first):
            yield partition.page, k, json.dumps(item, ensure_ascii=False, sort_keys=True)

    def commit(self, end: dict) -> None:
        """Nothing to give up: the feed keeps its items."""


def item_stream(name: str, fetch: Callable[[int], str | None], rows: int = PAGE_ROWS) -> type[DataSource]:
    """A streaming data source of (page, pos, item), the item as JSON; ``fetch`` gets a page's JSON text, None beyond the last."""

    class Items(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page int, pos int, item string"

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(fetch, rows)

    return Items

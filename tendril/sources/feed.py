"""The paged JSON feed: a data source, its envelope, and the selection of notices."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import file_priority, parse_long, parse_time

#: The category codes and names that the feed's selection takes.
CATEGORIES = {
    "81111513": "클라우드서비스",
    "81111595": "클라우드지원서비스",
    "81111596": "클라우드융합서비스",
    "81111594": "생성형AI업무지원서비스",
    "81111599": "정보시스템개발서비스",
    "81111598": "패키지소프트웨어개발및도입서비스",
    "81112002": "데이터서비스",
    "80101507": "정보화전략계획서비스",
    "80101698": "정보화프로젝트관리서비스(PMO)",
    "81111799": "정보인프라구축서비스",
    "81111801": "컴퓨터네트워크또는인터넷보안서비스",
    "81111809": "컴퓨터시스템설치",
    "81111708": "정보통신설계용역",
    "81151699": "공간정보DB구축서비스",
    "81111899": "정보시스템유지관리서비스",
    "81112399": "전산장비유지관리서비스",
    "81112299": "소프트웨어유지및지원서비스",
    "81111811": "운영위탁서비스",
    "81112199": "인터넷지원개발서비스",
    "80141619": "고객센터운영서비스",
}
#: What the feed's fields are called.
FIELDS = {"notice_no": "bidNtceNo", "title": "bidNtceNm", "demand_org": "dminsttNm", "budget": "asignBdgtAmt", "code": "pubPrcrmntClsfcNo", "code_name": "pubPrcrmntClsfcNm", "joint_venture_method": "cmmnSpldmdMethdNm", "deadline": "bidClseDt", "file": "ntceSpecFileNm", "url": "ntceSpecDocUrl"}
ATTACHMENTS, WANTED = 20, "제안"
PAGE_ROWS = 500


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def total_count(body: str | None) -> int:
    """What a page says of the feed's number of items; 0 if it says nothing."""
    try:
        return int(json.loads(body or "{}")["response"]["body"].get("totalCount", 0))
    except (ValueError, KeyError, TypeError, AttributeError):
        return 0


class _Reader(DataSourceReader):
    def __init__(self, fetch: Callable[[int], str | None], pages: int | None, rows: int):
        self.fetch, self.pages, self.rows = fetch, pages, rows

    def partitions(self) -> list[InputPartition]:
        pages = self.pages
        if pages is None:
            try:
                pages = -(-total_count(self.fetch(1)) // self.rows)
            except Exception:  # the first page's task tells the error
                pages = 1
        return [_Page(k + 1) for k in range(max(1, pages))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            body = self.fetch(partition.number)
        except Exception as e:  # the pages that could be read are kept
            yield partition.number, None, str(e)
            return
        if body is not None:
            yield partition.number, body, None


def page_source(name: str, fetch: Callable[[int], str | None], pages: int | None = None, rows: int = PAGE_ROWS) -> type[DataSource]:
    """A data source of (page, body, error), one task a page; ``fetch`` gets a page's JSON text, None beyond the last.

    Without ``pages`` their number comes from the total that the first page tells, at ``rows`` items a page. Pages are
    fetched side by side; ``until_end`` leaves those that reading one after another would have come to.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page int, body string, error string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, pages, rows)

    return Pages


def until_end(pages: DataFrame, by: str | None = None) -> DataFrame:
    """The pages before the first that failed or is empty, and none beyond the one that completes the total.

    pages: (by, page, n_items, error, total); a total of 0 ends a feed behind its first page.
    """
    order = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy("page")  # a row for each page
    over = F.max(F.when(F.col("error").isNotNull() | (F.coalesce("n_items", F.lit(0)) == 0), 1).otherwise(0)).over(order)
    before = F.coalesce(F.sum("n_items").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pages.withColumns({"_over": over, "_before": before, "_first": F.row_number().over(order) == 1})
    return rows.where("_over = 0 and (_first or _before < coalesce(total, 0))").drop("_over", "_before", "_first")


def storable(parsed: DataFrame) -> DataFrame:
    """Parsed notices (status, markdown) that are stored, as PENDING: without Markdown a notice is not."""
    return parsed.where("status = 'ok' and markdown != ''").drop("status").withColumn("parse_status", F.lit("PENDING"))


def items(envelopes: DataFrame, order: str = "page", path: str = "response.body.items") -> DataFrame:
    """(page, pos, item) of parsed envelopes; an empty page has no items."""
    return envelopes.select(order, F.posexplode(F.col(path)).alias("pos", "item"))


def best_attachment(names: Column, urls: Column, wanted: str = WANTED) -> Column:
    """struct<priority, pos, name, url> of the attachment of least priority (3 at most), the first of equals; else null."""
    pairs = F.transform(names, lambda n, k: F.struct(file_priority(n).alias("priority"), k.alias("pos"), n.alias("name"), F.get(urls, k).alias("url")))
    return F.array_min(F.filter(pairs, lambda p: F.contains(p["name"], F.lit(wanted)) & (p["priority"] <= 3)))


def select_notices(feed: DataFrame, now: Column, codes: tuple[str, ...] = tuple(CATEGORIES), wanted: str = WANTED) -> DataFrame:
    """Notices of a feed (page, pos, notice_no, code, title, budget, deadline, names, urls, ...).

    Of rows with one number the first by page and place counts, among those of the listed codes and before the other
    conditions; it needs an attachment and a deadline that isn't over at ``now``.
    """
    first = Window.partitionBy("notice_no").orderBy("page", "pos")
    rows = feed.where(F.col("code").isin(*codes)).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    rows = rows.withColumns({"file": best_attachment(F.col("names"), F.col("urls"), wanted), "bid_deadline": parse_time(F.col("deadline"))})
    rows = rows.where(F.col("file").isNotNull() & (F.col("bid_deadline") >= now))
    return rows.select("notice_no", "code", "title", parse_long(F.col("budget")).alias("budget_krw"), "bid_deadline", F.col("file.name").alias("file_name"), F.col("file.url").alias("file_url"))

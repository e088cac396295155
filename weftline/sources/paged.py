"""Scans that are pulled page by page and stop: a Python data source over anything that gives numbered pages.

In batch, pages are the partitions; pull_until reads them a few at a time, in order, until a quota of good rows is full. As a
stream, the offset is the next page and the rows so far, and the checkpoint goes on from there; at the quota it stands still.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..storage import written

#: A page's rows (tuples in the schema's order) by its number; None behind the last page.
Fetch = Callable[[int], Sequence[tuple] | None]


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


def paged_source(name: str, schema: str, fetch: Fetch) -> type[DataSource]:
    """A data source for spark.dataSource.register, read by format(name).

    Options: first and pages (batch: the range of pages, a partition each), quota (stream: no page is pulled once so many rows
    have been given) and batch_pages (stream: pages a micro-batch). Rows come with _page and _at, their page and place in it.
    """
    full = f"{schema}, _page long, _at long"

    def rows_of(number: int) -> Iterator[tuple]:
        for at, row in enumerate(fetch(number) or ()):
            yield (*row, number, at)

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.first, self.pages = int(options.get("first", 0)), int(options.get("pages", 1))

        def partitions(self) -> Sequence[InputPartition]:
            return [Page(n) for n in range(self.first, self.first + self.pages)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return rows_of(partition.number)

    class StreamReader(SimpleDataSourceStreamReader):
        def __init__(self, options: dict) -> None:
            self.quota, self.batch_pages = int(options.get("quota", 0)), int(options.get("batch_pages", 1))

        def initialOffset(self) -> dict:
            return {"page": 0, "rows": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            found, page, rows = [], start["page"], start["rows"]
            for _ in range(self.batch_pages):
                if self.quota and rows >= self.quota or (got := fetch(page)) is None:
                    break
                taken = list(got)[: self.quota - rows if self.quota else None]
                found += [(*row, page, at) for at, row in enumerate(taken)]
                page, rows = page + 1, rows + len(taken)
            return iter(found), {"page": page, "rows": rows}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            out, rows = [], start["rows"]
            for page in range(start["page"], end["page"]):
                taken = list(fetch(page) or ())[: self.quota - rows if self.quota else None]
                out += [(*row, page, at) for at, row in enumerate(taken)]
                rows += len(taken)
            return iter(out)

        def commit(self, end: dict) -> None:
            pass

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return full

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return StreamReader(self.options)

    return Paged


def pull_until(spark: SparkSession, name: str, quota: int, good: Column | None = None, pages_at_a_time: int | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """The first quota rows (by page and place) of a registered paged source for which good holds, and where the scan stopped.

    pages_at_a_time pages are pulled side by side (default: one a core) and written; with the quota full, or after a round in
    which all pages were empty, or at page last, none is pulled any more. The result's `next_page` is where a later scan goes on.
    """
    step = pages_at_a_time or spark.sparkContext.defaultParallelism
    out, have, page = None, 0, first
    while have < quota and (last is None or page < last):
        pages = step if last is None else min(step, last - page)
        rows = spark.read.format(name).option("first", page).option("pages", pages).load()
        marked = rows.withColumn("_good", F.coalesce(good, F.lit(False)) if good is not None else F.lit(True))
        pulled = written(marked, "pages", F.count(F.lit(1)).alias("n"), F.count_if("_good").alias("good"))
        page += pages
        if not pulled.measured["n"]:
            break
        have += pulled.measured["good"]
        kept = pulled.where("_good").drop("_good")
        out = kept if out is None else out.unionByName(kept)
    if out is None:
        out = spark.read.format(name).option("first", first).option("pages", 1).load().limit(0)
    result = out.orderBy("_page", "_at").limit(quota)
    result.next_page = page
    return result

"""A dated feed read page by page: a Spark data source for tables and streams.

A feed is a folder of windows of days, named by their last day, and of pages in
them, named by the index of their first record: what a paged web interface
answers, one JSON document a page. A page is one partition, or of a feed of many
pages up to LOT of them are, so pages are read in parallel and a lost task reads
its pages again. On a stream the offset is the last day of a window; a trigger
reads the windows published since.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "window_end date, start_index bigint, document string"
NAME = "paged_feed"


@dataclass
class Page(InputPartition):
    """One page of a window; ``path`` is its folder."""

    window_end: str
    start_index: int
    path: str


@dataclass
class Lot(InputPartition):
    """Pages that one task reads."""

    pages: list[Page]


#: Pages of a task at most, and tasks that a feed has before one takes two pages.
LOT = 64


def lots(pages: list[Page]) -> list[Lot]:
    """Pages dealt to tasks: one each while they are few, else runs of up to LOT."""
    size = min(LOT, max(1, len(pages) // LOT))
    return [Lot(pages[k : k + size]) for k in range(0, len(pages), size)]


class Feed:
    """Windows and pages of a folder on any file system that Arrow opens."""

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def windows(self) -> list[str]:
        """Last days of the published windows, in order."""
        system, root = self._open()
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name.removeprefix("window_end=") for f in found if f.base_name.startswith("window_end="))

    def pages(self, after: str | None, through: str | None) -> list[Page]:
        """Pages of the windows after one day, through another; their number follows from the total that a first page states."""
        system, root = self._open()
        out = []
        for end in self.windows():
            if (after and end <= after) or (through and end > through):
                continue
            folder = f"{root}/window_end={end}"
            first = json.loads(self._text(system, f"{folder}/start_index=0"))
            step = max(1, first["resultsPerPage"])
            out += [Page(end, k, f"{folder}/start_index={k}") for k in range(0, max(1, first["totalResults"]), step)]
        return out

    @staticmethod
    def _text(system: fs.FileSystem, folder: str) -> str:
        files = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-")]
        return "".join(system.open_input_stream(f).read().decode() for f in sorted(files))

    def read(self, lot: Lot | None) -> Iterator[tuple]:
        """Records of some pages, one page held at a time; a feed without pages is read as none."""
        system, _ = self._open()
        for page in lot.pages if lot else []:
            end = dt.date.fromisoformat(page.window_end)
            for record in json.loads(self._text(system, page.path))["vulnerabilities"]:
                yield end, page.start_index, json.dumps(record["cve"])


class FeedReader(DataSourceReader):
    """Windows after the option ``after`` through ``through``; all where these are not given."""

    def __init__(self, options: dict):
        self.feed, self.after, self.through = Feed(options["path"]), options.get("after"), options.get("through")

    def partitions(self) -> list[Lot]:
        return lots(self.feed.pages(self.after, self.through))

    def read(self, partition: Lot) -> Iterator[tuple]:
        return self.feed.read(partition)


class FeedStream(DataSourceStreamReader):
    """Offsets are window ends; a batch is the pages of the windows between two."""

    def __init__(self, options: dict):
        self.feed, self.after = Feed(options["path"]), options.get("after", "")

    def initialOffset(self) -> dict:
        return {"window_end": self.after}

    def latestOffset(self) -> dict:
        return {"window_end": max([self.after, *self.feed.windows()])}

    def partitions(self, start: dict, end: dict) -> list[Lot]:
        return lots(self.feed.pages(start["window_end"] or None, end["window_end"]))

    def read(self, partition: Lot) -> Iterator[tuple]:
        return self.feed.read(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedFeed(DataSource):
    """``spark.read.format("paged_feed").load(folder)``, or ``readStream``; options after and through are days."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(dict(self.options))


def feed(spark: SparkSession, folder: str, streaming: bool = False, **options: str) -> DataFrame:
    """Records (window_end, start_index, document) of a feed."""
    spark.dataSource.register(PagedFeed)
    source = spark.readStream if streaming else spark.read
    return source.format(NAME).options(**options).load(folder)


def publish(records: DataFrame, folder: str, day: str, key: str, document: str, first: dt.date, days: int, page: int) -> None:
    """Write records as the pages of a feed: windows of ``days`` from ``first`` on, records in order of day and key.

    A record's place in its window is its place in its day after those of the
    days before, so no task orders more than a day; a page is one row.
    """
    rows = records.select(F.col(day).alias("day"), F.col(key).alias("key"), F.col(document).alias("document"))
    k = F.floor(F.datediff("day", F.lit(first)) / days).cast("int")
    rows = rows.withColumn("window_end", F.date_add(F.lit(first), k * days + (days - 1)))
    counts = rows.groupBy("window_end", "day").agg(F.count("*").alias("n"))
    order = Window.partitionBy("window_end").orderBy("day")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("window_end", "day", before.alias("before"), F.sum("n").over(Window.partitionBy("window_end")).alias("total"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("key")) - 1
    placed = rows.withColumn("place", place).join(counts, ["window_end", "day"]).withColumn("place", F.col("place") + F.col("before"))
    paged = placed.withColumn("start_index", (F.floor(F.col("place") / page) * page).cast("bigint"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "document"))), lambda r: F.concat(F.lit('{"cve":'), r["document"], F.lit("}"))), ",")
    pages = paged.groupBy("window_end", "start_index").agg(F.max("total").alias("total"), body.alias("body"))
    text = F.format_string('{"resultsPerPage":%d,"startIndex":%d,"totalResults":%d,"vulnerabilities":[%s]}', F.lit(page), F.col("start_index"), F.col("total"), F.col("body"))
    pages.select("window_end", "start_index", text.alias("value")).write.mode("append").partitionBy("window_end", "start_index").text(folder)

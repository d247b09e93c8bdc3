"""Paged listings as a Python data source: filters go to the service, pages are partitions, venues have caps, and a stream takes pages as they come.

A service is any object with ``pages(venue)``, the number of a venue's pages, and ``page(venue, number, least_year)``, the items of one (dicts with ``id``, ``title``,
``year``).  Filters on venue, page and year are taken over by the source: others' pages are not asked for, and the year goes along with the request.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

SCHEMA = "venue string, page int, place int, id string, title string, year int, body string, error string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Tasks of a listing, about, beyond which neighbouring pages share one; written pages in a file.
TASKS, SHELF = 64, 64


class Service(Protocol):
    def pages(self, venue: str) -> int: ...

    def page(self, venue: str, number: int, least_year: int | None) -> list[dict]: ...


@dataclass
class Page(InputPartition):
    """One page of a venue; ``left`` items of the venue's cap remain for it, if there is a cap."""

    venue: str
    number: int
    left: int | None


@dataclass
class Pages(InputPartition):
    """Neighbouring pages of a venue, asked for one after the other by one task."""

    venue: str
    pages: tuple[Page, ...]


def _rows(service: Service, part: Page, year: int | None, waits: tuple[float, ...]) -> Iterator[tuple]:
    """A page's items; a page that fails after its waits is one row with the error."""
    for wait in (*waits, None):
        try:
            items = service.page(part.venue, part.number, year)
            break
        except Exception as e:  # one page's failure leaves the others alone
            if wait is None:
                yield part.venue, part.number, None, None, None, None, None, f"{type(e).__name__}: {e}"
                return
            time.sleep(wait)
    for place, x in enumerate(items[: part.left]):
        yield part.venue, part.number, place, str(x.get("id")), x.get("title"), x.get("year"), json.dumps(x, sort_keys=True), None


class Reader(DataSourceReader):
    def __init__(self, service: Service, venues: list[str], size: int, cap: int | None, waits: tuple[float, ...]):
        self.service, self.venues, self.size, self.cap, self.waits = service, venues, size, cap, waits
        self.year: int | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over what the service or the choice of pages can do; the rest is Spark's."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if name == "venue" and isinstance(f, EqualTo):
                self.venues = [v for v in self.venues if v == f.value]
            elif name == "venue" and isinstance(f, In):
                self.venues = [v for v in self.venues if v in f.value]
            elif name == "year" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.year = max(self.year or 0, f.value + isinstance(f, GreaterThan))
            elif name == "page" and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), f.value if self.high is None else min(self.high, f.value)
            elif name == "page" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == "page" and isinstance(f, (LessThan, LessThanOrEqual)):
                top = f.value - isinstance(f, LessThan)
                self.high = top if self.high is None else min(self.high, top)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = {v: self._pages(v) for v in self.venues}
        width = -(-sum(map(len, found.values())) // TASKS)  # one up to TASKS pages
        out: list[InputPartition] = [Pages(v, tuple(p[i : i + width])) for v, p in found.items() for i in range(0, len(p), width)]
        return out or [Pages("", ())]

    def _pages(self, venue: str) -> list[Page]:
        last, out = self.service.pages(venue) - 1, []
        for n in range(self.low, (last if self.high is None else min(last, self.high)) + 1):
            left = None if self.cap is None else min(self.size, self.cap - n * self.size)
            if left is None or left > 0:
                out.append(Page(venue, n, left))
        return out

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in partition.pages:
            yield from _rows(self.service, page, self.year, self.waits)


class Listing(SimpleDataSourceStreamReader):
    """Takes the next page of every venue at a time; the offset is the page's number, so a restart goes on where it was."""

    def __init__(self, service: Service, venues: list[str], size: int, waits: tuple[float, ...]):
        self.service, self.venues, self.size, self.waits = service, venues, size, waits

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["page"]
        open_ = [v for v in self.venues if n < self.service.pages(v)]
        rows = [row for v in open_ for row in _rows(self.service, Page(v, n, None), None, self.waits)]
        return iter(rows), {"page": n + bool(open_)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for n in range(start["page"], end["page"]):
            for v in self.venues:
                if n < self.service.pages(v):
                    yield from _rows(self.service, Page(v, n, None), None, self.waits)


def source(service: Service, venues: list[str], size: int = 200, cap: int | None = None, waits: tuple[float, ...] = ()) -> type[DataSource]:
    """A data source class for a service; ``cap`` is the most items of a venue, ``waits`` the seconds before a failed page is asked for again."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_listing"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(service, venues, size, cap, waits)

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Listing(service, venues, size, waits)

    return Pages


def venue_cap(total: int, venues: int, least: int = 5) -> int:
    """Items of each venue when ``total`` are wanted of all."""
    return max(least, total // max(1, venues))


def listed(spark: SparkSession, service: Service, venues: list[str], size: int = 200, cap: int | None = None, waits: tuple[float, ...] = ()) -> DataFrame:
    """The listing as a table; filters on it reach the service."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(source(service, venues, size, cap, waits))
    return spark.read.format("paged_listing").load()


def over_fetched(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of every venue that are among the wanted ids, in page order: sources that cannot filter are asked for more than is kept."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("venue").orderBy("page", "place"))
    return rows.join(wanted, "id", "left_semi").withColumn("rank", place).where(F.col("rank") <= k)


@dataclass
class Served:
    """A service over pages that Spark has written under ``root`` as Parquet, SHELF neighbouring pages of a venue in a file; reads them by Arrow where a task asks for them."""

    root: str
    counts: dict[str, int]

    @classmethod
    def write(cls, rows: DataFrame, root: str, size: int) -> Served:
        """Writes (venue, id, title, year, place) in pages of ``size`` by place; the number of pages of each venue is kept, a few venues."""
        paged = rows.withColumn("page", F.floor(F.col("place") / size).cast("int")).withColumn("shelf", F.floor(F.col("page") / SHELF).cast("int"))
        paged.repartition("venue", "shelf").sortWithinPartitions("venue", "shelf", "page", "place").write.mode("overwrite").partitionBy("venue", "shelf").parquet(root)
        counts = {r.venue: r.n for r in paged.groupBy("venue").agg((F.max("page") + 1).alias("n")).collect()}
        return cls(root, counts)

    def pages(self, venue: str) -> int:
        return self.counts.get(venue, 0)

    def page(self, venue: str, number: int, least_year: int | None) -> list[dict]:
        at = venue, number // SHELF
        if getattr(self, "_at", None) != at:  # a task asks for neighbours
            self._pages, self._at = self._shelf(*at), at
        return [r for r in self._pages.get(number, []) if least_year is None or (r["year"] or 0) >= least_year]

    def _shelf(self, venue: str, shelf: int) -> dict[int, list[dict]]:
        """The items of a shelf's pages, in order; a page is left out where it has none."""
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        system, root = fs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + self.root.removeprefix("file:"))
        out: dict[int, list[dict]] = {}
        found = system.get_file_info(fs.FileSelector(f"{root}/venue={venue}/shelf={shelf}", allow_not_found=True))
        for path in sorted(f.path for f in found if f.path.endswith(".parquet")):
            for r in pq.read_table(path, filesystem=system, partitioning=None).to_pylist():
                out.setdefault(r.pop("page"), []).append(r)
        return {n: sorted(rows, key=lambda r: r["place"]) for n, rows in out.items()}

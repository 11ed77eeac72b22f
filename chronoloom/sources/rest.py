"""A paged REST source: one input partition per page, or scans of one resource after another until an empty page."""

from __future__ import annotations

import json
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class PageLost(RuntimeError):
    """A page that could not be had: the task fails, and Spark tries it again."""


def wait_after(error: Exception, attempt: int, step: float, now: float) -> float | None:
    """Seconds to wait before the next attempt: until a rate limit ends, longer with each attempt otherwise; None if none would help."""
    if isinstance(error, urllib.error.HTTPError):
        headers = error.headers or {}
        if error.code in (403, 429):
            reset, pause = headers.get("X-RateLimit-Reset"), headers.get("Retry-After")
            return max(0.0, float(reset) - now) + 1 if reset else float(pause) if pause else step * attempt
        return step * attempt if error.code >= 500 else None
    return step * attempt


def load(url: str, attempts: int = 3, step: float = 2.0, open_url=urllib.request.urlopen, sleep=time.sleep):
    """The JSON at a URL. Raises PageLost where it cannot be had, so that no page is taken for an empty one."""
    for attempt in range(1, attempts + 1):
        try:
            with open_url(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=30) as answer:
                return json.loads(answer.read())
        except (OSError, ValueError) as e:
            pause = wait_after(e, attempt, step, time.time())
            if pause is None or attempt == attempts:
                raise PageLost(f"{url}: {e}") from e
            sleep(pause)
    raise PageLost(url)


def until_empty(page_url: Callable[[int], str], load_page: Callable[[str], list] = load) -> Iterator[tuple[int, object]]:
    """Items of pages 1, 2, ... with their page's number, up to the first page without items."""
    number = 1
    while items := load_page(page_url(number)):
        for item in items:
            yield number, item
        number += 1


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PagesReader(DataSourceReader):
    """pages pages, one a partition; without that option all pages up to an empty one, in one partition."""

    def __init__(self, options, load_page: Callable[[str], list] = load):
        self.url, self.pages, self.load_page = options["url"], int(options.get("pages", 0)), load_page

    def partitions(self):
        return [Page(n) for n in range(1, self.pages + 1)] if self.pages else [Page(0)]

    def read(self, partition):
        at = lambda n: self.url.replace("{page}", str(n))
        items = ((partition.number, i) for i in self.load_page(at(partition.number))) if partition.number else until_empty(at, self.load_page)
        for number, item in items:
            yield (number, json.dumps(item))


class RestPages(DataSource):
    """spark.dataSource.register(RestPages); spark.read.format("rest_pages").option("url", "https://…&page={page}").option("pages", 3).load()"""

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "page INT, item STRING"

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)


def dependent(keys: DataFrame, key: str, url: str, load_page: Callable[[str], list] = load) -> DataFrame:
    """For each distinct key all items of its own pages, as of the comments or the timeline of an issue: key, page, item (JSON).

    url holds {key} and {page}. A key's pages are read one after another until an empty one, many keys at once in many tasks. A null key
    is left out; a key without items gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                rows = list(until_empty(lambda n, v=value: url.replace("{key}", str(v)).replace("{page}", str(n)), load_page))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([value] * len(rows), batch.column(0).type), pa.array([n for n, _ in rows], pa.int32()), pa.array([json.dumps(i) for _, i in rows])], [key, "page", "item"])

    kind = keys.schema[key].dataType.simpleString()
    return keys.select(key).where(F.col(key).isNotNull()).distinct().mapInArrow(run, f"{key} {kind}, page int, item string")

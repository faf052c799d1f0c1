"""A registry that is served page by page as a Spark data source: one partition a page, pruned by pushed filters, and pages that
cannot be read are told as rows instead of failing the job."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..session import ship

SCHEMA = "state string, page int, row int, cells array<string>, error string"


@dataclass
class Page(InputPartition):
    state: str
    page: int
    url: str


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = [Page(p["state"], int(p["page"]), p["url"]) for p in json.loads(options.get("pages", "[]"))]
        self.attempts = int(options.get("attempts", "3"))
        self.timeout = float(options.get("timeout", "30"))
        self.pause = float(options.get("pause", "0.5"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of ``state`` and ``page`` choose partitions; Spark applies all other filters itself."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("state", "page") and isinstance(f, (EqualTo, EqualNullSafe, In)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.pages = [p for p in self.pages if getattr(p, column) in wanted]
            else:
                yield f

    def partitions(self) -> list[Page]:
        return self.pages

    def fetch(self, url: str) -> list:
        """The rows of a page. Attempts that fail are repeated after a pause that doubles."""
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    rows = json.load(answer)
                break
            except (OSError, ValueError):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.pause * 2**attempt)
        if not isinstance(rows, list):
            raise ValueError(f"expected an array, got {type(rows).__name__}")
        return rows

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # Spark's way to read a source without partitions
            return
        at = (partition.state, partition.page)
        try:
            rows = self.fetch(partition.url)
        except (OSError, ValueError) as failed:
            yield (*at, None, None, f"{type(failed).__name__}: {failed}")
            return
        for i, row in enumerate(rows):
            cells = row if isinstance(row, list) else [row]
            yield (*at, i, [None if c is None else c if isinstance(c, str) else json.dumps(c) for c in cells], None)


class PagedRegistry(DataSource):
    """Options: ``pages``, a JSON array of (state, page, url) at any scheme that ``urllib`` opens; ``attempts``, ``timeout`` and ``pause`` in
    seconds for each page."""

    @classmethod
    def name(cls) -> str:
        return "paged_registry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(self.options)


def read_pages(spark: SparkSession, pages: list[dict], **options) -> DataFrame:
    """Rows (``state``, ``page``, ``row``, ``cells``, ``error``) of the pages listed; a page that cannot be read is one row with an ``error``.

    A listing holds a few entries a state, so it goes through the driver; the pages are read where the rows are used."""
    ship(spark)
    spark.dataSource.register(PagedRegistry)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged_registry").option("pages", json.dumps(pages)).options(**options).load()


def listed(spark: SparkSession, path: str) -> list[dict]:
    """Pages captured below ``state=.../page=.../`` as a listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    part = lambda name: F.url_decode(F.regexp_extract("path", f"/{name}=([^/]+)/", 1)).alias(name)
    return [r.asDict() for r in files.select(part("state"), part("page"), F.col("path").alias("url")).collect()]


def failed_pages(rows: DataFrame) -> DataFrame:
    return rows.filter("error IS NOT NULL").select("state", "page", "error")

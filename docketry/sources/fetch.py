"""A batch source of fetched pages: the seam to the network, with recorded responses as stand-in.

The reader asks `fetch(url)` for (status, body); without a network that is a
folder of recorded responses. Failed attempts are rows, not exceptions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, attempt int, success boolean, http_status int, content binary, content_hash string, error string, wait_s double"


def recorded(folder: str) -> Callable[[str], tuple[int, bytes]]:
    """Responses kept as files named by the sha256 of their address."""

    def fetch(url: str) -> tuple[int, bytes]:
        path = Path(folder, hashlib.sha256(url.encode()).hexdigest())
        if not path.exists():
            raise OSError("no recorded response")
        return 200, path.read_bytes()

    return fetch


def attempts(url: str, fetch: Callable[[str], tuple[int, bytes]], most: int = 3, base: float = 2.0) -> Iterator[tuple]:
    """A row for each attempt, up to the first success; the wait before attempt n is base * 2 ** (n - 2)."""
    if most < 1:
        raise ValueError("at least one attempt")
    for n in range(1, most + 1):
        wait = base * 2 ** (n - 2) if n > 1 else 0.0
        try:
            status, body = fetch(url)
        except OSError as x:
            yield url, n, False, None, None, None, str(x), wait
            continue
        yield url, n, True, status, body, hashlib.sha256(body).hexdigest(), None, wait
        return


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.most = options["folder"], int(options.get("attempts", 3))
        self.parts, self.urls = int(options.get("partitions", 8)), Path(options["urls"])

    def partitions(self):
        urls = self.urls.read_text().split()
        return [_Part(urls[i :: self.parts]) for i in range(self.parts) if urls[i :: self.parts]] or [_Part([])]

    def read(self, partition):
        fetch = recorded(self.folder)
        for url in partition.urls:
            yield from attempts(url, fetch, self.most)


class RecordedPages(DataSource):
    """spark.read.format("recorded_pages").options(urls=FILE, folder=DIR).load()"""

    @classmethod
    def name(cls):
        return "recorded_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_recorded(spark: SparkSession, urls: str, folder: str, tries: int = 3) -> DataFrame:
    spark.dataSource.register(RecordedPages)
    return spark.read.format("recorded_pages").options(urls=urls, folder=folder, attempts=str(tries)).load()


def allowed_by_robots(pages: DataFrame, agent: str) -> DataFrame:
    """pages (url, robots) with `allowed`; a site without a robots text allows everything."""

    @F.pandas_udf("boolean")
    def allowed(urls: pd.Series, robots: pd.Series) -> pd.Series:
        parsers: dict = {}
        out = []
        for url, text in zip(urls, robots):
            if text is None or url is None:
                out.append(True)
                continue
            if text not in parsers:
                parsers[text] = RobotFileParser()
                parsers[text].parse(text.splitlines())
            out.append(parsers[text].can_fetch(agent, url))
        return pd.Series(out)

    return pages.withColumn("allowed", allowed("url", "robots"))

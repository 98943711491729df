"""A Spark data source that fetches pages over HTTPS: spark.dataSource.register(PageSource), then
spark.read.format("web_pages").option("urls", "a\\nb").load(). Each partition fetches its share; a page that answers with
something other than HTML, or not in time, is left out."""

from __future__ import annotations

import http.client
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROBOTS_BYTES = 16 * 1024


class _Share(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.shares, self.timeout = int(options.get("partitions", "8")), float(options.get("timeout", "1"))
        self.port, self.tls = int(options.get("port", "443")), options.get("tls", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Share(self.urls[k :: self.shares]) for k in range(min(self.shares, len(self.urls)))] or [_Share([])]

    def one(self, url: str) -> str | None:
        return fetch(url, self.timeout, self.port, self.tls)

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        for url in partition.urls:
            try:
                page = self.one(url)
            except (OSError, http.client.HTTPException, ValueError):
                continue
            if page is not None:
                yield url, page


class _RobotsReader(_Reader):
    def one(self, url: str) -> str | None:
        return fetch(f"https://{url}/robots.txt", self.timeout, self.port, self.tls, kind="", most=ROBOTS_BYTES)


def fetch(url: str, timeout: float = 1.0, port: int = 443, tls: bool = True, kind: str = "text/html", most: int | None = None) -> str | None:
    """The text of a page of the given content type, of its first `most` bytes; None if the answer is of another. The port is the
    one given, whatever the URL says."""
    parts = urlsplit(url)
    link = (http.client.HTTPSConnection if tls else http.client.HTTPConnection)(parts.hostname, port, timeout=timeout)
    try:
        link.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"Accept": kind or "*/*", "Accept-Encoding": "identity", "Connection": "close"})
        answer = link.getresponse()
        if not (answer.getheader("content-type") or "").lower().startswith(kind):
            return None
        return answer.read(most).decode("utf-8", "replace")
    finally:
        link.close()


class PageSource(DataSource):
    """Options: urls (one a line), partitions (8), timeout in seconds (1), port (443), tls (true)."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class RobotsSource(DataSource):
    """(host, text) of the hosts' robots.txt as far as the crawler reads one. Options: as for pages, urls holding the hosts."""

    @classmethod
    def name(cls) -> str:
        return "robots_files"

    def schema(self) -> str:
        return "host string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _RobotsReader(self.options)

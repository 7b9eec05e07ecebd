"""Network feeds as a Python data source: one partition per repository and ref, errors as rows.

The fetcher is given by the caller as an importable function (`module:name`) so that it reaches the executors;
tests and offline runs give one that reads local data.
"""

from __future__ import annotations

import contextlib
import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.functions import urls

ATTEMPTS, BACKOFF, TIMEOUT, PAGE_TIMEOUT = 3, 1.0, 30, 25


class Permanent(Exception):
    """An answer that another attempt wouldn't change."""


def with_retries(fetch: Callable[[str], str], url: str, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> str:
    """What `fetch` gives; tried again after a growing pause unless the error is `Permanent`."""
    for attempt in range(1, attempts + 1):
        try:
            return fetch(url)
        except Permanent:
            raise
        except Exception:
            if attempt == attempts:
                raise
            wait(BACKOFF * attempt)
    raise AssertionError


def http_get(url: str) -> str:
    """The text at a public link."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": "tidemark/1.0"}), timeout=TIMEOUT) as answer:
            if answer.status != 200:
                raise Permanent(f"HTTP {answer.status}")
            return answer.read().decode("utf-8")
    except HTTPError as error:
        if error.code < 500:
            raise Permanent(f"HTTP {error.code}") from error
        raise


def folder_get(url: str) -> str:
    """The text of a file in a folder that holds a copy of repositories, on any of Arrow's file systems."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    try:
        with system.open_input_stream(path) as f:
            return f.read().decode("utf-8")
    except FileNotFoundError as error:
        raise Permanent("no such file") from error


def page_get(url: str) -> tuple[int, str, str]:
    """Status, final link and text of a public page, decoded as it declares; what can't be decoded is replaced."""
    from urllib.request import Request, urlopen

    asked = Request(url, headers={"Accept": "text/html,application/xhtml+xml", "User-Agent": "tidemark/1.0"})
    with urlopen(asked, timeout=PAGE_TIMEOUT) as answer:
        charset = answer.headers.get_content_charset() or "utf-8"
        return answer.status, answer.geturl(), answer.read().decode(charset, errors="replace")


def public_pages(links: DataFrame, fetcher: str = f"{__name__}:page_get") -> DataFrame:
    """`(url, http_status, final_url, html, error)` of the links in `url`; a link that isn't safe is never asked for."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.error import HTTPError

        module, _, name = fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for url, safe in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (url, None, None, None, "not a safe public link")
                if safe:
                    try:
                        row = (url, *fetch(url), None)
                    except HTTPError as error:
                        row = (url, error.code, None, None, f"HTTP {error.code}")
                    except Exception as error:
                        row = (url, None, None, None, f"could not fetch: {type(error).__name__}")
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["url", "http_status", "final_url", "html", "error"])

    return links.select("url", urls.safe_public(F.col("url")).alias("safe")).mapInArrow(run, "url string, http_status int, final_url string, html string, error string")


class _Group(InputPartition):
    def __init__(self, repository: str, ref: str, files: list[tuple[str, str]], revision: str | None = None):
        self.repository, self.ref, self.files, self.revision = repository, ref, files, revision

    @property
    def name(self) -> str:
        return f"{self.repository} {self.ref}"


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        groups: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for line in self.options["sources"].splitlines():
            source_id, repository, ref, file = line.split("\t")
            groups.setdefault((repository, ref), []).append((source_id, file))
        return [_Group(*k, files) for k, files in groups.items()]

    def _fetch(self, *parts: str) -> str:
        module, _, name = self.options.get("fetcher", f"{__name__}:http_get").partition(":")
        base = self.options.get("base", "").rstrip("/")
        return with_retries(getattr(importlib.import_module(module), name), "/".join([base, *parts]))

    def revision(self, group: _Group) -> str:
        """What a repository's ref stands for just now."""
        revision = self._fetch(group.repository, "revision", group.ref).strip()
        if len(revision) < 7:
            raise Permanent("revision is too short")
        return revision

    def files(self, group: _Group, revision: str) -> Iterator[tuple]:
        for source_id, file in group.files:
            try:
                yield source_id, revision, self._fetch(group.repository, revision, file), None
            except Exception as error:
                yield source_id, revision, None, f"{type(error).__name__}: {error}"

    def read(self, partition: _Group) -> Iterator[tuple]:
        try:  # the ref is resolved once, and every file read at that revision
            revision = self.revision(partition)
        except Exception as error:
            for source_id, _ in partition.files:
                yield source_id, None, None, f"{type(error).__name__}: {error}"
            return
        yield from self.files(partition, revision)


class FeedStream(DataSourceStreamReader):
    """The same feeds as a stream: an offset is the revision of every repository and ref, so a poll reads the feeds of those that
    moved since the last finished batch, at the revision that its offset names, also when it is repeated.

    A repository whose revision can't be told stays at the last one that could: a failed poll says nothing. Spark keeps
    offsets in the stream's checkpoint; `commit` is its word that a batch is finished.
    """

    def __init__(self, options: dict):
        self.reader = FeedReader(options)
        self.seen: dict[str, str] = {}
        self.committed: dict[str, str] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for group in self.reader.partitions():
            with contextlib.suppress(Exception):  # as unknown as before
                self.seen[group.name] = self.reader.revision(group)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        for name, revision in start.items():  # a stream that starts again knows what it had
            self.seen.setdefault(name, revision)
        groups = {g.name: g for g in self.reader.partitions()}
        return [_Group(g.repository, g.ref, g.files, end[name]) for name, g in groups.items() if name in end and end[name] != start.get(name)]

    def read(self, partition: _Group) -> Iterator[tuple]:
        return self.reader.files(partition, partition.revision)

    def commit(self, end: dict) -> None:
        self.committed = end


class FeedSource(DataSource):
    """`spark.dataSource.register(FeedSource)`, then `spark.read.format("feeds")` or `spark.readStream.format("feeds")` with
    `sources` (tab-separated id, repository, ref and file on each line), `base` and `fetcher`."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return "source_id string, revision string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStream(self.options)


class PageReader(DataSourceReader):
    """Pages of a paginated list: each answer names the next link."""

    def __init__(self, options: dict):
        self.options = options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.options["fetcher"].partition(":")
        fetch, link = getattr(importlib.import_module(module), name), self.options["start"]
        while link:
            items, link = fetch(link)
            if not isinstance(items, list):
                raise ValueError("a page isn't a list")
            yield from ((str(x),) for x in items)


class PagedSource(DataSource):
    """`format("paged")` with `start` and a `fetcher` that gives (items, next link or None)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)

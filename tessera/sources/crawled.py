"""Sources and sinks for services without a Spark connector: pages by a fetcher, remote tables by their cursor, webhooks.

`register(spark)` names them crawl, remote and webhook for spark.read, spark.readStream and writeStream.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

PAGES = "url string, host string, html string, title string, status_code int, content_type string, links array<struct<url: string, text: string, rel: string>>, crawled_at timestamp, response_ms long, content_length long, crawler_type string"


def named(path: str) -> Callable:
    """What `module:name` stands for; executors import it by that name."""
    module, name = path.split(":")
    return getattr(importlib.import_module(module), name)


def fetch_http(url: str, options: dict) -> dict:
    """A page by a plain request. Fetchers return html, and status_code, content_type and links if they know them."""
    request = urllib.request.Request(url, headers={"User-Agent": options.get("user_agent", "tessera")})
    try:
        with urllib.request.urlopen(request, timeout=float(options.get("timeout_ms", 30_000)) / 1000) as answer:  # noqa: S310
            return {"html": answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), "status_code": answer.status, "content_type": answer.headers.get("Content-Type")}
    except urllib.error.HTTPError as e:
        return {"html": "", "status_code": e.code, "content_type": e.headers.get("Content-Type")}


@dataclass
class Urls(InputPartition):
    urls: list[str]


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.hosts: set[str] | None = None
        self.urls: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on host and url decides what is fetched at all; other filters go back to Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("host",):
                self.hosts = wanted if self.hosts is None else self.hosts & wanted
            elif wanted is not None and f.attribute == ("url",):
                self.urls = wanted if self.urls is None else self.urls & wanted
            else:
                yield f

    def partitions(self) -> list[Urls]:
        """URLs by host, so that one task keeps a host's pace; hosts are dealt to `parts` tasks."""
        seeds = [u for u in dict.fromkeys(json.loads(self.options["urls"])) if (self.hosts is None or host_of(u) in self.hosts) and (self.urls is None or u in self.urls)]
        dealt: dict[int, list[str]] = {}
        for u in seeds:
            part = int(hashlib.sha256(host_of(u).encode()).hexdigest(), 16) % int(self.options.get("parts", 16))
            dealt.setdefault(part, []).append(u)
        return [Urls(own) for _, own in sorted(dealt.items())]

    def read(self, partition: Urls) -> Iterator[tuple]:
        fetch, delay = named(self.options.get("fetcher", f"{__name__}:fetch_http")), float(self.options.get("delay_ms", 0)) / 1000
        last: dict[str, float] = {}
        for url in partition.urls:
            host = host_of(url)
            if delay and host in last:
                time.sleep(max(0.0, last[host] + delay - time.monotonic()))
            last[host] = time.monotonic()
            page = fetch(url, self.options)
            took = int((time.monotonic() - last[host]) * 1000)
            html = page.get("html") or ""
            links = [tuple(link.get(k) for k in ("url", "text", "rel")) for link in page.get("links", [])]
            yield (url, host, html, page.get("title"), int(page.get("status_code", 200)), page.get("content_type"), links, datetime.now(timezone.utc), took, len(html.encode()), page.get("crawler_type", "http"))


def host_of(url: str) -> str:
    return (urlsplit(url).hostname or "").lower()


class CrawlSource(DataSource):
    """format("crawl"): options urls (JSON list), fetcher (module:name of f(url, options)), parts, delay_ms, and the fetcher's own."""

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> CrawlReader:
        return CrawlReader(dict(self.options))


# --- remote tables


@dataclass
class Span(InputPartition):
    """Rows with a cursor behind low, up to high."""

    low: int
    high: int


class RemoteRows:
    """Rows of an endpoint by its cursor, a number that grows with each change. The endpoint has latest() and rows(low, high)."""

    def __init__(self, options: dict) -> None:
        self.endpoint = named(options["endpoint"])(options)
        self.since, self.per_task = int(options.get("since", 0)), int(options.get("per_task", 10_000))

    def spans(self, low: int, high: int) -> list[Span]:
        return [Span(a, min(high, a + self.per_task)) for a in range(low, high, self.per_task)]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from self.endpoint.rows(partition.low, partition.high)


class RemoteReader(RemoteRows, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self.spans(self.since, self.endpoint.latest())


class RemoteStream(RemoteRows, DataSourceStreamReader):
    """A batch takes all that is new, in spans of per_task numbers; the cursor never goes back."""

    def initialOffset(self) -> dict:
        return {"cursor": self.since}

    def latestOffset(self) -> dict:
        return {"cursor": max(self.since, self.endpoint.latest())}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.spans(start["cursor"], end["cursor"])


class RemoteSource(DataSource):
    """format("remote"): options endpoint (module:name of a class made with the options), schema, since, per_task.

    As a stream its offset is the cursor, kept in the query's checkpoint: a pull that fails goes on from the last cursor that
    was pulled whole. As a batch it reads all rows behind `since`.
    """

    @classmethod
    def name(cls) -> str:
        return "remote"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> RemoteReader:
        return RemoteReader(dict(self.options))

    def streamReader(self, schema: StructType) -> RemoteStream:
        return RemoteStream(dict(self.options))


# --- webhooks


class Ledger:
    """Which events have been sent: a file for each, in a folder that all executors share (any store pyarrow reads)."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.kind = fs.FileType.File

    def path(self, event_id: str) -> str:
        return f"{self.folder}/{hashlib.sha256(event_id.encode()).hexdigest()}"

    def has(self, event_id: str) -> bool:
        return self.files.get_file_info(self.path(event_id)).type == self.kind

    def add(self, event_id: str) -> None:
        with self.files.open_output_stream(self.path(event_id)) as f:
            f.write(event_id.encode())


@dataclass
class Sent(WriterCommitMessage):
    sent: int
    skipped: int


def post(url: str, body: str, headers: dict) -> None:
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=10) as answer:  # noqa: S310
        if answer.status >= 300:
            raise OSError(f"webhook delivery failed: {answer.status}")


class WebhookWriter(DataSourceStreamWriter):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.options, self.columns = options, columns

    def write(self, iterator: Iterator) -> Sent:
        from tessera.sources.sinks import signature

        send, ledger, sent, skipped = named(self.options.get("sender", f"{__name__}:post")), Ledger(self.options["ledger"]), 0, 0
        for row in iterator:
            event = str(row[self.options.get("id_col", "event_id")])
            if ledger.has(event):
                skipped += 1
                continue
            body = json.dumps({c: row[c] for c in self.columns}, default=str)
            # Receivers can tell apart by the key what is sent again when a task dies between sending and noting it.
            headers = {"Idempotency-Key": event}
            if self.options.get("secret"):
                headers["X-Signature"] = f"sha256={signature(self.options['secret'], body)}"
            send(self.options["url"], body, headers)
            ledger.add(event)
            sent += 1
        return Sent(sent, skipped)

    def note(self, batch: int, state: str, messages: list) -> None:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(self.options["ledger"])
        files.create_dir(f"{folder}/batches", recursive=True)
        done = [m for m in messages if m is not None]
        with files.open_output_stream(f"{folder}/batches/{batch}.json") as f:
            f.write(json.dumps({"state": state, "sent": sum(m.sent for m in done), "skipped": sum(m.skipped for m in done)}).encode())

    def commit(self, messages: list, batchId: int) -> None:
        self.note(batchId, "committed", messages)

    def abort(self, messages: list, batchId: int) -> None:
        self.note(batchId, "aborted", messages)


class WebhookSink(DataSource):
    """writeStream.format("webhook"): options url, ledger (a shared folder's URI), secret, id_col, sender (module:name).

    Each event is sent by the task that holds it, signed, and noted in the ledger; a task that is tried again and a batch that
    is repeated after a failure pass by what the ledger has. Batches are noted as committed or aborted with their counts.
    """

    @classmethod
    def name(cls) -> str:
        return "webhook"

    def streamWriter(self, schema: StructType, overwrite: bool) -> WebhookWriter:
        return WebhookWriter(dict(self.options), schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Names the sources, and lets Spark hand them filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (CrawlSource, RemoteSource, WebhookSink):
        spark.dataSource.register(source)

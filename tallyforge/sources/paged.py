"""A paged REST source as a Python data source: a partition a page, filters pushed to the query, and its client.

The transport is a function page(query, offset, limit) -> rows, so tests and offline runs need no network. The
client makes one of a function send(url, body) -> (status, headers, answer).
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

Transport = Callable[[dict, int, int], list[dict]]


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        super().__init__((offset, limit))


class RateLimit:
    """At most one call in ``interval`` seconds and ``daily`` calls in all."""

    def __init__(self, interval: float = 1.0, daily: int = 1000, clock=time.monotonic, sleep=time.sleep):
        self.interval, self.left, self._clock, self._sleep, self._next = interval, daily, clock, sleep, 0.0

    def wait(self) -> None:
        if self.left <= 0:
            raise RuntimeError("the daily quota is used up")
        self.left -= 1
        now = self._clock()
        if now < self._next:
            self._sleep(self._next - now)
        self._next = max(now, self._next) + self.interval


def valid_app_name(value: str | None) -> str | None:
    """A registered application name: letters, digits, dots, dashes; None for blanks and placeholders."""
    name = (value or "").strip()
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{2,63}", name) or name.lower() in ("appname", "your-appname", "changeme"):
        return None
    return name


def retry_after(value: str | None, now: float | None = None) -> float | None:
    """Seconds to wait from a Retry-After header: a number or an HTTP date; None when it is neither."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return None


def with_retries(transport: Transport, attempts: int = 3, sleep=time.sleep) -> Transport:
    """Repeats a call that raises ConnectionError or TimeoutError, waiting 1, 2, 4, ... seconds."""

    def page(query: dict, offset: int, limit: int) -> list[dict]:
        for attempt in range(attempts):
            try:
                return transport(query, offset, limit)
            except (ConnectionError, TimeoutError):
                if attempt + 1 == attempts:
                    raise
                sleep(2.0**attempt)
        return []

    return page


def cached(transport: Transport, store: dict | None = None) -> Transport:
    """Answers a repeated query from a store keyed by its hash."""
    store = {} if store is None else store

    def page(query: dict, offset: int, limit: int) -> list[dict]:
        key = hashlib.sha256(json.dumps([query, offset, limit], sort_keys=True).encode()).hexdigest()
        if key not in store:
            store[key] = transport(query, offset, limit)
        return store[key]

    return page


class RestError(RuntimeError):
    """An answer that is no success and that a repeat will not mend."""


class RestClient:
    """POST queries, each answered from the cache, or else sent within the rate, the daily quota and a few repeats.

    ``folder`` holds a file for each answered body, named by its SHA-256, and the day's number of calls, so a later
    run goes on with both. Statuses 429 and 5xx and broken connections are repeated after Retry-After or a wait that doubles.
    """

    def __init__(self, send: Callable[[str, dict], tuple[int, dict, dict]], base: str, app_name: str | None, folder: str, *, interval: float = 1.0, daily: int = 1000, attempts: int = 4, sleep=time.sleep, clock=time.monotonic, today=lambda: datetime.datetime.now(datetime.UTC).date().isoformat()):
        self.app_name = valid_app_name(app_name)
        if self.app_name is None:
            raise ValueError(f"no registered application name: {app_name!r}")
        self.send, self.base, self.folder, self.attempts, self.sleep, self.today, self.daily = send, base.rstrip("/"), Path(folder), attempts, sleep, today, daily
        self.limit = RateLimit(interval, 1 << 62, clock, sleep)

    def used(self) -> int:
        """Calls sent today."""
        path = self.folder / f"calls-{self.today()}"
        return int(path.read_text()) if path.exists() else 0

    def _write(self, name: str, text: str) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        part = self.folder / f"{name}.{os.getpid()}.part"
        part.write_text(text, encoding="utf-8")
        os.replace(part, self.folder / name)

    def post(self, endpoint: str, body: dict, *, use_cache: bool = True) -> dict:
        key = hashlib.sha256(json.dumps([endpoint, body], sort_keys=True).encode()).hexdigest()
        known = self.folder / f"{key}.json"
        if use_cache and known.exists():
            return json.loads(known.read_text(encoding="utf-8"))
        url = f"{self.base}/{endpoint.lstrip('/')}?appname={self.app_name}"
        for attempt in range(1, self.attempts + 1):
            if self.used() >= self.daily:
                raise RuntimeError("the daily quota is used up")
            self.limit.wait()
            self._write(f"calls-{self.today()}", str(self.used() + 1))
            try:
                status, headers, answer = self.send(url, body)
            except (ConnectionError, TimeoutError) as problem:
                status, headers, answer = 599, {}, {"error": str(problem)}
            if 200 <= status < 300:
                self._write(known.name, json.dumps(answer))
                return answer
            if status != 429 and status < 500 or attempt == self.attempts:
                raise RestError(f"{endpoint}: status {status} after {attempt} attempts: {str(answer)[:200]}")
            wait = retry_after({k.lower(): v for k, v in headers.items()}.get("retry-after"))
            self.sleep(2.0 ** (attempt - 1) if wait is None else wait)
        raise AssertionError("unreachable")

    def pages(self, endpoint: str, *, fields=(), order: str = "date.created:asc") -> tuple[Transport, Callable[[dict], int]]:
        """A transport over the endpoint's items and a function that gives the number of items of a query."""

        def body(query: dict, offset: int, limit: int) -> dict:
            conditions = []
            for key, value in sorted(query.items()):
                field, sign = re.fullmatch(r"(.*?)(>=|<=|in|=)", key).groups()
                conditions.append({"field": field, "value": {">=": {"from": value}, "<=": {"to": value}}.get(sign, value)})
            out: dict = {"offset": offset, "limit": limit, "sort": [order]}
            if fields:
                out["fields"] = {"include": list(fields)}
            return out | ({"filter": {"operator": "AND", "conditions": conditions}} if conditions else {})

        def page(query: dict, offset: int, limit: int) -> list[dict]:
            return [{"id": item.get("id")} | (item.get("fields") or {}) for item in self.post(endpoint, body(query, offset, limit)).get("data") or []]

        return page, lambda query: int(self.post(endpoint, body(query, 0, 0)).get("totalCount") or 0)


def paged_source(name: str, schema: str, transport: Transport, *, page_size: int = 100, count: Callable[[dict], int] | None = None):
    """A DataSource class for spark.dataSource.register(); schema is a flat "name type, ..." list.

    With ``count``, the number of rows of a query, every page is a partition. Without it one partition reads
    pages until one is short. All rows come either way.
    """

    class Reader(DataSourceReader):
        def __init__(self):
            self.query: dict = {}

        def pushFilters(self, filters) -> Iterator:  # noqa: N802
            signs = {EqualTo: "=", In: "in", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}
            for f in filters:
                if type(f) in signs:
                    self.query[".".join(f.attribute) + signs[type(f)]] = list(f.value) if isinstance(f, In) else f.value
                else:
                    yield f

        def partitions(self):
            if count is None:
                return [Page(0, 0)]
            total = count(self.query)
            return [Page(at, min(page_size, total - at)) for at in range(0, total, page_size)] or [Page(0, page_size)]

        def read(self, partition):
            columns = [c.split()[0] for c in schema.split(",")]
            offset, limit = partition.value
            while True:
                rows = transport(self.query, offset, limit or page_size)
                for row in rows:
                    yield tuple(row.get(c) for c in columns)
                if limit or len(rows) < page_size:
                    return
                offset += page_size

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):  # noqa: ARG002
            return Reader()

    return Source

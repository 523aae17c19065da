"""map over an HTTP client: many requests in flight per task, one pool of connections, closed at the end."""

from __future__ import annotations

import http.client
import inspect
import itertools
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType

from weftspark.operators.calls import SLICE, Returns, called, elements
from weftspark.operators.turns import AsyncHttpClient, HttpError, Kept


class HttpClient(Kept):
    """GET and POST over connections that each thread keeps open."""

    def __init__(self, timeout: float = 30.0, retries: int = 2):
        super().__init__()
        self.timeout, self.retries = timeout, retries
        self._local = threading.local()
        self._open: list[http.client.HTTPConnection] = []

    def _connection(self, scheme: str, host: str) -> http.client.HTTPConnection:
        mine = self._local.__dict__.setdefault("connections", {})
        if (scheme, host) not in mine:
            kind = http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection
            mine[scheme, host] = kind(host, timeout=self.timeout)
            with self._lock:
                self._open.append(mine[scheme, host])
        return mine[scheme, host]

    def request(self, method: str, url: str, body: bytes | None = None) -> str:
        at = urlsplit(url)
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        for left in range(self.retries, -1, -1):
            connection = self._connection(at.scheme, at.netloc)
            try:
                connection.request(method, path, body)
                answer = connection.getresponse()
                text = answer.read().decode("utf-8")
            except (OSError, http.client.HTTPException) as e:
                connection.close()
                if not left:
                    raise HttpError(f"{method} {url}: {e}") from e
                continue
            if answer.status >= 400:
                raise HttpError(f"{method} {url}: status {answer.status}")
            return text
        raise AssertionError

    def get(self, url: str) -> str:
        return self.request("GET", url)

    def post(self, url: str, body: bytes) -> str:
        return self.request("POST", url, body)

    def close(self) -> None:
        for c in self._open:
            c.close()
        super().close()


def awaited(function: Callable) -> bool:
    return inspect.iscoroutinefunction(function) or inspect.iscoroutinefunction(getattr(function, "__call__", None))  # noqa: B004


def taking_turns(rows: Iterator, function: Callable, client: AsyncHttpClient, in_flight: int) -> Iterator:
    """mapped_objects for an async function."""
    while part := list(itertools.islice(rows, max(SLICE, 4 * in_flight))):
        yield from client.run(function, part, in_flight)


def mapped_objects(rows: Iterator, function: Callable, in_flight: int) -> Iterator:
    """function of each object, in order, at most in_flight calls at once and a few times as many objects in hand."""
    with ThreadPoolExecutor(in_flight) as pool:
        while part := list(itertools.islice(rows, 4 * in_flight)):
            yield from pool.map(function, part)


def map_http(df: DataFrame, function: Callable[[HttpClient, Any], Any], returns: str | DataType, *, element: Callable[[tuple], Any] | None = None, max_in_flight: int = 64, timeout: float = 30.0, retries: int = 2, partitions: int | None = None) -> DataFrame:
    """function(client, element) of each row, at most max_in_flight calls at once in a task.

    Elements are values, pairs or Rows; returns as in Dataset.map. Order within a task is kept; partitions
    deals the rows to so many tasks first, for small tables whose calls are slow. A task
    that is run again repeats its calls: at least once. Errors of the function end the job.
    An async function gets an AsyncHttpClient, awaits its calls (and nothing else), and all calls of a task take
    turns in one thread; other functions run in max_in_flight threads, which costs several times as much a call.
    """
    see, shape, turns = element or elements(df.columns), Returns(returns), awaited(function)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = (AsyncHttpClient if turns else HttpClient)(timeout, retries)
        try:
            for _, out in called(batches, lambda x: function(client, see(x)), max_in_flight, client.run if turns else None):
                yield shape.batch(out)
        finally:
            client.close()

    return (df.repartition(partitions) if partitions else df).mapInArrow(run, shape.schema)

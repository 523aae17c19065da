"""HTTP calls of async functions: many in flight in one thread, which goes on with whoever has its answer."""

from __future__ import annotations

import functools
import queue
import re
import selectors
import socket
import ssl
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any
from urllib.parse import urlsplit

HEAD_END = re.compile(rb"\r?\n\r?\n")
#: longest head of an answer, line of a chunk's size or trailer
HEAD_MOST = 1 << 20
#: heads of less than this are read, and addresses of less than this taken apart, once for many calls
CACHED = 2048
#: threads of a task that look up names, connect and greet (TLS)
OPENING = 16
NOT_IN_URL = re.compile(r"[^\x21-\x7e]")


class HttpError(RuntimeError):
    """An answer of status 400 or more, or no answer at all."""


class Kept:
    """Things of which a client has one, made when first asked for and closed with it."""

    def __init__(self) -> None:
        self._kept: dict[Callable, Any] = {}
        self._lock = threading.RLock()
        self.closed = False

    def kept(self, make: Callable[[], Any]) -> Any:
        found = self._kept.get(make)
        if found is None:
            with self._lock:
                if (found := self._kept.get(make)) is None:
                    found = self._kept[make] = make()
        return found

    def close(self) -> None:
        for x in self._kept.values():
            x.close()
        self._kept.clear()
        self.closed = True


class _Broken(Exception):
    """An answer that ends early or is none."""


@functools.lru_cache(256)
def _read_head(head: bytes) -> tuple[int, int | None, bool, bool]:
    """Status, length (if told), whether the body comes in chunks, whether the connection stays open."""
    first, *lines = head.split(b"\n")
    words = first.split(None, 2)
    if len(words) < 2 or not words[0].startswith(b"HTTP/1.") or not words[1].isdigit():
        raise _Broken(f"no HTTP answer: {first[:80]!r}")
    status, need, chunked, still = int(words[1]), None, False, words[0] != b"HTTP/1.0"
    for line in lines:
        name, _, value = line.partition(b":")
        name = name.lower()
        if name == b"content-length":
            if not value.strip().isdigit():
                raise _Broken(f"length {value!r}")
            need = int(value)
        elif name == b"transfer-encoding":
            chunked = chunked or b"chunked" in value.lower()
        elif name == b"connection" and b"close" in value.lower():
            still = False
    if status in (204, 304):
        need, chunked = 0, False
    return status, None if chunked else need, chunked, still and (chunked or need is not None)


class _Answer:
    """Status and body of an answer, from the pieces in which it comes: of known length, in chunks, or until the end."""

    __slots__ = ("body", "buffer", "chunked", "need", "open", "status")

    def __init__(self) -> None:
        self.buffer, self.body, self.status = b"", b"", 0
        self.need: int | None = None
        self.chunked = self.open = False

    def take(self, data: bytes) -> bool:
        """Whether the answer is whole; no data means that the other side has ended."""
        if not data:
            if self.status and self.need is None and not self.chunked:
                self.body = bytes(self.buffer)
                return True
            raise _Broken("the connection ended before the answer")
        self.buffer += data
        while not self.status:
            if not self._head():
                return False
        if self.chunked:
            return self._chunks()
        if self.need is None or len(self.buffer) < self.need:
            return False
        self.open = self.open and len(self.buffer) == self.need
        self.body = self.buffer[: self.need]
        return True

    def _head(self) -> bool:
        end = self.buffer.find(b"\r\n\r\n")
        after = end + 4
        if b"\n\n" in self.buffer[:after] or end < 0:  # some end lines with \n alone
            found = HEAD_END.search(self.buffer)
            end, after = found.span() if found else (-1, 0)
        if end < 0:
            if len(self.buffer) > HEAD_MOST:
                raise _Broken("the head of the answer does not end")
            return False
        head, rest = self.buffer[:end], self.buffer[after:]
        status, self.need, self.chunked, self.open = (_read_head if len(head) < CACHED else _read_head.__wrapped__)(head)
        if 100 <= status < 200:  # only says that the answer will come
            self.buffer = rest
            return len(rest) > 0
        self.status = status
        self.buffer = rest if len(rest) == self.need else bytearray(rest)  # long bodies grow in place
        if self.chunked:
            self.body = bytearray()
        return True

    def _chunks(self) -> bool:
        """need is None before a line with a size, -1 in the trailers, else what is left of a chunk with its line end."""
        while True:
            if self.need is not None and self.need > 0:
                if len(self.buffer) < self.need:
                    return False
                self.body += self.buffer[: self.need - 2]
                del self.buffer[: self.need]
                self.need = None
            end = self.buffer.find(b"\n")
            if end < 0:
                if len(self.buffer) > HEAD_MOST:
                    raise _Broken("the line of a chunk does not end")
                return False
            line = bytes(self.buffer[:end]).strip()
            del self.buffer[: end + 1]
            if self.need == -1:
                if not line:
                    self.open = self.open and not self.buffer
                    self.body = bytes(self.body)
                    return True
                continue
            try:
                size = int(line.split(b";")[0], 16)
            except ValueError:
                size = -1
            if size < 0:
                raise _Broken(f"size of a chunk {line[:80]!r}")
            self.need = size + 2 if size else -1


@functools.lru_cache(256)
def _address(method: str, url: str) -> tuple[tuple[str, str, int], str]:
    """Scheme, host and port to call, and the first lines of the call."""
    at = urlsplit(url)
    path = (at.path or "/") + (f"?{at.query}" if at.query else "")
    if not at.hostname or at.scheme not in ("http", "https") or NOT_IN_URL.search(at.netloc) or NOT_IN_URL.search(path):
        raise HttpError(f"{method} {url}: no address to call")
    head = f"{method} {path} HTTP/1.1\r\nHost: {at.netloc.rpartition('@')[2]}\r\nAccept-Encoding: identity\r\n"
    return (at.scheme, at.hostname, at.port or (443 if at.scheme == "https" else 80)), head


class _Call:
    """One request, awaited: where to, and what to send."""

    __slots__ = ("sent", "to")

    def __init__(self, to: tuple[str, str, int], sent: bytes):
        self.to, self.sent = to, sent

    def __await__(self):
        return (yield self)


class _Element:
    """An element whose coroutine is under way: its place, its call and the tries that are left for it."""

    __slots__ = ("call", "left", "place", "work")


class _Link:
    """An open connection; since is when it last moved, used whether it has brought an answer before."""

    __slots__ = ("answer", "element", "since", "sock", "to", "unsent", "used")

    def __init__(self, sock: socket.socket, to: tuple[str, str, int]):
        self.sock, self.to, self.unsent, self.used = sock, to, b"", False
        self.element: _Element | None = None


class AsyncHttpClient(Kept):
    """GET and POST to be awaited, over connections that stay open; run calls an async function of many elements."""

    def __init__(self, timeout: float = 30.0, retries: int = 2):
        super().__init__()
        self.timeout, self.retries = timeout, retries
        self._ready = selectors.DefaultSelector()
        self._idle: dict[tuple, list[_Link]] = {}
        self._busy: set[_Link] = set()
        self._opened: queue.SimpleQueue = queue.SimpleQueue()
        self._pool: ThreadPoolExecutor | None = None
        self._wake, self._woken = socket.socketpair()
        self._woken.setblocking(False)
        self._ready.register(self._woken, selectors.EVENT_READ, None)

    async def request(self, method: str, url: str, body: bytes | None = None) -> str:
        to, head = (_address if len(url) < CACHED else _address.__wrapped__)(method, url)
        if body is not None or method == "POST":
            head += f"Content-Length: {len(body or b'')}\r\n"
        try:
            answer = await _Call(to, f"{head}\r\n".encode() + (body or b""))
        except (OSError, _Broken) as e:
            raise HttpError(f"{method} {url}: {e}") from e
        if answer.status >= 400:
            raise HttpError(f"{method} {url}: status {answer.status}")
        return answer.body.decode("utf-8")

    async def get(self, url: str) -> str:
        return await self.request("GET", url)

    async def post(self, url: str, body: bytes) -> str:
        return await self.request("POST", url, body)

    def run(self, function: Callable[[Any], Any], rows: list, in_flight: int) -> list:
        """The results of function(row), in order; at most in_flight of its coroutines are under way."""
        out: list = [None] * len(rows)
        places = iter(range(len(rows)))
        going = 0

        def go_on(element: _Element, answer: _Answer | None = None, error: Exception | None = None) -> None:
            nonlocal going
            while True:
                try:
                    call = element.work.throw(error) if error else element.work.send(answer)
                except StopIteration as end:
                    out[element.place] = end.value
                    element.place = next(places, None)
                    if element.place is None:
                        going -= 1
                        return
                    element.work, answer, error = function(rows[element.place]), None, None
                    continue
                if not isinstance(call, _Call):
                    raise TypeError(f"an async function awaits calls of its client only, not {type(call).__name__}")
                element.call, element.left = call, self.retries
                self._send(element)
                return

        def again(element: _Element, error: Exception, stale: bool = False) -> None:
            if element.left or stale:
                element.left -= not stale
                self._connect(element)
            else:
                go_on(element, error=error)

        for _ in range(min(in_flight, len(rows))):
            place = next(places, None)
            if place is None:  # the others were done without a call
                break
            going += 1
            element = _Element()
            element.place, element.work = place, function(rows[place])
            go_on(element)
        looked, pause = time.monotonic(), min(1.0, self.timeout / 4)
        while going:
            events = self._ready.select(pause)
            now = time.monotonic()
            for key, _ in events:
                link = key.data
                if link is None:
                    for element, found in self._news():
                        if isinstance(found, Exception):
                            again(element, found)
                        elif error := self._write(found, element):
                            again(element, error)
                    continue
                element, link.since = link.element, now
                try:
                    done = self._moved(link)
                except (OSError, _Broken) as e:
                    self._drop(link)
                    if element:  # a connection that ended while idle takes no try
                        again(element, e, link.used and not link.answer.status and not link.answer.buffer)
                    continue
                if done:
                    go_on(element, done)
            if now - looked >= pause:
                looked = now
                for link in [x for x in self._busy if now - x.since > self.timeout]:
                    element = link.element
                    self._drop(link)
                    again(element, TimeoutError("timed out"))
        return out

    def _send(self, element: _Element) -> None:
        """Over a connection that is idle, if one is; as the other side may have ended it, later tries take new ones."""
        idle = self._idle.get(element.call.to)
        while idle:
            if not self._write(idle.pop(), element):
                return
        self._connect(element)

    def _connect(self, element: _Element) -> None:
        if self._pool is None:
            self._pool = ThreadPoolExecutor(OPENING)
        self._pool.submit(self._open, element, element.call.to)

    def _open(self, element: _Element, to: tuple[str, str, int]) -> None:
        scheme, host, port = to
        try:
            sock = socket.create_connection((host, port), self.timeout)
            try:
                sock.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                if scheme == "https":
                    sock = self._tls.wrap_socket(sock, server_hostname=host)
                sock.setblocking(False)
            except BaseException:
                sock.close()
                raise
            self._opened.put((element, _Link(sock, to)))
        except Exception as e:
            self._opened.put((element, e if isinstance(e, OSError) else _Broken(str(e))))
        self._wake.send(b".")

    @functools.cached_property
    def _tls(self) -> ssl.SSLContext:
        return ssl.create_default_context()

    def _news(self) -> list[tuple[_Element, _Link | Exception]]:
        self._woken.recv(1 << 12)
        got = []
        while not self._opened.empty():
            element, found = self._opened.get()
            if isinstance(found, _Link):
                self._ready.register(found.sock, selectors.EVENT_READ, found)
            got.append((element, found))
        return got

    def _write(self, link: _Link, element: _Element) -> Exception | None:
        """Sends the element's call; what the socket does not take goes when it is ready again."""
        link.element, link.answer, link.since = element, _Answer(), time.monotonic()
        self._busy.add(link)
        link.unsent = element.call.sent
        try:
            self._push(link)
        except OSError as e:
            self._drop(link)
            return e
        if link.unsent:
            self._ready.modify(link.sock, selectors.EVENT_READ | selectors.EVENT_WRITE, link)
        return None

    @staticmethod
    def _push(link: _Link) -> None:
        try:
            while link.unsent:
                link.unsent = memoryview(link.unsent)[link.sock.send(link.unsent) :]
        except (BlockingIOError, ssl.SSLWantReadError, ssl.SSLWantWriteError):
            pass

    def _moved(self, link: _Link) -> _Answer | None:
        """Goes on with a connection that is ready; its answer, if it is whole now."""
        if link.unsent:
            self._push(link)
            if not link.unsent:
                self._ready.modify(link.sock, selectors.EVENT_READ, link)
        whole = False
        while not whole:
            try:
                data = link.sock.recv(1 << 16)
            except (BlockingIOError, ssl.SSLWantReadError, ssl.SSLWantWriteError):
                return None
            if link.element is None:
                raise _Broken("an idle connection ended" if not data else "an answer without a call")
            whole = link.answer.take(data)
            if not whole and not (isinstance(link.sock, ssl.SSLSocket) and link.sock.pending()):
                return None
        answer, link.element, link.answer, link.used = link.answer, None, None, True
        self._busy.discard(link)
        if answer.open and not link.unsent:
            self._idle.setdefault(link.to, []).append(link)
        else:
            self._drop(link)
        return answer

    def _drop(self, link: _Link) -> None:
        self._busy.discard(link)
        link.element = None
        if link in (idle := self._idle.get(link.to, ())):
            idle.remove(link)
        if link.sock.fileno() >= 0:
            self._ready.unregister(link.sock)
            link.sock.close()

    def close(self) -> None:
        if self._pool:
            self._pool.shutdown(cancel_futures=True)
        while not self._opened.empty():
            found = self._opened.get()[1]
            if isinstance(found, _Link):
                found.sock.close()
        for key in list(self._ready.get_map().values()):
            key.fileobj.close()
        self._ready.close()
        self._wake.close()
        super().close()

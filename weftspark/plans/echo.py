"""The local HTTP stub of the second demonstration job, in a thread or in a process of its own; standard library only."""

from __future__ import annotations

import contextlib
import functools
import heapq
import itertools
import selectors
import socket
import subprocess
import sys
import threading
import time
from urllib.parse import parse_qs, urlsplit

STATUS = {200: b"OK", 404: b"Not Found", 406: b"Not Acceptable"}


@functools.lru_cache(256)
def answered(path: str) -> tuple[int, bytes]:
    """Status and the whole answer."""
    at = urlsplit(path)
    value = parse_qs(at.query).get("value", [None])[0]
    status, body = 200, b""
    if at.path == "/test":
        body = b"hello"
    elif at.path not in ("/echo", "/get"):
        status = 404
    elif value is None:
        status = 406
    else:
        body = (value if at.path == "/echo" else f'{{"args":{{"value":"{value}"}},"url":"{path}"}}').encode()
    return status, b"HTTP/1.1 %d %s\r\nContent-Length: %d\r\n\r\n%s" % (status, STATUS[status], len(body), body)


class EchoServer:
    """/test greets, /echo?value=v answers v (406 without it), /get?value=n answers JSON; counts calls in flight.

    Reads plain GET requests over connections that stay open, all in one thread; an answer leaves in one piece,
    those of /echo after a delay.
    """

    def __init__(self, host: str = "127.0.0.1", port: int = 0, delay: float = 0.0):
        self.delay, self.most, self.now = delay, 0, 0
        self._ready, self._late, self._count = selectors.DefaultSelector(), [], itertools.count()
        self._door = socket.create_server((host, port), backlog=1024)
        self._door.setblocking(False)
        self.url = f"http://{host}:{self._door.getsockname()[1]}"
        self._ready.register(self._door, selectors.EVENT_READ, self._accept)
        self._wake, woken = socket.socketpair()
        self._ready.register(woken, selectors.EVENT_READ, None)
        self._thread = threading.Thread(target=self._serve, daemon=True)
        self._thread.start()

    def _serve(self) -> None:
        while True:
            for key, _ in self._ready.select(max(0.0, self._late[0][0] - time.monotonic()) if self._late else None):
                if key.data is None:
                    return
                key.data()
            while self._late and self._late[0][0] <= time.monotonic():
                _, _, line, answer = heapq.heappop(self._late)
                line.send(answer)
                self.now -= 1

    def _accept(self) -> None:
        with contextlib.suppress(OSError):
            _Line(self, self._door.accept()[0])

    def _asked(self, line: _Line, path: str) -> None:
        self.now += 1
        self.most = max(self.most, self.now)
        status, whole = answered(path)
        if self.delay and status == 200 and path.startswith("/echo"):
            heapq.heappush(self._late, (time.monotonic() + self.delay, next(self._count), line, whole))
        else:
            line.send(whole)
            self.now -= 1

    def close(self) -> None:
        self._wake.close()
        self._thread.join()
        for key in list(self._ready.get_map().values()):
            key.fileobj.close()
        self._ready.close()

    def __enter__(self) -> EchoServer:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class _Line:
    """A caller's connection: what it has asked in part, what it has not taken yet."""

    def __init__(self, server: EchoServer, sock: socket.socket):
        self.server, self.sock, self.asked, self.left = server, sock, b"", b""
        sock.setblocking(False)
        sock.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        server._ready.register(sock, selectors.EVENT_READ, self.ready)

    def ready(self) -> None:
        try:
            if self.left:
                self.send(b"")
                return
            data = self.sock.recv(1 << 16)
        except BlockingIOError:
            return
        except OSError:
            data = b""
        if not data:
            self.end()
            return
        self.asked += data
        while (end := self.asked.find(b"\r\n\r\n")) >= 0:
            words = self.asked[: self.asked.find(b"\r\n")].split()
            self.asked = self.asked[end + 4 :]
            if len(words) < 2:
                self.end()
                return
            self.server._asked(self, words[1].decode("latin-1"))

    def send(self, answer: bytes) -> None:
        """What the caller does not take at once goes when it is ready again; until then it asks nothing new."""
        if self.sock.fileno() < 0:
            return
        before, left = self.left, self.left + answer
        try:
            self.left = left[self.sock.send(left) :]
        except BlockingIOError:
            self.left = left
        except OSError:
            self.end()
            return
        if bool(before) != bool(self.left):
            self.server._ready.modify(self.sock, selectors.EVENT_WRITE if self.left else selectors.EVENT_READ, self.ready)

    def end(self) -> None:
        if self.sock.fileno() >= 0:
            self.server._ready.unregister(self.sock)
            self.sock.close()


class EchoProcess:
    """An EchoServer in a process of its own on this host, which ends when closed or with the process that made it."""

    def __init__(self) -> None:
        source = sys.modules[__name__].__spec__.loader.get_source(__name__)
        self._process = subprocess.Popen([sys.executable, "-I", "-S", "-c", source], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        self.url = self._process.stdout.readline().decode().strip()
        if not self.url:
            raise RuntimeError(f"the echo server ended with {self._process.wait()}")

    def close(self) -> None:
        self._process.stdin.close()
        self._process.stdout.close()
        self._process.wait()


if __name__ == "__main__":
    with EchoServer() as alone:
        print(alone.url, flush=True)
        sys.stdin.read()

"""Async functions over HTTP: their calls take turns in one thread, with stubs beside the tasks."""

import socketserver
import threading
import time

import pytest

from weftspark import from_frame
from weftspark.dataset import PyDataset
from weftspark.operators.http import AsyncHttpClient, HttpError
from weftspark.operators.turns import _Answer, _Broken
from weftspark.plans import catalogue, jobs
from weftspark.plans.echo import EchoProcess, EchoServer
from weftspark.session import ship

LONG = b"0123456789abcdef" * 30_000
HEAD = b"HTTP/1.1 200 OK\r\n"
ANSWERS = {
    "/length": HEAD + b"content-length: 4\r\n\r\nfour",
    "/none": b"HTTP/1.1 204 No Content\r\n\r\n",
    "/chunks": HEAD + b"Transfer-Encoding: chunked\r\n\r\n2;x=y\r\nfo\r\n2\r\nur\r\n0\r\nTrailer: x\r\n\r\n",
    "/until-end": b"HTTP/1.0 200 OK\r\n\r\nfour",
    "/bare-lines": b"HTTP/1.1 200 OK\nContent-Length: 4\n\nfour",
    "/first-100": b"HTTP/1.1 100 Continue\r\n\r\n" + HEAD + b"Content-Length: 4\r\n\r\nfour",
    "/long": HEAD + b"Content-Length: %d\r\n\r\n%s" % (len(LONG), LONG),
    "/last": HEAD + b"Connection: close\r\nContent-Length: 4\r\n\r\nfour",
    "/short": HEAD + b"Content-Length: 9\r\n\r\nfour",
    "/error": b"HTTP/1.1 500 No\r\nContent-Length: 0\r\n\r\n",
    "/noise": b"hello\r\n\r\n",
}
ENDS = ("/until-end", "/last", "/short", "/noise")


@pytest.fixture
def odd():
    """Answers of all forms; /once ends each connection after one answer without saying so, /hang never answers, /body gives the body back."""
    calls = []

    class Handler(socketserver.StreamRequestHandler):
        def handle(self):
            while line := self.rfile.readline():
                path, length = line.split()[1].decode(), 0
                calls.append(path)
                while (head := self.rfile.readline()).strip():
                    length = int(head.split(b":")[1]) if head.lower().startswith(b"content-length") else length
                if path == "/hang":
                    time.sleep(2)
                    return
                body = self.rfile.read(length)
                self.wfile.write(ANSWERS.get(path) or HEAD + b"Content-Length: %d\r\n\r\n%s" % (len(body), body))
                if path in (*ENDS, "/once"):
                    return

    class Server(socketserver.ThreadingTCPServer):
        daemon_threads = True

    with Server(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, args=(0.05,), daemon=True).start()
        yield f"http://127.0.0.1:{server.server_address[1]}", calls
        server.shutdown()


@pytest.fixture
def client():
    c = AsyncHttpClient(timeout=0.4, retries=1)
    yield c
    c.close()
    assert c.closed


def test_calls_overlap_in_one_thread_and_order_stays(spark):
    with EchoServer(delay=0.05) as server:
        url = server.url

        async def said(client, x):
            return f"{await client.get(f'{url}/echo?value={x}')} {threading.active_count() < 30}"

        data = from_frame(spark.range(200).selectExpr("id AS value").coalesce(1))
        assert data.map_http(said, "string", max_in_flight=100).collect() == [f"{x} True" for x in range(200)]
        assert 30 < server.most <= 100
        server.most = 0
        assert data.map_http(said, "string", max_in_flight=3).collect()[-1] == "199 True"
        assert 1 < server.most <= 3


def test_pairs_rows_objects_and_errors(spark):
    with EchoServer() as server:
        url = server.url

        async def pair(client, kv):
            return kv[0], await client.get(f"{url}/echo?value={kv[1]}")

        async def row(client, r):
            return r.id, await client.get(f"{url}/echo?value={r.name}") if r.name else None, r.n

        async def most(client, s):
            return await client.get(f"{url}/echo?value={max(s)}")

        async def failing(client, x):
            return await client.get(f"{url}/echo")

        pairs = from_frame(spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int").coalesce(1))
        assert pairs.map_http(pair, "key string, value string").collect() == [("a", "1"), ("b", "2")]
        rows = from_frame(spark.createDataFrame([(1, "x", None), (2, None, 1 << 62)], "id int, name string, n bigint").coalesce(1))
        assert [tuple(r) for r in rows.map_http(row, "id int, said string, n bigint").df.collect()] == [(1, "x", None), (2, None, 1 << 62)]
        assert PyDataset(spark, spark.sparkContext.parallelize([{x} for x in range(3000)], 2)).map_http(most).collect() == [str(x) for x in range(3000)]
        with pytest.raises(Exception, match="406"):
            from_frame(spark.range(2).selectExpr("id AS value")).map_http(failing, "string").collect()
        assert from_frame(spark.range(0).selectExpr("id AS value")).map_http(failing, "string").collect() == []


def test_answers_of_all_forms(odd, client):
    url, _ = odd

    async def body(path):
        try:
            return await client.get(url + path)
        except HttpError as e:
            return str(e).split(": ", 1)[1]

    paths = list(ANSWERS) * 3
    want = {"/none": "", "/long": LONG.decode(), "/short": "the connection ended before the answer", "/error": "status 500", "/noise": "no HTTP answer: b'hello'"}
    assert client.run(body, paths, 4) == [want.get(p, "four") for p in paths]
    for path in ("/length", "/none", "/chunks", "/bare-lines", "/first-100"):  # cut anywhere
        answer = _Answer()
        assert [answer.take(bytes([b])) for b in ANSWERS[path]] == [False] * (len(ANSWERS[path]) - 1) + [True]
        assert bytes(answer.body) == want.get(path, "four").encode() and answer.open
    with pytest.raises(_Broken):
        _Answer().take(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nxyz\r\n")


def test_tries_again_and_gives_up(odd, client):
    url, calls = odd

    async def post(x):
        return await client.post(f"{url}/once", x)

    bodies = [b"%d" % k * 200_000 for k in range(40)]
    assert client.run(post, bodies, 5) == [b.decode() for b in bodies]

    async def failed(path):
        with pytest.raises(HttpError) as e:
            await client.get(path)
        return str(e.value)

    assert "timed out" in client.run(failed, [f"{url}/hang"], 5)[0] and calls.count("/hang") == 2
    for path in ("http://127.0.0.1:9/none", f"{url}/two words", "ftp://127.0.0.1/x", "/nowhere"):
        assert client.run(failed, [path], 5)[0].startswith(f"GET {path}: ")


def test_only_calls_are_awaited(client):
    class Other:
        def __await__(self):
            yield 1

    async def waits(x):
        await Other()

    async def calls_nothing(x):
        return -x

    assert client.run(calls_nothing, list(range(5000)), 64) == [-x for x in range(5000)]
    with pytest.raises(TypeError, match="calls of its client only"):
        client.run(waits, [1], 1)


def test_a_client_keeps_one_stub_and_closes_it():
    client = AsyncHttpClient()
    stub = client.kept(EchoProcess)
    assert client.kept(EchoProcess) is stub
    assert client.run(lambda x: jobs.echoed(client, x), list(range(10)) * 300, 64) == list(range(10)) * 300
    client.close()
    assert stub._process.poll() is not None


def test_query_asks_no_stub_in_the_driver(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jobs, "EchoServer", None)
    ship(spark)
    spark.range(40_007).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    assert catalogue.map_http(spark, str(tmp_path)).collect()[0].value == sum(x % 10 for x in range(40_007)) % 10_000
    assert jobs.http_job(spark, from_frame(spark.range(25).selectExpr("-id AS value"))) == sum(x % 10 for x in range(25))

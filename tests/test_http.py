import pytest

from weftspark import from_frame
from weftspark.operators.http import HttpClient, HttpError
from weftspark.plans.jobs import EchoServer, count_job, http_job


@pytest.fixture
def server():
    s = EchoServer(delay=0.05)
    yield s
    s.close()


def test_calls_overlap_and_order_stays(spark, server):
    url = server.url
    data = from_frame(spark.range(60).selectExpr("id AS value").coalesce(1))
    got = data.map_http(lambda client, x: client.get(f"{url}/echo?value={x}"), "string", max_in_flight=8)
    assert got.collect() == [str(x) for x in range(60)]
    assert 1 < server.most <= 8


def test_http_job(spark, server):
    values = from_frame(spark.range(25).selectExpr("id AS value"))
    assert http_job(spark, values, server.url) == sum(x % 10 for x in range(25)) % 10000
    assert http_job(spark, from_frame(spark.range(0).selectExpr("id AS value")), server.url) == 0


def test_errors_and_close(spark, server):
    client = HttpClient()
    assert client.get(f"{server.url}/test") == "hello"
    with pytest.raises(HttpError, match="406"):
        client.get(f"{server.url}/echo")
    with pytest.raises(HttpError):
        HttpClient(timeout=0.2, retries=0).get("http://127.0.0.1:9/none")
    client.close()
    assert client.closed
    url = server.url
    with pytest.raises(Exception, match="406"):
        from_frame(spark.range(2).selectExpr("id AS value")).map_http(lambda c, x: c.get(f"{url}/echo"), "string").collect()


def test_count_job(spark):
    key, n = count_job(spark, 10_000, seed=1)
    assert 0 <= key < 100 and 100 <= n < 200
    assert count_job(spark, 0) == (-1, -1)

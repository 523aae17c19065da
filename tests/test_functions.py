"""Python functions over Arrow batches, orders of function merges, hash orders, headers, objects."""

import threading
import time
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftspark import cached, delimited, from_frame
from weftspark.dataset import PyDataset
from weftspark.functions.scalars import java_hash, java_hash_of
from weftspark.operators.order import placed
from weftspark.plans.jobs import EchoServer

WIDE = (1 << 53) + 1


def ints(spark, values):
    return from_frame(spark.createDataFrame([(v,) for v in values], "value bigint").coalesce(1))


def test_functions_see_nulls_and_wide_integers(spark):
    data = ints(spark, [WIDE, None, 3])
    assert data.map(lambda x: x, "bigint").collect() == [WIDE, None, 3]
    assert data.filter(lambda x: x is not None).collect() == [WIDE, 3]
    assert data.map(lambda x: None if x is None else x + 1, "bigint", in_flight=3).collect() == [WIDE + 1, None, 4]


def test_declared_results(spark):
    data = ints(spark, [1, 2])
    got = data.map(lambda x: (Decimal(x), {"a": [x]}, None), "a decimal(12,2), b map<string,array<int>>, c struct<x:int,y:string>").df.collect()
    assert [tuple(r) for r in got] == [(Decimal(1), {"a": [1]}, None), (Decimal(2), {"a": [2]}, None)]
    assert [tuple(r) for r in data.map(lambda x: {"n": x, "s": str(x)}, "s string, n bigint").df.collect()] == [("1", 1), ("2", 2)]
    assert data.map(lambda x: Row(x=x, y="t"), "struct<x:bigint,y:string>").collect() == [Row(x=1, y="t"), Row(x=2, y="t")]
    assert data.map(lambda x: [x, x], "array<bigint>").collect() == [[1, 1], [2, 2]]
    with pytest.raises(Exception, match="is no integer"):
        data.map(lambda x: x + 0.5, "bigint").collect()
    assert ints(spark, []).map(lambda x: x, "a bigint, b string").collect() == []


def test_calls_overlap_if_asked(spark):
    def thread(x):
        time.sleep(0.01)
        return threading.current_thread().name

    data = ints(spark, range(40))
    assert len(set(data.map(thread, "string").collect())) == 1
    assert 1 < len(set(data.map(thread, "string", in_flight=8).collect())) <= 8
    assert data.filter(lambda x: bool(thread(x)) and x % 2, in_flight=8).collect() == list(range(1, 40, 2))
    assert data.objects().map(lambda x: x * 2, in_flight=4).collect() == [2 * x for x in range(40)]


def test_function_merges_have_an_order(spark):
    pairs = from_frame(spark.createDataFrame([(k, 1) for k in (3, 1, None, 2, 3, 12)], "key bigint, value bigint").repartition(3))
    add = lambda a, b: a + b
    keys = lambda data: [k for k, _ in data.collect()]
    for merge in ("sum", add):
        assert keys(pairs.reduce_by_key(merge, order="natural")) == [None, 1, 2, 3, 12]
        assert keys(pairs.reduce_by_key(merge, order="desc")) == [12, 3, 2, 1, None]
        assert keys(pairs.filter("key IS NOT NULL").reduce_by_key(merge, cmp=lambda a, b: (a % 10 > b % 10) - (a % 10 < b % 10) or a - b)) == [1, 2, 12, 3]
    assert keys(pairs.filter("key IS NOT NULL").reduce_by_key(add, order=lambda k: -k)) == [12, 3, 2, 1]
    for wrong in ("sideways", F.col("key")):
        with pytest.raises(TypeError):
            pairs.reduce_by_key(add, order=wrong)


def test_java_hashes(spark):
    values = [0, 5, -1, 2**32, 2**31, -(2**63), 2**63 - 1, 7 * 10**15]
    want = [((v ^ ((v % 2**64) >> 32)) + 2**31) % 2**32 - 2**31 for v in values]
    assert [java_hash_of(v) for v in values] == want
    ordered = ints(spark, [*values, None]).sort(order="java_hash").collect()
    assert ordered == sorted([*values, None], key=lambda v: (java_hash_of(v), v is not None, v or 0))
    texts = ["", "Aa", "BB", "é日", "🙂x🙂", "polygenelubricants"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", java_hash(F.col("s")).alias("h")).collect()
    assert {r["s"]: r["h"] for r in got} == {t: java_hash_of(t) for t in texts}
    assert java_hash_of("🙂") == 1772965 and java_hash_of("polygenelubricants") == -(2**31)
    with pytest.raises(TypeError):
        from_frame(spark.range(2).selectExpr("cast(id AS double) AS value")).sort(order="java_hash")
    pairs = from_frame(spark.createDataFrame([(v, 1) for v in values], "key bigint, value int"))
    assert [k for k, _ in pairs.reduce_by_key("sum", order="java_hash").collect()] == [k for k, _ in pairs.reduce_by_key(lambda a, b: a + b, order="java_hash").sort(key=lambda kv: (java_hash_of(kv[0]), kv[0])).collect()]


def test_only_the_first_line_of_a_file_is_its_header(spark, tmp_path):
    for name, rows in (("a", ["x,y", "1,2", "x,y", "3,4"]), ("b", ["x,y", "5,6"]), ("c", ["7,8", "x,y"])):
        (tmp_path / f"{name}.csv").write_text("\n".join(rows) + "\n")
    got = delimited(spark, str(tmp_path), header=True).df.collect()
    assert sorted(tuple(r) for r in got) == [("1", "2"), ("3", "4"), ("5", "6"), ("7", "8"), ("x", "y"), ("x", "y")]


def test_http_over_pairs_rows_and_objects(spark):
    with EchoServer(delay=0.1) as server:
        url = server.url
        pairs = from_frame(spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int").coalesce(1))
        assert pairs.map_http(lambda c, kv: (kv[0], c.get(f"{url}/echo?value={kv[1]}")), "key string, value string").collect() == [("a", "1"), ("b", "2")]
        rows = from_frame(spark.createDataFrame([(1, "x", None), (2, "y", WIDE)], "id int, name string, n bigint").coalesce(1))
        assert [tuple(r) for r in rows.map_http(lambda c, r: (r.id, c.get(f"{url}/echo?value={r.name}"), r.n), "id int, said string, n bigint").df.collect()] == [(1, "x", None), (2, "y", WIDE)]
        objects = PyDataset(spark, spark.sparkContext.parallelize([{1}, {2}], 1))
        assert objects.map_http(lambda c, s: c.get(f"{url}/echo?value={max(s)}")).collect() == ["1", "2"]
        many = from_frame(spark.range(500).selectExpr("id AS value").coalesce(1))
        assert many.map_http(lambda c, x: int(c.get(f"{url}/echo?value={x}")), "int", max_in_flight=200, partitions=2).reduce("sum") == sum(range(500))
        assert server.most > 64


def test_objects_can_be_cached(spark):
    runs = spark.sparkContext.accumulator(0)

    def once(x):
        runs.add(1)
        return {x}

    number = PyDataset(spark, spark.sparkContext.parallelize(range(6), 2)).map(once).cache()
    assert sorted(map(max, cached(spark, number).collect())) == list(range(6)) and cached(spark, number).reduce(lambda a, b: a | b) == set(range(6))
    assert runs.value == 6


def test_placed_tells_a_sorts_order_and_persists_nothing(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = from_frame(spark.range(1000).selectExpr("id * 7919 % 1000 AS value")).sort("value").df
    got = placed(df).collect()
    assert all(r["pos"] == r["value"] + 1 for r in got) and len(got) == 1000
    assert placed(df.limit(0)).collect() == []
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before

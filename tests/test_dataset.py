"""Goldens, hazards and properties of the dataset facade."""

import random

import pytest
from pyspark.sql import functions as F

from weftspark import Dataset, PyDataset, cached, from_frame, lines, objects, py_objects, random_ints
from weftspark.dataset import EmptyDatasetError
from weftspark.functions.scalars import java_hash, wrap32
from weftspark.operators.order import numbered
from weftspark.operators.runs import reduce_runs


def ints(spark, values, parts=3):
    return from_frame(spark.createDataFrame([(v,) for v in values], "value bigint").repartition(parts))


def pairs(spark, values, parts=3):
    return from_frame(spark.createDataFrame(values, "key string, value bigint").repartition(parts))


def text_file(tmp_path, rows):
    path = tmp_path / "in.txt"
    path.write_text("".join(f"{r}\n" for r in rows))
    return str(path)


def test_sum_of_lines(spark, tmp_path):
    assert lines(spark, text_file(tmp_path, range(1, 101))).map("cast(value AS bigint)").reduce("sum", 0) == 5050


def test_sum_by_key_of_lines(spark, tmp_path):
    source = lines(spark, text_file(tmp_path, [f"{chr(97 + i % 3)},{i}" for i in range(1, 101)]))
    split = source.map({"key": "split(value, ',')[0]", "value": "cast(split(value, ',')[1] AS bigint)"})
    assert split.reduce_by_key("sum", order="natural").show() == "a,1683\nb,1717\nc,1650"


def test_line_ends_and_order(spark, tmp_path):
    path = tmp_path / "ends.txt"
    path.write_bytes(b"a\r\nb\rc\n\nd\n")
    assert [r["value"] for r in lines(spark, str(path), ordered=True).df.orderBy("pos").collect()] == ["a", "b", "c", "", "d"]


def test_two_files_are_one_dataset(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("x,1\ny,2\n")
    got = lines(spark, str(tmp_path)).map({"key": "split(value, ',')[0]", "value": "cast(split(value, ',')[1] AS bigint)"}).reduce_by_key("sum")
    assert sorted(got.collect()) == [("x", 2), ("y", 4)]


def test_python_functions_match_columns(spark):
    data = ints(spark, range(50))
    assert sorted(data.map(lambda x: x * 2, "bigint").collect()) == sorted(data.map("value * 2").collect())
    assert sorted(data.map(lambda x: x * 2).collect()) == [2 * x for x in range(50)]
    assert sorted(data.filter(lambda x: x % 3 == 0).collect()) == sorted(data.filter("value % 3 = 0").collect())
    assert sorted(data.map(lambda x: (str(x), x), "key string, value bigint").collect())[:2] == [("0", 0), ("1", 1)]
    assert isinstance(data.map(lambda x: x), PyDataset)


def test_map_ordered_and_map_fusion(spark):
    data = ints(spark, random.Random(1).sample(range(1000), 300), 7)
    rows = data.map_ordered("value + 1", "value").df.orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(1, 301))
    assert [r["value"] for r in rows] == sorted(r["value"] for r in rows)
    assert sorted(data.map("value + 1").map("value * 3").collect()) == sorted(data.map("(value + 1) * 3").collect())
    assert sorted(data.filter("value > 500").map("value * 2").collect()) == sorted(data.map("value * 2").filter("value > 1000").collect())


def test_null_predicate_drops(spark):
    df = spark.createDataFrame([(1,), (None,)], "value bigint")
    assert Dataset(df).filter("value > 0").collect() == [1]


# ---- reduce


def test_reduce_default_is_no_seed(spark):
    assert ints(spark, [1, 2, 3]).reduce("sum", 100) == 6
    assert ints(spark, [1, 2, 3]).reduce(lambda a, b: a + b, 100) == 6
    assert ints(spark, [1, 2, 3], 8).reduce(lambda a, b: a + b, 100) == 6  # empty partitions add nothing
    assert ints(spark, [1, 2, 3]).reduce("sum") == 6
    assert ints(spark, []).reduce("sum", 7) == 7
    assert ints(spark, []).reduce(lambda a, b: a + b, 7) == 7
    for merge in ("sum", lambda a, b: a + b):
        with pytest.raises(EmptyDatasetError):
            ints(spark, []).reduce(merge)


def test_errors_of_the_users_merge_come_through(spark):
    def broken(a, b):
        raise NotImplementedError("no")

    with pytest.raises(Exception, match="no"):
        ints(spark, [1, 2, 3]).reduce(broken, 0)


def test_reduce_by_key_tiers_agree(spark):
    data = pairs(spark, [(random.Random(k).choice("abc"), k) for k in range(200)])
    named = dict(data.reduce_by_key("sum").collect())
    assert named == dict(data.reduce_by_key(lambda a, b: a + b).collect())
    assert named == dict(data.fold_by_key(F.lit(0).cast("bigint"), lambda a, b: a + b).collect())
    assert sum(named.values()) == data.map("value").reduce("sum")
    with pytest.raises(ValueError, match="unknown merge"):
        data.reduce_by_key("median")


def test_keys_of_equal_hash_do_not_mix(spark):
    data = pairs(spark, [("Aa", 1), ("BB", 2)] * 20)
    assert sorted(data.reduce_by_key("sum", order="java_hash").collect()) == [("Aa", 20), ("BB", 40)]
    hashes = spark.createDataFrame([("Aa",), ("BB",), ("",), ("polygenelubricants",)], "s string").select(java_hash(F.col("s")).alias("h")).collect()
    assert [r["h"] for r in hashes] == [2112, 2112, 0, -2147483648]


def test_struct_and_null_keys_and_one_key(spark):
    df = spark.createDataFrame([((1, 2), 1), ((1, 2), 2), (None, 5), (None, 6)], "key struct<a:int,b:int>, value bigint")
    got = {tuple(k) if k else None: v for k, v in Dataset(df).reduce_by_key("sum").collect()}
    assert got == {(1, 2): 3, None: 11}
    assert pairs(spark, [("x", 1)] * 100, 20).reduce_by_key("count").collect() == [("x", 100)]
    assert pairs(spark, []).reduce_by_key("sum").collect() == []
    assert pairs(spark, []).sort().collect() == []


def test_order_is_not_grouping(spark):
    data = pairs(spark, [("A", 1), ("a", 2), ("a", 3), ("A", 4)])
    got = data.reduce_by_key("sum", order=lambda k: F.lower(k)).collect()
    assert dict(got) == {"A": 5, "a": 5}


@pytest.mark.parametrize("keys", ["AaaA", "", "A", "ABABAB", "AAAAAAAABBBBBBBBBBBBBBA"])
def test_runs(spark, keys):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, at bigint").repartition(5)
    got = reduce_runs(df, F.col("k"), [F.col("at")], n=F.count("*")).orderBy("first_pos").collect()
    want, at = [], 0
    while at < len(keys):
        end = at
        while end < len(keys) and keys[end] == keys[at]:
            end += 1
        want.append((keys[at], at + 1, end, end - at))
        at = end
    assert [tuple(r) for r in got] == want


# ---- sort


def test_sorts(spark):
    rng = random.Random(3)
    values = [rng.randint(-500, 500) for _ in range(2500)]
    data = ints(spark, values, 6)
    assert data.sort().collect() == sorted(values)
    assert data.sort(order="desc").collect() == sorted(values, reverse=True)
    assert data.sort(cmp=lambda a, b: (abs(a) > abs(b)) - (abs(a) < abs(b)) or (a > b) - (a < b)).collect() == sorted(values, key=lambda x: (abs(x), x))
    assert Dataset(data.df).sort("value % 7", "value").collect() == sorted(values, key=lambda x: (abs(x) % 7 * (1 if x >= 0 else -1), x))


def test_numbered_with_ties(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(300)], "a int, b int").repartition(9)
    rows = numbered(df, F.col("a")).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(1, 301))
    assert [r["a"] for r in rows] == sorted(r["a"] for r in rows)
    assert numbered(df.limit(0), F.col("a")).count() == 0


# ---- sinks, cache, random


def test_round_trips(spark, tmp_path):
    data = pairs(spark, [("x", 1), ("y", 2), ("y", 2)])
    data.save_objects(str(tmp_path / "o"))
    data.save_objects(str(tmp_path / "o"))  # over what was there
    assert sorted(objects(spark, str(tmp_path / "o")).collect()) == sorted(data.collect())
    data.save_text(str(tmp_path / "t"), single=True)
    assert sorted(lines(spark, str(tmp_path / "t")).collect()) == ["x,1", "y,2", "y,2"]
    odd = data.objects().map(lambda kv: {kv[0]: [kv[1]]})
    odd.save_objects(str(tmp_path / "p"))
    odd.save_objects(str(tmp_path / "p"))
    assert sorted(map(str, py_objects(spark, str(tmp_path / "p")).collect())) == sorted(map(str, odd.collect()))


def test_text_with_line_feed_splits(spark, tmp_path):
    Dataset(spark.createDataFrame([("a\nb",)], "value string")).save_text(str(tmp_path / "t"))
    assert lines(spark, str(tmp_path / "t")).df.count() == 2


def test_cache(spark):
    data = ints(spark, range(250))
    number = data.cache()
    assert data.cache() == number
    assert sorted(cached(spark, number).collect()) == list(range(250))
    assert ints(spark, range(3)).cache() != number
    with pytest.raises(KeyError):
        cached(spark, 10**9)
    assert cached(spark, 10**9, missing_ok=True).collect() == []


def test_random_ints(spark):
    one = random_ints(spark, 1001, seed=5, partitions=7).collect()
    assert len(one) == 1001 and len(set(one)) > 990
    assert sorted(one) == sorted(random_ints(spark, 1001, seed=5, partitions=2).collect())
    assert sorted(one) != sorted(random_ints(spark, 1001, seed=6).collect())
    assert min(one) < 0 < max(one)


def test_64_bit_arithmetic(spark):
    df = spark.createDataFrame([(-(1 << 31),), (2147483647,), (2147483647,)], "value int")
    assert Dataset(df).map("abs(cast(value AS bigint)) % 100").reduce("sum") == 48 + 47 + 47
    assert Dataset(df).reduce("sum") == 2147483646
    assert [r[0] for r in spark.range(1).select(wrap32(F.lit((1 << 31) + 5)), ).collect()] == [-(1 << 31) + 5]


def test_show_prints_all(spark, capsys):
    ints(spark, range(30)).show("value")
    assert capsys.readouterr().out.split() == [str(x) for x in range(30)]

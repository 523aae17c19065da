"""Registered queries over the test tables, with the SQL that each must match."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark import Dataset, cached, delimited, lines, objects
from weftspark.functions import rows
from weftspark.functions.scalars import render
from weftspark.operators.http import AsyncHttpClient
from weftspark.operators.order import placed
from weftspark.operators.runs import reduce_runs
from weftspark.plans import jobs
from weftspark.session import scratch_path
from weftspark.shell import names
from weftspark.sources.readers import random_ints as random_source


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def lines_numbers_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "numbers")
    Dataset(_table(spark, sf_dir, "events").select("event_id")).save_text(path)
    return lines(spark, path).map("cast(value AS bigint)").df.agg(F.sum("value").alias("total"))


def map_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(_table(spark, sf_dir, "events")).map({"event_id": F.col("event_id"), "cents": _cents("value")}).df


def map_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a null and a 54-bit integer in each batch, which functions must see as they are."""
    wide = F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") + (1 << 53) + 1)
    customers = Dataset(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", wide.alias("wide"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance")))
    return customers.map(lambda r: (r.c_custkey, r.c_name.upper(), None if r.wide is None else r.wide + 2, r.balance), "c_custkey bigint, loud string, wide bigint, balance decimal(12,2)", in_flight=4).df.withColumn("balance", (F.col("balance") * 100).cast("bigint"))


def map_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(_table(spark, sf_dir, "events")).map_ordered({"event_id": F.col("event_id"), "kind": F.upper("event_type")}, "event_id").df


def filter_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Dataset(_table(spark, sf_dir, "lineitem")).filter("l_quantity > 45")
    return found.df.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("quantity"))


def filter_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") + (1 << 53) + 1)
    found = Dataset(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("quantity"), wide.alias("wide")))
    return found.filter(lambda r: r.quantity > 45 and r.wide is not None).df


def pair_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(_table(spark, sf_dir, "nation")).map({"key": F.col("n_name"), "value": F.col("n_regionkey")}).map(render("key", "value").alias("value")).df.withColumnRenamed("value", "line")


def _quantities(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(_table(spark, sf_dir, "lineitem")).map({"key": F.concat_ws("-", "l_returnflag", "l_linestatus"), "value": F.col("l_quantity").cast("bigint")})


def _reduced(merge: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _quantities(spark, sf_dir).reduce_by_key(merge).df

    return query


def rbk_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantities(spark, sf_dir).reduce_by_key("avg").df.withColumn("value", F.round(F.col("value") * 1000).cast("bigint"))


def rbk_fold_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantities(spark, sf_dir).fold_by_key(F.lit(0).cast("bigint"), lambda a, b: a + b).df


def rbk_python_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _quantities(spark, sf_dir).reduce_by_key(lambda a, b: (a + b) % 1000003)
    return spark.createDataFrame(out.rdd, "key string, value bigint")


def rbk_struct_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = Dataset(_table(spark, sf_dir, "customer")).map({"key": F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")), "value": _cents("c_acctbal")})
    return pairs.reduce_by_key("sum").df.select("key.nation", "key.segment", F.col("value").alias("cents"))


def rbk_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = Dataset(_table(spark, sf_dir, "orders")).map({"key": F.col("o_custkey"), "value": F.lit(1)})
    return pairs.reduce_by_key("count").filter("value >= 15").df


def rbk_custom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order is the reduce's own; placed only tells it."""
    return placed(_quantities(spark, sf_dir).reduce_by_key("sum", order=lambda key: F.reverse(key)).df)


def rbk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_runs(_table(spark, sf_dir, "events").select("ts", "event_type"), F.col("event_type"), [F.col("ts")], n=F.count("*"))


def distinct_idiom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(_table(spark, sf_dir, "lineitem")).map({"key": F.col("l_suppkey"), "value": F.lit(1)}).reduce_by_key("any").df.select("key")


def _scalar(merge: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = Dataset(_table(spark, sf_dir, "orders")).map(_cents("o_totalprice")).reduce(merge, 0)
        return spark.createDataFrame([(value,)], "value bigint")

    return query


def reduce_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = Dataset(_table(spark, sf_dir, "orders")).map(F.pmod("o_orderkey", F.lit(10))).reduce("sum", 0)
    return spark.createDataFrame([(value % 10000,)], "value bigint")


def reduce_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = Dataset(_table(spark, sf_dir, "orders")).map("o_orderkey").reduce(lambda a, b: max(a, b), -1)
    return spark.createDataFrame([(value,)], "value bigint")


def reduce_empty_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = Dataset(_table(spark, sf_dir, "orders")).filter("o_orderkey < 0").map("o_orderkey").reduce("sum", 0)
    return spark.createDataFrame([(value,)], "value bigint")


def most_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.most_popular(jobs.frequencies(_table(spark, sf_dir, "lineitem"), "l_partkey"))


def sorted_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(Dataset(_table(spark, sf_dir, "customer").select("c_name", "c_custkey")).sort("c_name", "c_custkey").df)


def sorted_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(Dataset(_table(spark, sf_dir, "events").select("event_id", "ts")).sort(F.col("ts").desc(), "event_id").df)


def sorted_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(Dataset(_table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey")).sort("p_brand", F.col("p_size").desc(), "p_partkey").df)


def _blind(a: tuple, b: tuple) -> int:
    x, y = (a[0].lower(), a[0], a[1]), (b[0].lower(), b[0], b[1])
    return (x > y) - (x < y)


def sorted_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = Dataset(_table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("value"))).sort(cmp=_blind)
    return spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1] + 1)), "name string, partkey bigint, pos bigint")


def sorted_java_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftspark.functions.scalars import java_hash

    names = Dataset(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))).sort(order="java_hash").df
    return placed(names).select(F.col("value").alias("n_name"), java_hash(F.col("value")).alias("hash"), "pos")


def sorted_java_hash_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = Dataset(_table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7_000_000_011).alias("value"))).sort(order="java_hash").df
    return placed(keys)


def _written(spark: SparkSession, df: DataFrame, sep: str, header: bool) -> str:
    path = scratch_path(spark, "rows")
    body = df.select(render(*df.columns, sep=sep).alias("value"))
    if header:
        body = spark.createDataFrame([(sep.join(df.columns),)], "value string").unionByName(body)
    body.coalesce(1).write.text(path)
    return path


def rows_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ",", True)
    return delimited(spark, path, header=True, kinds=["INT", "STRING", "INT"]).df


def rows_generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited(spark, _written(spark, _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "||", False), sep="||").df


def rows_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("decimal(12,2)").alias("s_acctbal")), "|", True)
    df = delimited(spark, path, header=True, sep="|", kinds=["INT", "STRING", "DOUBLE"]).df
    key, name, balance = rows.typed(df, "s_suppkey", "INT"), rows.typed(df, "s_name", "STRING"), rows.typed(df, "s_acctbal", "DOUBLE")
    return df.select(key, name, F.round(balance * 100).cast("bigint").alias("cents"))


def rows_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by their places, which come from their names."""
    df = delimited(spark, _written(spark, _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ",", True), header=True).df
    second, last, none = (rows.index_of(df.schema, n) for n in ("n_name", "n_regionkey", "n_comment"))
    return df.select(df[second].alias("name"), df[last].alias("region"), F.lit(none is None).alias("missing"))


def shell_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shell calls lines, objects and cached."""
    call = names(spark)
    nations = Dataset(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")))
    text, folder = scratch_path(spark, "text"), scratch_path(spark, "objects")
    nations.save_text(text)
    nations.save_objects(folder)
    said = call["lines"](text).df.select(F.lit("lines").alias("kind"), F.col("value").alias("line"))
    kept = call["objects"](folder).rendered().select(F.lit("objects").alias("kind"), F.col("value").alias("line"))
    held = call["cached"](nations.cache()).rendered().select(F.lit("cached").alias("kind"), F.col("value").alias("line"))
    return said.unionByName(kept).unionByName(held)


def rows_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.element_at(F.array(*[F.lit(x) for x in ("TRUE", "true", "yes", "1", "", "False")]), (F.col("r_regionkey") % 6 + 1).cast("int"))
    path = _written(spark, _table(spark, sf_dir, "region").select("r_regionkey", flags.alias("flag")), ",", True)
    return delimited(spark, path, header=True, kinds=["INT", "BOOLEAN"]).df


def rows_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select("n_nationkey", render("n_nationkey", "n_name", "n_regionkey", sep=";").alias("line"))


def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "text")
    Dataset(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))).save_text(path)
    return lines(spark, path).df.withColumnRenamed("value", "line")


def object_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "objects")
    Dataset(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")).save_objects(path)
    return objects(spark, path).df


def cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = Dataset(_table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), _cents("value").alias("value"))).cache()
    return cached(spark, number).reduce_by_key("sum").df


def random_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random_source(spark, 10_000, seed=7).df.groupBy("value").count().withColumnRenamed("count", "n")


def map_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over pairs, each with a call of its own to a stub beside its task: one in the driver would be slower than the tasks."""
    pairs = Dataset(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 10).alias("value")))

    async def digit(client: AsyncHttpClient, pair: tuple[int, int]) -> tuple[int, int]:
        return pair[0] % 10, await jobs.echoed(client, pair[1])

    got = pairs.map_http(digit, "key bigint, value bigint", partitions=spark.sparkContext.defaultParallelism)
    value = got.filter("key = value").map("value").reduce("sum", 0)
    return spark.createDataFrame([(value % 10000,)], "value bigint")


def show_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = Dataset(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")))
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        text = ordered.show(order="key")
    assert shown.getvalue() == text + "\n"
    return spark.createDataFrame([(text,)], "text string")


QUERIES = {
    "lines_numbers_sum": lines_numbers_sum,
    "map_expr": map_expr,
    "map_python": map_python,
    "map_ordered": map_ordered,
    "map_http": map_http,
    "filter_expr": filter_expr,
    "filter_python": filter_python,
    "pair_render": pair_render,
    "rbk_sum": _reduced("sum"),
    "rbk_min": _reduced("min"),
    "rbk_max": _reduced("max"),
    "rbk_count": _reduced("count"),
    "rbk_avg": rbk_avg,
    "rbk_fold_expr": rbk_fold_expr,
    "rbk_python_merge": rbk_python_merge,
    "rbk_struct_key": rbk_struct_key,
    "rbk_then_filter": rbk_then_filter,
    "rbk_custom_order": rbk_custom_order,
    "rbk_runs": rbk_runs,
    "distinct_idiom": distinct_idiom,
    "reduce_sum": _scalar("sum"),
    "reduce_max": _scalar("max"),
    "reduce_mod": reduce_mod,
    "reduce_python": reduce_python,
    "reduce_empty_default": reduce_empty_default,
    "most_popular": most_popular,
    "sorted_natural": sorted_natural,
    "sorted_desc": sorted_desc,
    "sorted_multi": sorted_multi,
    "sorted_cmp": sorted_cmp,
    "sorted_java_hash": sorted_java_hash,
    "sorted_java_hash_long": sorted_java_hash_long,
    "rows_header": rows_header,
    "rows_generated_names": rows_generated_names,
    "rows_typed": rows_typed,
    "rows_boolean": rows_boolean,
    "rows_by_position": rows_by_position,
    "shell_names": shell_names,
    "rows_render": rows_render,
    "text_roundtrip": text_roundtrip,
    "object_roundtrip": object_roundtrip,
    "cache_roundtrip": cache_roundtrip,
    "random_ints": random_ints,
    "show_concat": show_concat,
}

_FLAGS = "SELECT l_returnflag || '-' || l_linestatus AS key, {} AS value FROM lineitem GROUP BY 1"
_QUANTITY = "CAST(l_quantity AS BIGINT)"
_ROUND = f"(xor({{0}}, {{0}} >> 16) * {0x45D9F3B}) % 4294967296"
_HASH = "list_reduce(list_transform(string_split(n_name, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, x: (31 * h + x) % 4294967296)"

ORACLES = {
    "lines_numbers_sum": "SELECT CAST(sum(event_id) AS BIGINT) AS total FROM events",
    "map_expr": "SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events",
    "map_python": "SELECT c_custkey, upper(c_name) AS loud, CASE WHEN c_custkey % 3 > 0 THEN c_custkey + 9007199254740995 END AS wide, CAST(round(CAST(c_acctbal AS DECIMAL(12, 2)) * 100) AS BIGINT) AS balance FROM customer",
    "map_ordered": "SELECT event_id, upper(event_type) AS kind, row_number() OVER (ORDER BY event_id) AS pos FROM events",
    "map_http": "SELECT CAST(sum(o_orderkey % 10) % 10000 AS BIGINT) AS value FROM orders",
    "filter_expr": f"SELECT l_orderkey, l_linenumber, {_QUANTITY} AS quantity FROM lineitem WHERE l_quantity > 45",
    "filter_python": f"SELECT l_orderkey, l_linenumber, {_QUANTITY} AS quantity, l_orderkey + 9007199254740993 AS wide FROM lineitem WHERE l_quantity > 45 AND l_linenumber > 1",
    "pair_render": "SELECT concat_ws(',', n_name, n_regionkey) AS line FROM nation",
    "rbk_sum": _FLAGS.format(f"CAST(sum({_QUANTITY}) AS BIGINT)"),
    "rbk_min": _FLAGS.format(f"min({_QUANTITY})"),
    "rbk_max": _FLAGS.format(f"max({_QUANTITY})"),
    "rbk_count": _FLAGS.format("count(*)"),
    "rbk_avg": _FLAGS.format(f"CAST(round(avg({_QUANTITY}) * 1000) AS BIGINT)"),
    "rbk_fold_expr": _FLAGS.format(f"CAST(sum({_QUANTITY}) AS BIGINT)"),
    "rbk_python_merge": _FLAGS.format(f"CAST(sum({_QUANTITY}) % 1000003 AS BIGINT)"),
    "rbk_struct_key": "SELECT c_nationkey AS nation, c_mktsegment AS segment, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer GROUP BY 1, 2",
    "rbk_then_filter": "SELECT o_custkey AS key, count(*) AS value FROM orders GROUP BY 1 HAVING count(*) >= 15",
    "rbk_custom_order": f"SELECT *, row_number() OVER (ORDER BY reverse(key)) AS pos FROM ({_FLAGS.format(f'CAST(sum({_QUANTITY}) AS BIGINT)')})",
    "rbk_runs": "SELECT any_value(event_type) AS key, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY event_type ORDER BY ts) AS island FROM (SELECT event_type, ts, row_number() OVER (ORDER BY ts, event_type) AS pos FROM events)) GROUP BY event_type, island",
    "distinct_idiom": "SELECT DISTINCT l_suppkey AS key FROM lineitem",
    "reduce_sum": "SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM orders",
    "reduce_max": "SELECT max(CAST(round(o_totalprice * 100) AS BIGINT)) AS value FROM orders",
    "reduce_mod": "SELECT CAST(sum(o_orderkey % 10) % 10000 AS BIGINT) AS value FROM orders",
    "reduce_python": "SELECT max(o_orderkey) AS value FROM orders",
    "reduce_empty_default": "SELECT CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS value FROM orders WHERE o_orderkey < 0",
    "most_popular": "SELECT abs(l_partkey) % 100 AS key, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, key DESC LIMIT 1",
    "sorted_natural": "SELECT c_name, c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS pos FROM customer",
    "sorted_desc": "SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id) AS pos FROM events",
    "sorted_multi": "SELECT p_brand, p_size, p_partkey, row_number() OVER (ORDER BY p_brand, p_size DESC, p_partkey) AS pos FROM part",
    "sorted_cmp": "SELECT p_name AS name, p_partkey AS partkey, row_number() OVER (ORDER BY lower(p_name), p_name, p_partkey) AS pos FROM part",
    "sorted_java_hash": f"SELECT n_name, CAST(hash AS INTEGER) AS hash, row_number() OVER (ORDER BY hash, n_name) AS pos FROM (SELECT n_name, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM (SELECT n_name, {_HASH} AS h FROM nation))",
    "rows_header": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "rows_generated_names": "SELECT CAST(n_nationkey AS VARCHAR) AS col0, n_name AS col1, CAST(n_regionkey AS VARCHAR) AS col2 FROM nation",
    "rows_typed": "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, CAST(round(s_acctbal * 100) AS BIGINT) AS cents FROM supplier",
    "rows_boolean": "SELECT r_regionkey, r_regionkey % 6 < 2 AS flag FROM region",
    "rows_by_position": "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, true AS missing FROM nation",
    "shell_names": "SELECT kind, concat_ws(',', n_nationkey, n_name) AS line FROM nation, (VALUES ('lines'), ('objects'), ('cached')) k(kind)",
    "rows_render": "SELECT n_nationkey, concat_ws(';', n_nationkey, n_name, n_regionkey) AS line FROM nation",
    "text_roundtrip": "SELECT concat_ws(',', p_partkey, p_name) AS line FROM part",
    "object_roundtrip": "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders",
    "cache_roundtrip": "SELECT event_type AS key, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY 1",
    "sorted_java_hash_long": "SELECT value, row_number() OVER (ORDER BY CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END, value) AS pos FROM (SELECT value, xor(value, value >> 32) & 4294967295 AS h FROM (SELECT o_orderkey * 7000000011 AS value FROM orders))",
    "random_ints": f"SELECT CAST(CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END AS INTEGER) AS value, count(*) AS n FROM (SELECT xor(b, b >> 16) AS x FROM (SELECT {_ROUND.format('a')} AS b FROM (SELECT {_ROUND.format('i')} AS a FROM (SELECT xor(range, {7 * 0x45D9F3B}) AS i FROM range(10000))))) GROUP BY 1",
    "show_concat": "SELECT string_agg(concat_ws(',', n_nationkey, n_name), chr(10) ORDER BY n_nationkey) AS text FROM nation",
}

"""The dataset facade.

Dataset holds a DataFrame: scalars in column value, pairs in key and value, rows in
their own columns. Column expressions and named merges compile to Catalyst plans.
A Python function with a declared result runs over Arrow batches; one without, or
a Python merge or comparator, falls back to PyDataset, which holds an RDD of objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from weftspark.functions.scalars import java_hash_of, render
from weftspark.operators import cache as kept
from weftspark.operators.calls import Returns, called, elements
from weftspark.operators.http import AsyncHttpClient, HttpClient, awaited, map_http, mapped_objects, taking_turns
from weftspark.operators.monoids import aggregate
from weftspark.operators.order import CmpKey, numbered, sort_columns

MISSING: Any = type("Missing", (), {"__repr__": lambda self: "MISSING"})()


class EmptyDatasetError(ValueError):
    """A reduce of nothing, without a default."""


class Dataset:
    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def pairs(self) -> bool:
        return {"key", "value"} <= set(self.df.columns)

    def _columns(self, what: Column | str | list | tuple | dict) -> list[Column]:
        if isinstance(what, dict):
            return [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in what.items()]
        if isinstance(what, (list, tuple)):
            return [F.expr(c) if isinstance(c, str) else c for c in what]
        return [(F.expr(what) if isinstance(what, str) else what).alias("value")]

    # ---- narrow transforms

    def map(self, what: Column | str | list | dict | Callable, returns: str | DataType | None = None, *, in_flight: int = 1) -> "Dataset | PyDataset":
        """One output per input. Columns and SQL stay in Catalyst; a function needs `returns` to stay a Dataset.

        A function sees Python values as Arrow has them: a null is None, integers are whole at any size. With
        in_flight over 1 a task runs so many calls at once (the reference's limit is 1000), in threads; order stays.
        """
        if not callable(what) or isinstance(what, Column):
            return Dataset(self.df.select(*self._columns(what)))
        if returns is None:
            return self.objects().map(what)
        element, shape = self._element(), Returns(returns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, out in called(batches, lambda x: what(element(x)), in_flight):
                yield shape.batch(out)

        return Dataset(self.df.mapInArrow(run, shape.schema))

    def map_ordered(self, what: Column | str | list | dict, order: Column | str) -> "Dataset":
        """map that also carries each element's place as column pos, by the given order of the input.

        Narrow transforms keep the order within a partition anyway; pos makes it observable.
        """
        by = F.col(order) if isinstance(order, str) else order
        placed = numbered(self.df, by)
        return Dataset(placed.select(*self._columns(what), "pos"))

    def map_http(self, function: Callable[[HttpClient, Any], Any], returns: str | DataType, **how: Any) -> "Dataset":
        """map with an HTTP client over elements, pairs and rows, too; see operators.http.map_http."""
        return Dataset(map_http(self.df, function, returns, element=self._element(), **how))

    def filter(self, what: Column | str | Callable, *, in_flight: int = 1) -> "Dataset":
        """Elements for which the predicate is true; null drops, as in SQL. Functions as in map."""
        if not callable(what) or isinstance(what, Column):
            return Dataset(self.df.filter(what))
        element = self._element()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, out in called(batches, lambda x: bool(what(element(x))), in_flight):
                yield batch.filter(pa.array(out, pa.bool_()))

        return Dataset(self.df.mapInArrow(run, self.df.schema))

    # ---- wide transforms

    def reduce_by_key(self, merge: str | Callable, order: str | Column | Callable | None = None, cmp: Callable[[Any, Any], int] | None = None) -> "Dataset | PyDataset":
        """One row per distinct key (a null key is a key). merge: a named merge, or a function (a, b) -> c.

        A named merge is a partial and a final aggregate around one shuffle. A
        function must be associative and commutative. order sorts the result: natural, desc, java_hash, or a
        key made of the key (of its column for a named merge, of the object for a function); cmp compares two keys.
        """
        if not isinstance(merge, str) or cmp is not None:
            data = self if not isinstance(merge, str) else self.reduce_by_key(merge)
            return data.objects().reduce_by_key(merge, order, cmp) if data is self else data.objects().sort_keys(order, cmp)
        df = self.df.groupBy("key").agg(aggregate(merge, F.col("value")).alias("value"))
        return Dataset(df.orderBy(*sort_columns(df, "key", order)) if order is not None else df)

    def fold_by_key(self, zero: Column, merge: Callable[[Column, Column], Column]) -> "Dataset":
        """reduce_by_key with a merge of column expressions, zero being neutral.

        Values fold within (key, input partition) first, so a hot key is never gathered whole: a second fold
        sees one value per key and partition. The values themselves move once; where a named merge does the
        same, reduce_by_key moves partial results only.
        """
        fold = lambda c: F.reduce(F.collect_list(c), zero, merge)
        part = self.df.withColumn("__part", F.spark_partition_id()).groupBy("key", "__part").agg(fold("value").alias("value"))
        return Dataset(part.groupBy("key").agg(fold("value").alias("value")))

    def sort(self, *keys: Column | str, order: str | Callable | None = None, cmp: Callable[[Any, Any], int] | None = None) -> "Dataset | PyDataset":
        """Global order: by columns, by a named order of the element, or by a comparator of objects."""
        if cmp is not None:
            return self.objects().sort(cmp=cmp)
        if keys:
            return Dataset(self.df.orderBy(*[F.expr(k) if isinstance(k, str) else k for k in keys]))
        column = "key" if self.pairs else self.df.columns[0]
        return Dataset(self.df.orderBy(*sort_columns(self.df, column, order)))

    # ---- actions

    def reduce(self, merge: str | Callable, default: Any = MISSING) -> Any:
        """All values merged. default is for an empty dataset only, never a seed."""
        if not isinstance(merge, str):
            return self.objects().reduce(merge, default)
        got = self.df.agg(aggregate(merge, F.col("value")).alias("v"), F.count(F.lit(1)).alias("n")).first()
        if not got["n"]:
            if default is MISSING:
                raise EmptyDatasetError("reduce of an empty dataset")
            return default
        return got["v"]

    def rendered(self) -> DataFrame:
        """Elements as text, in column value: pairs and rows with commas between."""
        return self.df.select(render(*self.df.columns).alias("value"))

    def save_text(self, path: str, *, single: bool = False) -> None:
        """One line per element, over what was there. A line feed inside an element becomes a line end on reading."""
        df = self.rendered()
        (df.coalesce(1) if single else df).write.mode("overwrite").text(path)

    def save_objects(self, path: str) -> None:
        """Rows with their schema, over what was there."""
        self.df.write.mode("overwrite").parquet(path)

    def cache(self) -> int:
        """Runs now and keeps the rows; the number is for sources.cached."""
        return kept.keep(self.df)

    def show(self, order: Column | str | None = None) -> str:
        """Prints all elements, one per line; they come to the driver. Returns the text."""
        if order is None:
            text = "\n".join(r["value"] for r in self.rendered().collect())
        else:
            rows = self.df.orderBy(order)
            text = "\n".join(r["value"] for r in Dataset(rows).rendered().collect())
        print(text)
        return text

    def collect(self) -> list:
        element = self._element()
        return [element(tuple(r)) for r in self.df.collect()]

    # ---- elements

    def _element(self) -> Callable[[tuple], Any]:
        return elements(self.df.columns)

    def objects(self) -> "PyDataset":
        element = self._element()
        return PyDataset(self.spark, self.df.rdd.map(lambda r: element(tuple(r))))


class PyDataset:
    """Opaque Python objects. Used where a function, merge or comparator cannot be a column expression."""

    def __init__(self, spark: SparkSession, rdd: RDD):
        self.spark, self.rdd = spark, rdd

    def map(self, f: Callable, *, in_flight: int = 1) -> "PyDataset":
        if in_flight > 1:
            return PyDataset(self.spark, self.rdd.mapPartitions(lambda rows: mapped_objects(rows, f, in_flight)))
        return PyDataset(self.spark, self.rdd.map(f))

    def map_http(self, function: Callable[[HttpClient, Any], Any], *, max_in_flight: int = 64, timeout: float = 30.0, retries: int = 2) -> "PyDataset":
        """map with an HTTP client for each task, closed at its end; async functions as in operators.http.map_http."""
        turns = awaited(function)

        def run(rows: Iterator) -> Iterator:
            client = (AsyncHttpClient if turns else HttpClient)(timeout, retries)
            try:
                if turns:
                    yield from taking_turns(rows, lambda x: function(client, x), client, max_in_flight)
                else:
                    yield from mapped_objects(rows, lambda x: function(client, x), max_in_flight)
            finally:
                client.close()

        return PyDataset(self.spark, self.rdd.mapPartitions(run))

    def map_ordered(self, f: Callable) -> "PyDataset":
        return self.map(f)

    def filter(self, f: Callable) -> "PyDataset":
        return PyDataset(self.spark, self.rdd.filter(f))

    def reduce_by_key(self, merge: Callable, order: str | Callable | None = None, cmp: Callable[[Any, Any], int] | None = None) -> "PyDataset":
        """Merges on the map side first; order and cmp as in sort_keys."""
        return PyDataset(self.spark, self.rdd.reduceByKey(merge)).sort_keys(order, cmp)

    def sort_keys(self, order: str | Callable | None, cmp: Callable[[Any, Any], int] | None = None) -> "PyDataset":
        """Pairs sorted by key: natural, desc, java_hash, a function of the key, or a comparator of keys; None stands first."""
        if cmp is not None:
            return self.sort(cmp=lambda a, b: cmp(a[0], b[0]))
        if order is None:
            return self
        if isinstance(order, str) and order in ("natural", "desc"):
            return self.sort(key=lambda kv: (kv[0] is not None, kv[0]) if kv[0] is not None else (False,), ascending=order == "natural")
        if isinstance(order, str) and order == "java_hash":
            return self.sort(key=lambda kv: (java_hash_of(kv[0]), str(kv[0])))
        if callable(order) and not isinstance(order, Column):
            return self.sort(key=lambda kv: order(kv[0]))
        raise TypeError(f"objects cannot be sorted by {order!r}: natural, desc, java_hash, a function of the key, or cmp")

    def sort(self, key: Callable | None = None, cmp: Callable[[Any, Any], int] | None = None, ascending: bool = True) -> "PyDataset":
        by = (lambda x: CmpKey(cmp, x)) if cmp is not None else key or (lambda x: x)
        return PyDataset(self.spark, self.rdd.sortBy(by, ascending))

    def reduce(self, merge: Callable, default: Any = MISSING) -> Any:
        if default is not MISSING and self.rdd.isEmpty():
            return default
        try:
            return self.rdd.reduce(merge)
        except ValueError as e:
            if "empty RDD" in str(e):
                raise EmptyDatasetError("reduce of an empty dataset") from e
            raise

    def save_text(self, path: str) -> None:
        self.to_frame(str, "string").write.mode("overwrite").text(path)

    def save_objects(self, path: str) -> None:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        self.rdd.saveAsPickleFile(path)

    def cache(self) -> int:
        """Runs now and keeps the objects; the number is for sources.cached."""
        return kept.keep_objects(self.spark, self.rdd)

    def to_frame(self, f: Callable, kind: str) -> DataFrame:
        return self.spark.createDataFrame(self.rdd.map(lambda x: (f(x),)), f"value {kind}")

    def show(self) -> str:
        text = "\n".join(self.rdd.map(str).collect())
        print(text)
        return text

    def collect(self) -> list:
        return self.rdd.collect()

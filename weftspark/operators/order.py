"""Orders: sort keys, hash order, comparators, and positions in a global order."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.functions.scalars import java_hash_column
from weftspark.session import scratch_path


class CmpKey:
    """A sort key from a comparator (a, b) -> negative, zero or positive. Pickles with its comparator."""

    __slots__ = ("compare", "item")

    def __init__(self, compare: Callable[[Any, Any], int], item: Any):
        self.compare, self.item = compare, item

    def __lt__(self, other: "CmpKey") -> bool:
        return self.compare(self.item, other.item) < 0

    def __gt__(self, other: "CmpKey") -> bool:
        return self.compare(self.item, other.item) > 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, CmpKey) and self.compare(self.item, other.item) == 0

    def __reduce__(self):
        from pyspark import cloudpickle

        return _cmp_key, (cloudpickle.dumps(self.compare), self.item)


def _cmp_key(compare: bytes, item: Any) -> CmpKey:
    from pyspark import cloudpickle

    return CmpKey(cloudpickle.loads(compare), item)


def sort_columns(df: DataFrame, column: str, order: str | Column | Callable[[Column], Column] | None) -> list[Column]:
    """Sort columns for natural, desc, java_hash, or a key made of the column."""
    c = F.col(column)
    if order is None or order == "natural":
        return [c.asc()]
    if order == "desc":
        return [c.desc()]
    if order == "java_hash":
        return [java_hash_column(c, df.schema[column].dataType.simpleString()).asc(), c.asc()]
    key = order(c) if callable(order) and not isinstance(order, Column) else order
    return [key if isinstance(key, Column) else F.col(key)]


def placed(df: DataFrame, name: str = "pos") -> DataFrame:
    """df with each row's place (from 1) in the order that df has, which may be that of a global sort.

    The rows are written to the shared folder with the number of their partition and their place in
    it, as both passes must see the same ones; only the partitions' sizes come to the driver.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "placed")
    tagged = df.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    tagged.write.parquet(path)
    rows = spark.read.schema(tagged.schema).parquet(path)
    before, starts = 0, {}
    for part, n in sorted(rows.groupBy("__part").count().collect()):
        starts[part] = before
        before += n
    start = F.lit(0).cast("bigint")
    if starts:
        start = F.element_at(F.array(*[F.lit(starts.get(k, 0)).cast("bigint") for k in range(max(starts) + 1)]), F.col("__part") + 1)
    return rows.withColumn(name, start + F.col("__row") + 1).drop("__part", "__row")


def numbered(df: DataFrame, *order: Column, name: str = "pos", partitions: int | None = None) -> DataFrame:
    """df with each row's place (from 1) in the order, without one task seeing all rows.

    Rows are dealt to ranges of the order, with all columns as tie breakers, and
    sorted there; a row's place is its place in the range plus the rows before.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [F.col(f.name) for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return placed(df.repartitionByRange(n, *order, *plain).sortWithinPartitions(*order, *plain), name)

"""Folds of runs: neighbouring rows of equal key in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.operators.order import numbered


def reduce_runs(df: DataFrame, key: Column, order: list[Column], **aggregates: Column) -> DataFrame:
    """One row per run: key, first_pos, last_pos and the aggregates.

    Rows get places in the order first (no task sees all rows); a run begins where the row one
    place before has another key. That neighbour comes from blocks of places that
    overlap by one row, so windows stay in blocks. A run that spans blocks is put together by
    the block-wise beginnings before it.
    """
    spark = df.sparkSession
    rows = numbered(df.withColumn("__key", key), *order, name="__pos")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.max("__pos")).first()[0] or 0
    size = max(1, -(-total // n))
    block = ((F.col("__pos") - 1) / size).cast("bigint")
    rows = rows.withColumn("__block", block)
    lagged = F.lag(F.struct("__key")).over(Window.partitionBy("__block").orderBy("__pos"))
    # of each block, what its last row was: one row per block
    tails = rows.groupBy("__block").agg(F.max_by(F.struct("__key"), "__pos").alias("tail")).select((F.col("__block") + 1).alias("__block"), "tail")
    rows = rows.withColumn("__before", lagged).join(F.broadcast(tails), "__block", "left")
    before = F.coalesce("__before", "tail")
    begins = before.isNull() | ~before.getField("__key").eqNullSafe(F.col("__key"))
    rows = rows.withColumn("__begins", F.when(begins, F.col("__pos")))
    local = F.max("__begins").over(Window.partitionBy("__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0))
    last = rows.groupBy("__block").agg(F.max("__begins").alias("b"))
    carried = last.select((F.col("__block") + 1).alias("__block"), F.max("b").over(Window.orderBy("__block")).alias("__carried"))
    rows = rows.withColumn("__run", local).join(F.broadcast(carried), "__block", "left").withColumn("__run", F.coalesce("__run", "__carried"))
    return rows.groupBy("__run").agg(F.any_value("__key").alias("key"), F.min("__pos").alias("first_pos"), F.max("__pos").alias("last_pos"), *[c.alias(k) for k, c in aggregates.items()]).drop("__run")

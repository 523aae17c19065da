"""Cached datasets by number, for as long as their session lives."""

from __future__ import annotations

import itertools

from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

_numbers = itertools.count(1)
_kept: dict[tuple[str, int], DataFrame | RDD] = {}
_by_plan: dict[tuple[str, int], tuple[DataFrame, int]] = {}


def _app(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def keep(df: DataFrame) -> int:
    """Runs df, keeps its rows in memory and on disk, and gives their number; the same frame keeps its number."""
    app = _app(df.sparkSession)
    known = _by_plan.get((app, id(df)))
    if known and known[0] is df and (app, known[1]) in _kept:
        return known[1]
    number = next(_numbers)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    _kept[app, number] = df
    _by_plan[app, id(df)] = (df, number)
    return number


def keep_objects(spark: SparkSession, rdd: RDD) -> int:
    """The same for opaque objects."""
    number = next(_numbers)
    rdd.persist(StorageLevel.MEMORY_AND_DISK)
    rdd.count()
    _kept[_app(spark), number] = rdd
    return number


def load(spark: SparkSession, number: int, *, missing_ok: bool = False, schema: str = "value string") -> DataFrame | RDD:
    """The rows (or objects) of a number. An unknown one is an error, or an empty frame if missing_ok."""
    df = _kept.get((_app(spark), number))
    if df is None:
        if not missing_ok:
            raise KeyError(f"nothing is cached as {number}")
        return spark.createDataFrame([], schema)
    return df


def drop(spark: SparkSession, number: int) -> None:
    df = _kept.pop((_app(spark), number), None)
    if df is not None:
        _by_plan.pop((_app(spark), id(df)), None)
        df.unpersist()

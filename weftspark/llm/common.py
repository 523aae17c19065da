"""Shared helpers: tables, the shared scratch folder, and word splitting on bytes."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftspark.session import scratch_path, scratch_root  # noqa: F401

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Cuts the lineage at a copy that outlives executors, so a lost executor
    costs its running tasks and never an earlier stage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialise, once nothing reads them any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            delete_path(t.sparkSession, path)


_CACHES: list[dict] = []


def cache() -> dict:
    """A dict of a Python worker's own, which outlives a task and goes when the worker turns to another operator."""
    _CACHES.append({})
    return _CACHES[-1]


def sole(mine: dict | None = None) -> None:
    """Empties all caches but one's own: workers are used again, and what operators keep must not add up."""
    if any([c and c is not mine for c in _CACHES]):
        for c in _CACHES:
            if c is not mine:
                c.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def single_thread() -> None:
    """Tokenizers' own threads would fight with Spark's task slots."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def slim(df: DataFrame, rows: int = 2000) -> DataFrame:
    """df, its session's Arrow batches set to so many rows at most: whole texts go through buffers on both sides."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that texts turn into Python objects a few at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)

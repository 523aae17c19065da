"""Sources: text lines, random numbers, object folders, cached datasets, delimited rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.dataset import Dataset, PyDataset
from weftspark.functions import rows as delimited_rows
from weftspark.functions.scalars import mixed_int
from weftspark.operators import cache


def from_frame(df: DataFrame) -> Dataset:
    return Dataset(df)


def lines(spark: SparkSession, path: str | list[str], *, ordered: bool = False) -> Dataset:
    """Text lines as column value. A folder or pattern stands for many files, read in parallel splits.

    ordered: adds pos, by which lines sort in file order (file, split, line).
    """
    df = spark.read.text(path)
    if ordered:
        df = df.select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("pos"))
    return Dataset(df)


def random_ints(spark: SparkSession, count: int, *, seed: int = 0, partitions: int | None = None) -> Dataset:
    """Exactly count signed 32-bit numbers; each depends on its id and the seed, not on partitions."""
    ids = spark.range(0, count, 1, partitions) if partitions else spark.range(count)
    return Dataset(ids.select(mixed_int(F.col("id"), seed).alias("value")))


def objects(spark: SparkSession, path: str) -> Dataset:
    """What save_objects wrote: rows with their schema."""
    return Dataset(spark.read.parquet(path))


def py_objects(spark: SparkSession, path: str) -> PyDataset:
    """What PyDataset.save_objects wrote: Python objects."""
    return PyDataset(spark, spark.sparkContext.pickleFile(path))


def cached(spark: SparkSession, number: int, *, missing_ok: bool = False) -> Dataset | PyDataset:
    """What cache() kept: rows, or Python objects."""
    found = cache.load(spark, number, missing_ok=missing_ok)
    return Dataset(found) if isinstance(found, DataFrame) else PyDataset(spark, found)


def delimited(spark: SparkSession, path: str, *, header: bool = False, sep: str = ",", kinds: list[str] | None = None, schema: T.StructType | None = None, lenient: bool = False) -> Dataset:
    """Delimited rows. Names come from the first line of the first file, or are col0, col1, ...

    With header, the line that a file begins with is left out if it is the header; equal lines further down are data.
    """
    text = spark.read.text(path)
    first = None
    if schema is None or header:
        head = text.first()
        if head is None:
            raise ValueError("no line to take the schema from")
        first = head["value"]
        schema = schema or delimited_rows.schema_from(first, header=header, sep=sep, kinds=kinds)
    if header:
        text = _without_first(spark.read.text(path), first)
    return Dataset(delimited_rows.parse(text, schema, sep=sep, lenient=lenient))


def _without_first(text: DataFrame, line: str) -> DataFrame:
    """Lines without those that equal `line` and stand first in their file. A task reads a file's lines in a row."""
    tagged = text.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            keep = [True] * len(at)
            for k in [k for k, x in enumerate(at) if x[1] == 0 and x != (at[k - 1] if k else before)]:
                keep[k] = batch.column(0)[k].as_py() != line
            before = at[-1]
            yield batch.select(["value"]).filter(pa.array(keep))

    return tagged.mapInArrow(run, "value string")

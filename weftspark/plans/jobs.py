"""The two demonstration jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.dataset import Dataset
from weftspark.operators.http import AsyncHttpClient
from weftspark.plans.echo import EchoProcess, EchoServer
from weftspark.sources.readers import random_ints

__all__ = ["EchoServer", "count_job", "echoed", "frequencies", "http_job", "most_popular"]

#: Fixed value: where the echoed digit stands in the answer of /get: {"args":{"value":"n"},...
DIGIT_AT = 18


def frequencies(values: DataFrame, column: str = "value") -> Dataset:
    """abs(x) % 100 of each value, and how often it occurs; 64-bit, so the smallest integer does no harm."""
    key = F.pmod(F.abs(F.col(column).cast("bigint")), F.lit(100))
    return Dataset(values).map({"key": key, "value": F.lit(1)}).reduce_by_key("count")


def most_popular(pairs: Dataset) -> DataFrame:
    """The pair of the largest value; of equal ones the largest key."""
    return pairs.df.agg(F.max(F.struct("value", "key")).alias("m")).select("m.key", F.col("m.value").alias("n"))


def count_job(spark: SparkSession, count: int, seed: int = 0) -> tuple[int, int]:
    row = most_popular(frequencies(random_ints(spark, count, seed=seed).df)).first()
    return (-1, -1) if row is None or row["key"] is None else (row["key"], row["n"])


async def echoed(client: AsyncHttpClient, digit: int, url: str | None = None) -> int:
    """The digit as url/get gives it back; without a url, a stub beside the task does, so that stubs are as many as tasks."""
    return ord((await client.get(f"{url or client.kept(EchoProcess).url}/get?value={digit}"))[DIGIT_AT]) - 48


def http_job(spark: SparkSession, values: Dataset, url: str | None = None, max_in_flight: int = 64, partitions: int | None = None) -> int:
    """Each value's last digit goes to url/get (or to stubs) and comes back; the sum of the digits modulo 10000."""

    async def digit(client: AsyncHttpClient, x: int) -> int:
        return await echoed(client, abs(x) % 10, url)

    return values.map_http(digit, "bigint", max_in_flight=max_in_flight, partitions=partitions).reduce("sum", 0) % 10000

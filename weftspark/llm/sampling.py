"""Bounded, repeatable training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % n


def below(most: int, n: int) -> int | None:
    """The signed 64-bit number under which most of n evenly spread hashes lie; None for all of them."""
    return None if n <= most else (most << 64) // n - (1 << 63)


def chosen(id_col: str, limit: int | None) -> Column:
    """Whether the id's hash lies under the limit; all 64 bits count, so a share of any size is met."""
    return F.lit(True) if limit is None else F.xxhash64(F.col(id_col), F.lit(0)) < F.lit(limit)


def bounded(rows: DataFrame, by: str, id_col: str, most: int) -> DataFrame:
    """About `most` rows of each value of `by` at most, chosen by a hash of the id.

    Counts first, on two columns; then one threshold for each value. Which rows
    are chosen does not depend on partitions or order. Rows that repeat an id go
    or stay together; callers take one of them, which keeps the bound.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    if not counts:
        return rows.limit(0)
    wanted = F.lit(False)
    for value, n in counts.items():
        wanted = F.when(F.col(by) == F.lit(value), chosen(id_col, below(most, n))).otherwise(wanted)
    return rows.filter(wanted)


def windows(text: str, id_col: str, n: int, width: int) -> Column:
    """n pieces of `width` characters, at places over the whole text that depend on the id."""
    length = F.length(text)
    at = [F.pmod(F.xxhash64(F.col(id_col), F.lit(100 + k)), F.greatest(length - width // 2, F.lit(1))) for k in range(n)]
    return F.array(*[F.substring(F.col(text), (p + 1).cast("int"), F.lit(width)) for p in at])

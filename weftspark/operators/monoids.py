"""Named merges that Catalyst knows as aggregates: partial sums on the map side, then one shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    return F.sum(v)


#: Name of a merge, and its aggregate of the values.
MONOIDS: dict[str, Callable[[Column], Column]] = {
    "sum": _sum,
    "min": F.min,
    "max": F.max,
    "count": lambda v: F.count(F.lit(1)),
    "avg": F.avg,
    "any": F.any_value,
    "and": F.bool_and,
    "or": F.bool_or,
}


def aggregate(merge: str, value: Column) -> Column:
    if merge not in MONOIDS:
        raise ValueError(f"unknown merge {merge!r}; known: {', '.join(MONOIDS)}")
    return MONOIDS[merge](value)

"""Python functions over Arrow batches: elements in, declared columns out, calls one by one or many at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

#: elements that a task holds as Python objects at a time
SLICE = 1024


def elements(names: list[str]) -> Callable[[tuple], Any]:
    """What functions see of a row: a single column's value, a pair, or a Row."""
    if len(names) == 1:
        return lambda x: x[0]
    if names == ["key", "value"]:
        return lambda x: (x[0], x[1])
    make = Row(*names)
    return lambda x: make(*x)


class Returns:
    """A declared result: a type (column value), or columns as DDL or a schema of them."""

    def __init__(self, returns: str | DataType):
        kind = _parse_datatype_string(returns) if isinstance(returns, str) else returns
        plain = isinstance(returns, str) and not returns.strip().lower().startswith("struct<")
        self.columns = isinstance(kind, StructType) and plain
        self.schema = kind if self.columns else StructType([StructField("value", kind)])
        self.arrow = to_arrow_schema(self.schema)

    def batch(self, out: list) -> pa.RecordBatch:
        """Rows may be tuples, Rows or dicts; a value that does not fit its type is an error."""
        if not self.columns:
            parts = [[_plain(x) for x in out]]
        elif len(self.schema) == 1 and out and not isinstance(out[0], (tuple, dict)):
            parts = [out]
        else:
            rows = [[x[n] for n in self.schema.names] if isinstance(x, dict) else x for x in out]
            parts = [[_plain(r[k]) for r in rows] for k in range(len(self.schema))]
        for x, f in zip(parts, self.arrow, strict=True):
            if pa.types.is_integer(f.type) and (odd := next((v for v in x if isinstance(v, float) and not v.is_integer()), None)) is not None:
                raise ValueError(f"{f.name}: {odd} is no integer")
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(parts, self.arrow, strict=True)], schema=self.arrow)


def _plain(value: Any) -> Any:
    return value.asDict(recursive=True) if isinstance(value, Row) else value


def called(batches: Iterator[pa.RecordBatch], function: Callable[[tuple], Any], in_flight: int = 1, run: Callable[[Callable, list, int], list] | None = None) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with the function's results for their rows, in order; run calls it in place of threads."""
    pool = ThreadPoolExecutor(in_flight) if in_flight > 1 and not run else None
    try:
        for batch in batches:
            size = max(SLICE, 4 * in_flight)
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                rows = list(zip(*(c.to_pylist(maps_as_pydicts="strict") for c in part.columns), strict=True))
                yield part, run(function, rows, in_flight) if run else list(pool.map(function, rows) if pool else map(function, rows))
    finally:
        if pool:
            pool.shutdown(cancel_futures=True)

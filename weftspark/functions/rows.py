"""Delimited rows with a declared schema: literal separators, no quoting, strict values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column kinds of a row schema, and their Spark types.
KINDS = {"STRING": T.StringType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}
_INT = r"^[+-]?[0-9]+$"
_DOUBLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?$|^[+-]?(NaN|Infinity)$"


def schema_from(first_line: str, *, header: bool, sep: str = ",", kinds: list[str] | None = None) -> T.StructType:
    """Names from the header line, or col0, col1, ...; kinds default to STRING. Names must differ."""
    tokens = first_line.split(sep)
    names = tokens if header else [f"col{k}" for k in range(len(tokens))]
    if kinds is not None and len(kinds) != len(names):
        raise ValueError(f"{len(names)} columns but {len(kinds)} kinds")
    if len(set(names)) != len(names):
        raise ValueError("column names repeat")
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in zip(names, kinds or ["STRING"] * len(names), strict=True)])


def index_of(schema: T.StructType, name: str) -> int | None:
    return schema.names.index(name) if name in schema.names else None


def _strict(text: Column, ok: Column, value: Column, what: str, lenient: bool) -> Column:
    bad = F.lit(None) if lenient else F.raise_error(F.concat(F.lit(f"not {what}: "), text))
    return F.when(text.isNull(), F.lit(None)).when(ok, value).otherwise(bad)


def _field(part: Column, kind: T.DataType, lenient: bool) -> Column:
    if isinstance(kind, T.IntegerType):
        wide = F.expr("0").cast("bigint") if part is None else part.try_cast("bigint")
        return _strict(part, part.rlike(_INT) & wide.between(-(1 << 31), (1 << 31) - 1), part.try_cast("int"), "an integer", lenient).cast("int")
    if isinstance(kind, T.DoubleType):
        trimmed = F.trim(part)
        return _strict(part, trimmed.rlike(_DOUBLE), F.regexp_replace(trimmed, "[fFdD]$", "").try_cast("double"), "a number", lenient).cast("double")
    if isinstance(kind, T.BooleanType):
        return F.lower(part) == "true"
    return part


def parse(lines: DataFrame, schema: T.StructType, *, sep: str = ",", column: str = "value", lenient: bool = False) -> DataFrame:
    """Rows of lines, every line being one. Fields past the schema are dropped; missing ones are errors, or null if lenient."""
    parts = F.split(F.col(column), f"\\Q{sep}\\E" if "\\E" not in sep else re.escape(sep), -1)
    out = []
    for k, f in enumerate(schema.fields):
        part = F.get(parts, F.lit(k))
        if not lenient:
            part = F.when(F.size(parts) > k, part).otherwise(F.raise_error(F.concat(F.lit(f"no field {f.name}: "), F.col(column))))
        out.append(_field(part, f.dataType, lenient).alias(f.name))
    return lines.select(*out)


def typed(df: DataFrame, name: str, kind: str) -> Column:
    """The column, if it has the kind; no conversion."""
    if name not in df.columns:
        raise KeyError(name)
    if df.schema[name].dataType != KINDS[kind]:
        raise TypeError(f"{name} is {df.schema[name].dataType.simpleString()}, not {kind}")
    return df[name]

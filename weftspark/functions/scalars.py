"""Column functions: pairs, 32-bit arithmetic, string hash order, deterministic random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair(key: Column, value: Column) -> list[Column]:
    """The two columns of a pair."""
    return [key.alias("key"), value.alias("value")]


def render(*columns: Column | str, sep: str = ",") -> Column:
    """Values joined by sep; a null value is an empty field, as fields keep their places."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in columns])


def wrap32(x: Column) -> Column:
    """x as a signed 32-bit number, wrapped round."""
    return (F.pmod(x.cast("bigint") + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def java_hash(text: Column) -> Column:
    """The JVM's string hash, h = 31 h + unit from left to right, the units being those of UTF-16."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.length(raw) / 4 - 1).cast("int")), lambda k: F.conv(F.substring(raw, (4 * k + 1).cast("int"), F.lit(4)), 16, 10).cast("bigint"))
    units = F.when(F.length(raw) > 0, units).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)), lambda h: F.when(h >= 1 << 31, h - F.lit(1 << 32)).otherwise(h).cast("int"))


def java_hash_of(value: object) -> int:
    """The JVM's hash of a Python value: strings by UTF-16 units, 32-bit and longer integers, booleans; None is 0."""
    if value is None:
        return 0
    if isinstance(value, bool):
        return 1231 if value else 1237
    if isinstance(value, int):
        if -(1 << 31) <= value < 1 << 31:
            return value if value >= 0 else ~value  # as of a 64-bit integer
        return _signed32((value ^ (value % (1 << 64) >> 32)) % (1 << 32))
    if isinstance(value, str):
        raw, h = value.encode("utf-16-le", "surrogatepass"), 0
        for k in range(0, len(raw), 2):
            h = (31 * h + raw[k] + 256 * raw[k + 1]) % (1 << 32)
        return _signed32(h)
    raise TypeError(f"no JVM hash of {type(value).__name__}")


def _signed32(x: int) -> int:
    return x - (1 << 32) if x >= 1 << 31 else x


def java_hash_column(c: Column, kind: str) -> Column:
    """The JVM's hash of a column of the named type; a null's is 0."""
    if kind == "string":
        out = java_hash(c)
    elif kind in ("int", "smallint", "tinyint"):
        out = c.cast("int")
    elif kind == "bigint":
        out = wrap32(c.bitwiseXOR(F.shiftrightunsigned(c, 32)).bitwiseAND(F.lit((1 << 32) - 1)))
    elif kind == "boolean":
        out = F.when(c, 1231).otherwise(1237)
    else:
        raise TypeError(f"no JVM hash of {kind}")
    return F.when(c.isNull(), F.lit(0)).otherwise(out)


def mixed_int(row_id: Column, seed: int) -> Column:
    """A signed 32-bit number that depends on the row's id and the seed alone, not on partitions.

    Two rounds of x ^= x >> 16, x *= odd on 32 bits, in arithmetic that never leaves 64.
    """
    low = lambda c: c.bitwiseAND(F.lit((1 << 32) - 1))
    i = row_id.cast("bigint")
    x = low(i).bitwiseXOR(low(F.shiftrightunsigned(i, 32) * F.lit(0x3C6EF372) + F.lit(seed % (1 << 31) * 0x45D9F3B)))
    for _ in range(2):
        x = low(x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(0x45D9F3B))
    x = x.bitwiseXOR(F.shiftright(x, 16))
    return wrap32(x)


def lcg(row_id: Column) -> Column:
    """One step of a linear congruential generator, in 0 .. 2^31 - 1; plain SQL arithmetic."""
    return ((row_id.cast("bigint") * 1103515245 + 12345) % 2147483648).cast("int")

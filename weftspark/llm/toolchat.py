"""Tool calls in chats: linked, ordered, validated, written as canonical JSON.

Calls and results are joined by (conversation, call id). A call comes after the
results it depends on, a result after its call; where arrival order breaks that,
events move to the latest arrival among what they wait for. That is worked out by
rounds of joins on call ids, so a conversation of any length is never in one
task. Validation and JSON look at single rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import materialise, small

EVENTS = "conv_id long, at long, kind string, role string, call_id string, name string, arguments string, content string, depends_on array<string>"
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


#: keywords that say nothing about validity
_SILENT = {"title", "description", "default", "examples", "deprecated", "format", "$schema", "$comment", "$id"}
_COUNTS = ("minItems", "maxItems", "minLength", "maxLength", "minProperties", "maxProperties")
_NUMBERS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")
_KNOWN = {"type", "enum", "const", "properties", "required", "additionalProperties", "items", "uniqueItems", "pattern", "anyOf", "oneOf", "allOf", "not", *_COUNTS, *_NUMBERS, *_SILENT}


def check_schema(schema: dict | bool, where: str = "$") -> None:
    """Raises ValueError for what violations() could not judge, so that no keyword counts as satisfied unseen."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{where}: a schema is an object, true or false")
    if odd := sorted(set(schema) - _KNOWN):
        raise ValueError(f"{where}: unsupported keyword {odd[0]}")
    kinds = schema.get("type", [])
    if odd := sorted({*([kinds] if isinstance(kinds, str) else kinds)} - {"integer", "number", *_TYPES}):
        raise ValueError(f"{where}: unknown type {odd[0]}")
    if "pattern" in schema:
        re.compile(schema["pattern"])
    for k, x in schema.get("properties", {}).items():
        check_schema(x, f"{where}.{k}")
    for key in ("items", "additionalProperties", "not"):
        if key in schema:
            check_schema(schema[key], f"{where}/{key}")
    for key in ("anyOf", "oneOf", "allOf"):
        for k, x in enumerate(schema.get(key, [])):
            check_schema(x, f"{where}/{key}[{k}]")


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def _same(a, b) -> bool:
    """Equal as JSON: true is not 1, but 1.0 is 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def violations(value, schema: dict | bool, where: str = "$") -> list[str]:
    """What breaks the JSON schema; schemas pass check_schema first."""
    if isinstance(schema, bool):
        return [] if schema else [f"{where}: not allowed"]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{where}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{where}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{where}: not the constant")
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{where}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{where}.{k}")
            elif others is False:
                out.append(f"{where}.{k}: unknown")
            else:
                out += violations(value[k], others, f"{where}.{k}")
        out += _bounds(len(value), schema, "minProperties", "maxProperties", where)
    elif isinstance(value, list):
        for k, x in enumerate(value if "items" in schema else []):
            out += violations(x, schema["items"], f"{where}[{k}]")
        out += _bounds(len(value), schema, "minItems", "maxItems", where)
        # equal values have equal canonical texts
        if schema.get("uniqueItems") and len({canonical(x) for x in value}) < len(value):
            out.append(f"{where}: repeated items")
    elif isinstance(value, str):
        out += _bounds(len(value), schema, "minLength", "maxLength", where)
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{where}: not of the pattern")
    elif _is(value, "number"):
        out += _bounds(value, schema, "minimum", "maximum", where)
        if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            out.append(f"{where}: under exclusiveMinimum")
        if "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            out.append(f"{where}: over exclusiveMaximum")
        if "multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
            out.append(f"{where}: not a multiple")
    for x in schema.get("allOf", []):
        out += violations(value, x, where)
    if "anyOf" in schema and all(violations(value, x, where) for x in schema["anyOf"]):
        out.append(f"{where}: none of anyOf")
    if "oneOf" in schema and sum(not violations(value, x, where) for x in schema["oneOf"]) != 1:
        out.append(f"{where}: not one of oneOf")
    if "not" in schema and not violations(value, schema["not"], where):
        out.append(f"{where}: what not rules out")
    return out


def _bounds(n, schema: dict, low: str, high: str, where: str) -> list[str]:
    out = []
    if low in schema and n < schema[low]:
        out.append(f"{where}: under {low}")
    if high in schema and n > schema[high]:
        out.append(f"{where}: over {high}")
    return out


def _plain(value):
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def canonical(value) -> str:
    """Keys sorted by code point, no blanks, text as it is, whole floats as integers."""
    return json.dumps(_plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _once(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (conv_id, call_id): the earliest arrival, ties by the other columns; copies counts all."""
    first = F.min(F.struct("at", *columns)).alias("x")
    return rows.groupBy("conv_id", "call_id").agg(first, F.count("*").alias("copies")).select("conv_id", "call_id", "x.*", "copies")


def _circles(waits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(conv_id, call_id) that never run out of calls to wait for, found by peeling off those that do."""
    dep = pairs.select("conv_id", F.col("call_id").alias("dep"))
    left = materialise(waits.join(dep, ["conv_id", "dep"], "left_semi").select("conv_id", "call_id", "dep"), "peel")
    before, now = None, left.count()
    while now and now != before:
        held = left.select("conv_id", F.col("call_id").alias("dep")).distinct()
        left = materialise(left.join(held, ["conv_id", "dep"], "left_semi").select("conv_id", "call_id", "dep"), "peel")
        before, now = now, left.count()
    return left.select("conv_id", "call_id").distinct()


def _last(state: DataFrame) -> DataFrame:
    return state.groupBy("conv_id", "call_id").agg(F.max("c").alias("c"), F.max("call_at").alias("call_at"), F.max("result_at").alias("result_at"))


def link(events: DataFrame, *, max_rounds: int = 100) -> DataFrame:
    """One row per call id of a conversation: its call, its result, both places in the order, the status.

    status: linked, unanswered (no result), orphan (no call), cycle (in or behind a
    circle of dependencies). A round looks only at calls that wait for one that
    moved in the round before. Circles are looked for once places still move after
    max_rounds rounds; all other calls move on until they are settled.
    """
    known = events.filter("call_id IS NOT NULL AND conv_id IS NOT NULL")
    calls = _once(known.filter("kind = 'call'"), ["name", "arguments", "role", "depends_on"]).withColumnsRenamed({"at": "call_at", "role": "call_role", "copies": "call_copies"})
    results = _once(known.filter("kind = 'result'"), ["content", "role"]).withColumnsRenamed({"at": "result_at", "role": "result_role", "copies": "result_copies"})
    pairs = materialise(calls.join(results, ["conv_id", "call_id"], "full"), "pairs")
    waits = pairs.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("dep")).filter("dep IS NOT NULL")
    start = pairs.select("conv_id", "call_id", F.struct(F.coalesce("call_at", "result_at").alias("turn"), F.lit(0).alias("step")).alias("c"), "call_at", "result_at")
    state, moved = start, start
    settled = waits.isEmpty()
    circle, k = None, 0
    while not settled:
        if k == max_rounds:
            circle = _circles(waits, pairs)
            waits = materialise(waits.join(circle, ["conv_id", "call_id"], "left_anti"), "waits")
        k += 1
        # only calls that wait for one that moved in the round before can move now
        after = F.struct(F.col("c.turn"), (F.col("c.step") + 1).alias("step"))
        # where a call's result stands; without one, where the call stands
        done = F.when(F.col("call_at").isNull() | F.col("result_at").isNull(), F.col("c")).otherwise(F.greatest(F.struct(F.col("result_at").alias("turn"), F.lit(0).alias("step")), after))
        ready = moved.select("conv_id", F.col("call_id").alias("dep"), done.alias("r"))
        need = waits.join(ready, ["conv_id", "dep"]).groupBy("conv_id", "call_id").agg(F.max(F.struct(F.col("r.turn"), (F.col("r.step") + 1).alias("step"))).alias("need"))
        # places only grow, so a call stands at the last of its places
        now = state.join(need, ["conv_id", "call_id"]).groupBy("conv_id", "call_id").agg(F.max("c").alias("c"), F.max("need").alias("need"), F.max("call_at").alias("call_at"), F.max("result_at").alias("result_at"))
        moved = materialise(now.filter("need > c").select("conv_id", "call_id", F.col("need").alias("c"), "call_at", "result_at"), "moved")
        settled = moved.isEmpty()
        state = state.unionByName(moved)
        if k % 16 == 0:
            state = materialise(_last(state), "order")
    place = _last(state).select("conv_id", "call_id", "c")
    if circle is None:
        place = place.withColumn("circle", F.lit(False))
    else:
        place = place.join(circle.withColumn("circle", F.lit(True)), ["conv_id", "call_id"], "left")
    own = F.struct(F.col("result_at").alias("turn"), F.lit(0).alias("step"))
    result = F.when(F.col("call_at").isNull(), own).otherwise(F.greatest(own, F.struct(F.col("c.turn"), (F.col("c.step") + 1).alias("step"))))
    status = F.when(F.col("circle"), "cycle").when(F.col("call_at").isNull(), "orphan").when(F.col("result_at").isNull(), "unanswered").otherwise("linked")
    return pairs.join(place, ["conv_id", "call_id"]).withColumn("r", F.when(F.col("result_at").isNotNull(), result)).withColumn("status", status).drop("circle")


def serialise(events: DataFrame, schemas: dict[str, dict], *, max_rounds: int = 100) -> DataFrame:
    """One row per message, call and result, with its place and its canonical JSON.

    Columns: conv_id, order_turn, order_step, at, kind, call_id, status, valid, errors,
    copies, json. Sorting a conversation by order_turn, order_step, at gives the
    topological order. Calls (and results) that repeat an id of their
    conversation are merged into the earliest; copies tells how many there were.
    Calls or results without id or conversation stay single rows with status
    no_id; plain messages have status message. A call is valid if its arguments
    are JSON and fit the schema of its name; unknown names and arguments that
    are null or no JSON (half a surrogate pair is none) are errors, and such arguments are written as text.
    Results are valid if linked. Null contents are JSON null. Texts of any length are
    read row by row. Columns besides the named ones are ignored; an empty table gives
    an empty result. A schema with a keyword that is not supported raises ValueError.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    events = events.select("conv_id", "at", "kind", "role", "call_id", "name", "arguments", "content", "depends_on")
    linked = link(events, max_rounds=max_rounds)
    none = F.lit(None).cast("string")
    calls = linked.filter("call_at IS NOT NULL").select("conv_id", F.col("c.turn").alias("order_turn"), F.col("c.step").alias("order_step"), F.col("call_at").alias("at"), F.lit("call").alias("kind"), "call_id", "status", F.col("call_copies").alias("copies"), F.col("call_role").alias("role"), "name", "arguments", none.alias("content"))
    results = linked.filter("result_at IS NOT NULL").select("conv_id", F.col("r.turn").alias("order_turn"), F.col("r.step").alias("order_step"), F.col("result_at").alias("at"), F.lit("result").alias("kind"), "call_id", "status", F.col("result_copies").alias("copies"), F.col("result_role").alias("role"), "name", none.alias("arguments"), "content")
    bare = F.col("kind").isNull() | ~F.col("kind").isin("call", "result")
    rest = events.filter(bare | F.col("call_id").isNull() | F.col("conv_id").isNull())
    status = F.when(F.coalesce(F.col("kind"), F.lit("")).isin("call", "result"), "no_id").otherwise("message")
    others = rest.select("conv_id", F.col("at").alias("order_turn"), F.lit(0).alias("order_step"), "at", "kind", "call_id", status.alias("status"), F.lit(1).cast("long").alias("copies"), "role", "name", "arguments", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            got = [_written(r, schemas) for r in batch.to_pylist()]
            keep = [c for c in batch.schema.names if c not in ("role", "name", "arguments", "content")]
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array([g[2] for g in got], pa.string())], names=[*keep, "valid", "errors", "json"])

    out = calls.unionByName(results).unionByName(others)
    return out.mapInArrow(run, "conv_id long, order_turn long, order_step int, at long, kind string, call_id string, status string, copies long, valid boolean, errors array<string>, json string")


def _strict(constant: str):
    raise ValueError(f"{constant} is no JSON")


def _written(row: dict, schemas: dict[str, dict]) -> tuple[bool, list[str], str]:
    if row["kind"] == "call":
        errors, value = [], row["arguments"]
        try:
            value = json.loads(row["arguments"], parse_constant=_strict) if row["arguments"] is not None else None
            canonical(value).encode()  # halves of surrogate pairs are no text
            if row["arguments"] is None:
                errors.append("$: no arguments")
            elif row["name"] not in schemas:
                errors.append("name: unknown")
            else:
                errors = violations(value, schemas[row["name"]])
        except (ValueError, RecursionError):
            errors, value = ["$: not JSON"], row["arguments"]
        ok = not errors and row["status"] in ("linked", "unanswered")
        return ok, errors, canonical({"type": "call", "role": row["role"], "id": row["call_id"], "name": row["name"], "arguments": value})
    if row["kind"] == "result":
        return row["status"] == "linked", [], canonical({"type": "result", "role": row["role"], "id": row["call_id"], "name": row["name"], "content": row["content"]})
    return True, [], canonical({"type": "message", "role": row["role"], "content": row["content"]})

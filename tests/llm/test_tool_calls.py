import json
import random

import pytest

from weftspark.llm import toolchat

TOOLS = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "number", "minimum": 0}}, "required": ["a"], "additionalProperties": False}}


def event(conv, at, kind, call_id=None, args=None, content=None, deps=None, name="add", role="assistant"):
    return (conv, at, kind, role, call_id, name if kind == "call" else None, args, content, deps, "extra")


def frame(spark, rows):
    return spark.createDataFrame(rows, toolchat.EVENTS + ", status string").repartition(3)


def by_key(df):
    return {(r["conv_id"], r["kind"], r["call_id"]): r for r in df.collect()}


def test_links_and_statuses(spark):
    rows = [
        event(1, 0, "message", content="hi", role="user"),
        event(1, 1, "call", "x", '{"b":2.0,"a":1}'),
        event(1, 2, "result", "x", content="3"),
        event(1, 3, "call", "y", '{"a":"no"}'),
        event(1, 4, "result", "z", content=None),
        event(1, 5, "call", "w", "{broken"),
        event(1, 6, "call", "w", '{"a":2}'),
        event(1, 7, "call", None, '{"a":2}'),
        event(None, 8, "result", "q", content="?"),
        event(1, 9, None, content=None),
        event(1, 10, "call", "u", '{"a":1}', name="unknown"),
        event(1, 11, "call", "n", None),
        event(1, 12, "call", "inf", '{"a":1,"b":Infinity}'),
    ]
    got = by_key(toolchat.serialise(frame(spark, rows), TOOLS))
    assert got[1, "call", "x"]["json"] == '{"arguments":{"a":1,"b":2},"id":"x","name":"add","role":"assistant","type":"call"}'
    assert got[1, "call", "x"]["valid"] and got[1, "result", "x"]["valid"]
    assert (got[1, "call", "y"]["status"], got[1, "call", "y"]["errors"]) == ("unanswered", ["$.a: not integer"])
    assert got[1, "result", "z"]["status"] == "orphan" and not got[1, "result", "z"]["valid"]
    assert (got[1, "call", "w"]["copies"], got[1, "call", "w"]["errors"], json.loads(got[1, "call", "w"]["json"])["arguments"]) == (2, ["$: not JSON"], "{broken")
    assert got[1, "call", None]["status"] == got[None, "result", "q"]["status"] == "no_id"
    assert got[1, None, None]["status"] == "message"
    assert got[1, "call", "u"]["errors"] == ["name: unknown"] and got[1, "call", "n"]["errors"] == ["$: no arguments"] and got[1, "call", "inf"]["errors"] == ["$: not JSON"]


@pytest.mark.parametrize("seed", range(4))
def test_order_is_topological(spark, seed):
    rng = random.Random(seed)
    rows, deps = [], {}
    for conv in range(6):
        n = rng.randint(1, 8)
        at = list(range(2 * n))
        rng.shuffle(at)
        for k in range(n):
            deps[conv, f"c{k}"] = [f"c{j}" for j in range(k) if rng.random() < 0.3]
            rows.append(event(conv, at[2 * k], "call", f"c{k}", '{"a":1}', deps=[*deps[conv, f"c{k}"], None]))
            if rng.random() < 0.8:
                rows.append(event(conv, at[2 * k + 1], "result", f"c{k}", content="ok"))
    got = by_key(toolchat.serialise(frame(spark, rows), TOOLS))
    place = {k: (r["order_turn"], r["order_step"]) for k, r in got.items()}
    assert len(got) == len(rows)
    for (conv, kind, call), p in place.items():
        assert got[conv, kind, call]["status"] in ("linked", "unanswered")
        if kind == "result":
            assert p > place[conv, "call", call]
        else:
            for d in deps[conv, call]:
                assert p > place.get((conv, "result", d), place[conv, "call", d])


def test_natural_order_stays(spark):
    rows = [e for k in range(20) for e in (event(1, 2 * k, "call", f"c{k}", '{"a":1}', deps=[f"c{k - 1}"]), event(1, 2 * k + 1, "result", f"c{k}", content="x"))]
    got = toolchat.serialise(frame(spark, rows), TOOLS).collect()
    assert all((r["order_turn"], r["order_step"]) == (r["at"], 0) for r in got)


def test_circles_are_marked(spark):
    rows = [event(1, 0, "call", "a", "{}", deps=["b"]), event(1, 1, "call", "b", "{}", deps=["a"]), event(1, 2, "call", "c", '{"a":1}')]
    got = by_key(toolchat.serialise(frame(spark, rows), TOOLS, max_rounds=8))
    assert {k[2]: r["status"] for k, r in got.items()} == {"a": "cycle", "b": "cycle", "c": "unanswered"}
    assert not got[1, "call", "a"]["valid"]


def test_chains_longer_than_the_rounds_are_no_circles(spark):
    """c0 waits for c1, c1 for c2 and so on, against arrival; a and b wait for each other, z for a."""
    rows = [event(1, k, "call", f"c{k}", '{"a":1}', deps=[f"c{k + 1}"] if k < 6 else None) for k in range(7)]
    rows += [event(1, 10, "call", "a", "{}", deps=["b"]), event(1, 11, "call", "b", "{}", deps=["a"]), event(1, 12, "call", "z", "{}", deps=["a"])]
    got = {r["call_id"]: r for r in toolchat.link(frame(spark, rows), max_rounds=3).collect()}
    assert {c for c in got if got[c]["status"] == "cycle"} == {"a", "b", "z"}
    places = [got[f"c{k}"]["c"] for k in range(7)]
    assert places == sorted(places, reverse=True) and len(set(places)) == 7


def test_schemas_and_canonical_json():
    schema = {"type": "object", "properties": {"l": {"type": "array", "items": {"type": "string", "maxLength": 2}, "minItems": 1}, "e": {"enum": [1, "x", None]}, "t": {"type": ["integer", "null"]}}, "additionalProperties": {"type": "boolean"}}
    assert toolchat.violations({"l": ["ab"], "e": "x", "t": None, "z": True}, schema) == []
    assert toolchat.violations({"l": [], "e": True, "t": 1.5, "z": 0}, schema) == ["$.e: not in enum", "$.l: under minItems", "$.t: not integer or null", "$.z: not boolean"]
    assert toolchat.violations({"l": ["abc", 1]}, schema) == ["$.l[0]: over maxLength", "$.l[1]: not string"]
    assert toolchat.violations([], schema) == ["$: not object"]
    assert toolchat.canonical({"b": 1.0, "a": [1.5, "é\n", None, True], "c": 1e20}) == '{"a":[1.5,"é\\n",null,true],"b":1,"c":1e+20}'


def test_nothing_and_long_text(spark):
    assert toolchat.serialise(frame(spark, []), TOOLS).collect() == []
    long = "x" * 300_000
    got = toolchat.serialise(frame(spark, [event(1, 0, "message", content=long)] * 3), TOOLS).collect()
    assert len(got) == 3 and all(long in r["json"] for r in got)


def test_every_keyword_counts_or_is_refused(spark):
    ok, bad = lambda v, s: toolchat.violations(v, s) == [], lambda v, s: toolchat.violations(v, s) != []
    assert ok("ab1", {"pattern": r"\d$"}) and bad("ab", {"pattern": r"\d$"})
    assert ok(1.0, {"const": 1}) and bad(True, {"const": 1}) and bad([True], {"enum": [[1]]})
    assert ok(3, {"anyOf": [{"type": "string"}, {"minimum": 2}]}) and bad(1, {"anyOf": [{"type": "string"}, {"minimum": 2}]})
    assert ok(3, {"oneOf": [{"minimum": 2}, {"minimum": 5}]}) and bad(6, {"oneOf": [{"minimum": 2}, {"minimum": 5}]})
    assert bad(3, {"not": {"type": "integer"}}) and bad(3, {"allOf": [{"maximum": 2}]}) and bad({"x": 1}, {"additionalProperties": {"type": "string"}})
    assert ok(0.3, {"multipleOf": 0.1}) and bad(0.25, {"multipleOf": 0.1}) and bad(2, {"exclusiveMinimum": 2}) and bad(2, {"exclusiveMaximum": 2})
    assert bad([1, 1.0], {"uniqueItems": True}) and ok([1, "1"], {"uniqueItems": True}) and bad({}, {"minProperties": 1}) and bad([1], {"items": False})
    for schema in ({"type": "number", "$ref": "#/x"}, {"type": "text"}, {"properties": {"a": {"type": ["int"]}}}, {"items": {"if": {}}}):
        with pytest.raises(ValueError):
            toolchat.serialise(frame(spark, []), {"add": schema})


def test_half_surrogate_pairs_are_no_text(spark):
    got = by_key(toolchat.serialise(frame(spark, [event(1, 0, "call", "a", '{"a":"\\ud800"}'), event(1, 1, "call", "b", '{"a":1,"\\udc00":2}'), event(1, 2, "call", "c", '{"a":"\\ud83d\\ude42"}')]), TOOLS))
    assert got[1, "call", "a"]["errors"] == got[1, "call", "b"]["errors"] == ["$: not JSON"]
    assert json.loads(got[1, "call", "a"]["json"])["arguments"] == '{"a":"\\ud800"}'
    assert "🙂" in got[1, "call", "c"]["json"] and got[1, "call", "c"]["errors"] == ["$.a: not integer"]


def test_long_chains_against_arrival(spark):
    """A place that moves often keeps its last value, past the point where places are put together."""
    rows = [event(1, k, "call", f"c{k}", '{"a":1}', deps=[f"c{k + 1}"] if k < 19 else None) for k in range(20)]
    got = {r["call_id"]: r["c"] for r in toolchat.link(frame(spark, rows)).collect()}
    places = [got[f"c{k}"] for k in range(20)]
    assert places == sorted(places, reverse=True) and len(set(places)) == 20 and places[19] == (19, 0)

"""Long tables of calls against loops over each item's calls."""

import json
import random

import pytest

from verdictframe.operators import trajectory

SPEC = {
    "required_first": ["a"],
    "must_include": ["b"],
    "max_calls": {"a": 9, "c": 30},
    "required_sequence": ["a", "b", "a", "c", "b"],
    "arg_schema": {"tool": "a", "schema": {"type": "object", "properties": {"text": {"type": "string", "minLength": 2}}}},
    "bindings": [{"tool": "b", "tool_path": "$.x.y", "output_path": "$.p"}, {"tool": "c", "tool_path": "$.z", "output_path": "$.q.r"}],
}
CALLS = "item_id string, seq bigint, name string, payload string, result string"


def looked_up(value, path):
    for part in path[2:].split("."):
        if not isinstance(value, dict) or part not in value:
            return None
        value = value[part]
    return json.dumps(value)


def parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def loop_code(calls, output):
    calls = sorted(calls)
    names = [c[1] for c in calls]
    if names[0] not in SPEC["required_first"]:
        return "TOOL_SEQUENCE_MISSING", "required_first"
    if any(t not in names for t in SPEC["must_include"]):
        return "TOOL_SEQUENCE_MISSING", "must_include"
    if any(names.count(t) > n for t, n in SPEC["max_calls"].items()):
        return "TOOL_MAX_CALLS_EXCEEDED", "max_calls"
    rest = iter(names)
    if not all(t in rest for t in SPEC["required_sequence"]):
        return "TOOL_SEQUENCE_MISSING", "sequence"
    first = {}
    for _, name, payload, result in calls:
        first.setdefault(name, (payload, result))
    if len(first["a"][0]) < 2:
        return "TOOL_ARGS_SCHEMA_FAILED", "args"
    out = parsed(output)
    if out is None:
        return "TOOL_BINDING_MISSING_OUTPUT", "binding_output"
    for b in SPEC["bindings"]:
        if b["tool"] not in first:
            return "TOOL_BINDING_MISSING_TOOL", "binding_missing"
        if looked_up(parsed(first[b["tool"]][1]), b["tool_path"]) != looked_up(out, b["output_path"]):
            return "TOOL_BINDING_MISMATCH", "binding"
    return "", ""


def made(seed, items=120):
    draw = random.Random(seed)
    calls, outputs = {}, {}
    for k in range(items):
        n = draw.choice([5, 8, 12, 20, 40])
        names = draw.choices("abcd", weights=[3, 3, 2, 1], k=n)
        if k % 3:
            names[:5] = SPEC["required_sequence"]
        seqs = sorted(draw.sample(range(10 * n), n))
        result = lambda name: {"b": '{"x":{"y":%d}}', "c": '{"z":"v%d"}'}.get(name, "{}")
        rows = [(s, name, draw.choice(["t", "text", "other"]) if k % 5 == 0 else "text", result(name) % draw.randrange(2) if name in "bc" else "{}") for s, name in zip(seqs, names, strict=True)]
        calls[f"i{k}"] = rows
        outputs[f"i{k}"] = draw.choice(['{"p":1,"q":{"r":"v1"}}', '{"p":0,"q":{"r":"v0"}}', '{"p":1,"q":{"r":"v0"}}', '{"p":0}', "no JSON", None])
    return calls, outputs


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_long_traces_equal_loops(spark, monkeypatch, block):
    """Also where an item's calls are cut into many blocks."""
    monkeypatch.setattr(trajectory, "CALLS", block)
    calls, outputs = made(block)
    rows = [(i, *r) for i, own in calls.items() for r in own]
    random.Random(1).shuffle(rows)
    got = trajectory.long_trace_codes(
        spark.createDataFrame(rows, CALLS).repartition(3), SPEC, spark.createDataFrame(list(outputs.items()), "item_id string, output string")
    ).collect()
    want = {i: loop_code(own, outputs[i]) for i, own in calls.items()}
    assert {r["item_id"]: (r["code"], r["step"]) for r in got} == want
    assert {s for _, s in want.values()} >= {"", "required_first", "sequence", "max_calls", "args", "binding_output", "binding"}
    assert all(bool(r["message"]) == bool(r["code"]) for r in got)


def test_scans_do_not_follow_the_length_of_the_sequence(spark):
    calls = spark.createDataFrame([("x", 1, "a", "text", "{}")], CALLS)
    outputs = spark.createDataFrame([("x", "{}")], "item_id string, output string")

    def operators(length):
        plan = trajectory.long_trace_codes(calls, SPEC | {"required_sequence": ["a", "b"] * length}, outputs)._jdf.queryExecution().sparkPlan().toString()
        return [plan.count(x) for x in ("Scan", "Join", "Aggregate")]

    assert operators(1) == operators(20)


def test_items_without_an_output_and_tools_without_a_result(spark):
    calls = [("x", 1, "a", "text", None), ("x", 2, "b", "text", None), ("x", 3, "a", "t", None), ("x", 4, "c", "t", None), ("x", 5, "b", "t", None)]
    found = trajectory.long_trace_codes(spark.createDataFrame(calls, CALLS), SPEC, spark.createDataFrame([("y", "{}")], "item_id string, output string"))
    assert [(r["item_id"], r["code"]) for r in found.collect()] == [("x", "TOOL_BINDING_MISSING_OUTPUT")]

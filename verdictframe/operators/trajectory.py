"""Tool-use checks on traces, for the trace array of a response and for a long table of calls."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.schema import violations, violations_by_schema
from verdictframe.functions.text import col
from verdictframe.operators.scoring import outcome

STEPS = ("type", "required_first", "must_include", "max_calls", "sequence", "args", "binding")


def json_path(v: Column | str, path: Column) -> Column:
    """Value at ``$.a.b`` walking objects only, as JSON text; null for any other path or a missing key."""
    value = F.aggregate(
        F.split(F.substr(path, F.lit(3)), r"\."),
        col(v),
        lambda at, part: F.try_element_at(F.try_variant_get(at, "$", "map<string,variant>"), part),
    )
    return F.when(path.startswith("$."), F.to_json(value))


def _subsequence(names: Column, wanted: Column) -> Column:
    """Greedy: how far ``wanted`` is matched, in order, inside ``names``."""
    reached = F.aggregate(
        names, F.lit(0), lambda i, n: F.when(F.get(wanted, i).eqNullSafe(n) & (i < F.size(wanted)), i + 1).otherwise(i)
    )
    return reached >= F.size(wanted)


def trace_codes(df: DataFrame, expected: str, trace: str, parsed: str) -> DataFrame:
    """Add ``trajectory``, outcome of the first failing step, and ``trajectory_details``, what was expected and
    observed there (JSON texts). ``expected`` and ``parsed`` are VARIANT and
    ``trace`` is ARRAY<STRUCT<name STRING, args VARIANT, result VARIANT>> (null when it is no list)."""
    spec = F.col(expected)

    def part(path: str, kind: str) -> Column:
        return F.try_variant_get(spec, path, kind)

    calls = F.col(trace)
    # each step is a column of its own that the next ones name, so that nothing is worked out, or planned, more than once
    read = df.withColumns({
        "_names": F.transform(calls, lambda t: t["name"]),
        "_first": part("$.required_first", "array<string>"),
        "_must": part("$.must_include", "array<string>"),
        "_limits": F.map_entries(part("$.max_calls", "map<string,int>")),
        "_wanted": part("$.required_sequence", "array<string>"),
        "_bindings": part("$.bindings", "array<struct<tool string,tool_path string,output_path string>>"),
        "_arg_tool": part("$.arg_schema.tool", "string"),
        "_arg_schema": F.to_json(part("$.arg_schema.schema", "variant")),
    })
    names, first, must, limits, wanted, bindings, arg_tool = (F.col(f"_{n}") for n in ("names", "first", "must", "limits", "wanted", "bindings", "arg_tool"))

    def calls_of(name: Column) -> Column:
        return F.filter(calls, lambda t: t["name"] == name)

    def unbound(b: Column) -> Column:
        result = F.get(calls_of(b["tool"]), 0)["result"]
        return ~json_path(result, b["tool_path"]).eqNullSafe(json_path(parsed, b["output_path"]))

    found = read.withColumns({
        "_args": F.coalesce(F.get(calls_of(arg_tool), 0)["args"], F.parse_json(F.lit("{}"))),
        "_arg_calls": F.size(calls_of(arg_tool)),
        "_absent": F.array_except(must, names),
        "_over": F.filter(limits, lambda e: F.size(calls_of(e["key"])) > e["value"]),
        "_broken": F.filter(bindings, lambda b: (F.size(calls_of(b["tool"])) == 0) | unbound(b)),
    })
    checked = found.withColumn("_bad_args", violations_by_schema("_arg_schema", F.col("_args")))
    args, arg_calls, bad_args, broken = F.col("_args"), F.col("_arg_calls"), F.col("_bad_args"), F.col("_broken")
    absent, over, loose = F.get("_absent", 0), F.get("_over", 0), F.get(broken, 0)

    def some(c: Column) -> Column:
        return F.coalesce(F.size(c) > 0, F.lit(False))

    tests = [
        (calls.isNull(), "TOOL_TRACE_NOT_LIST", "type"),
        (some(first) & ~F.coalesce(F.array_contains(first, F.get(names, 0)), F.lit(False)), "TOOL_SEQUENCE_MISSING", "required_first"),
        (some(F.col("_absent")), "TOOL_SEQUENCE_MISSING", "must_include"),
        (some(F.col("_over")), "TOOL_MAX_CALLS_EXCEEDED", "max_calls"),
        (some(wanted) & ~_subsequence(names, wanted), "TOOL_SEQUENCE_MISSING", "sequence"),
        (arg_tool.isNotNull() & (arg_calls == 0), "TOOL_SEQUENCE_MISSING", "args"),
        (arg_tool.isNotNull() & some(bad_args), "TOOL_ARGS_SCHEMA_FAILED", "args"),
        (some(bindings) & F.col(parsed).isNull(), "TOOL_BINDING_MISSING_OUTPUT", "binding"),
        # the first broken binding decides between the two codes
        (some(broken) & (F.size(calls_of(loose["tool"])) == 0), "TOOL_BINDING_MISSING_TOOL", "binding"),
        (some(broken), "TOOL_BINDING_MISMATCH", "binding"),
    ]
    failing = F.coalesce(*[F.when(test, F.lit(i)) for i, (test, _, _) in enumerate(tests)])
    decided = checked.withColumn("_failing", failing).withColumns({
        "_code": F.coalesce(F.get(F.array(*[F.lit(c) for _, c, _ in tests]), F.col("_failing")), F.lit("")),
        "_step": F.coalesce(F.get(F.array(*[F.lit(s) for _, _, s in tests]), F.col("_failing")), F.lit("")),
    })
    code, step = F.col("_code"), F.col("_step")

    def shown(**parts: Column) -> Column:
        return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))

    bound_value = F.try_parse_json(json_path(F.get(calls_of(loose["tool"]), 0)["result"], loose["tool_path"]))
    given_value = F.try_parse_json(json_path(parsed, loose["output_path"]))
    at_binding = (step == "binding") & (code != "TOOL_BINDING_MISSING_OUTPUT")
    details = F.struct(
        F.when(step == "", None).when(step == "binding", "grounding").when(step == "args", "schema").otherwise("tool_use").alias("dimension"),
        F.when(step == "must_include", absent).when(step == "max_calls", over["key"]).when(step == "args", arg_tool)
        .when(at_binding, loose["tool"]).alias("tool_name"),
        F.when(step == "required_first", shown(required_first=first)).when(step == "must_include", shown(must_include=absent))
        .when(step == "max_calls", shown(max_calls=over["value"])).when(step == "sequence", shown(required_sequence=wanted))
        .when(code == "TOOL_ARGS_SCHEMA_FAILED", shown(schema=part("$.arg_schema.schema", "variant")))
        .when(step == "args", shown(tool=arg_tool))
        .when(code == "TOOL_BINDING_MISMATCH", shown(output_path=loose["output_path"], value=bound_value)).alias("expected"),
        F.when((step == "required_first") & (F.size(names) == 0), shown(names=names))
        .when(step == "required_first", shown(first_tool=F.get(names, 0)))
        .when(step == "must_include", shown(count=F.lit(0))).when(step == "max_calls", shown(count=F.size(calls_of(over["key"]))))
        .when(step == "sequence", shown(names=names))
        .when(code == "TOOL_ARGS_SCHEMA_FAILED", shown(args=args, validation_errors=bad_args))
        .when(code == "TOOL_BINDING_MISMATCH", shown(value=given_value)).alias("observed"),
        F.when(at_binding, shown(tool_path=loose["tool_path"], output_path=loose["output_path"])).alias("locator"),
    )
    message = F.when(step == "", "trajectory_check passed").otherwise(
        F.concat(F.lit("trajectory_check failed ("), step, F.lit(")"))
    )
    scored = decided.withColumns({"trajectory": outcome(code == "", code, message, step), "trajectory_details": details})
    return scored.select(*df.columns, "trajectory", "trajectory_details")


#: Calls of an item whose order is worked out together, by their sequence numbers.
CALLS = 1 << 16


def matched(calls: Column, wanted: Sequence[str]) -> Column:
    """For a sorted array of calls (``name``), how far a search for ``wanted`` in order gets from each place where it may begin.

    Such an array of ends is a function on places, so those of blocks that follow each other are put together by
    looking one up in the other.
    """
    tools = F.array(*map(F.lit, wanted))
    go = lambda start: F.aggregate(calls, start, lambda at, call: F.when(F.get(tools, at) == call["name"], at + 1).otherwise(at))
    return F.transform(F.sequence(F.lit(0), F.lit(len(wanted))), go)


def long_trace_codes(
    calls: DataFrame,
    spec: Mapping[str, Any],
    outputs: DataFrame,
    item: str = "item_id",
    seq: str = "seq",
    name: str = "name",
    payload: str = "payload",
    result: str = "result",
    output: str = "output",
) -> DataFrame:
    """One row per item of a long table of calls: a flag per step, the code and step of the first failing one, its message.

    ``calls`` hold the text that a tool was called with (``payload``) and what it gave (``result``, JSON text); sequence numbers are
    unique integers of an item. ``outputs`` hold the items' outputs (JSON text). ``bindings`` of ``spec`` say which value of a tool's first
    result has to be which value of the output.

    Calls are combined in blocks of bounded length, then the blocks of an item: counts add up, first calls stay, and each
    block maps every place in the required sequence to the place it gets to. So the table is read once however long
    the sequence, and an item with very many calls is many tasks.
    """
    n, s = F.col(name), F.col(seq)
    arg_tool, wanted, bindings = spec["arg_schema"]["tool"], spec["required_sequence"], spec["bindings"]
    bound = sorted({b["tool"] for b in bindings})
    counted = {f"has_{i}": t for i, t in enumerate(spec["must_include"])} | {f"used_{i}": t for i, t in enumerate(spec["max_calls"])} | {"arg_calls": arg_tool}
    first_of = lambda tool, value: F.min(F.when(n == tool, F.struct(s.alias("seq"), F.col(value).alias("value"))))
    steps = F.sort_array(F.collect_list(F.when(n.isin(*wanted), F.struct(s.alias("seq"), n.alias("name")))))
    block = F.floor(s / CALLS).alias("_block")
    part = calls.groupBy(item, block).agg(
        F.count("*").alias("n_calls"),
        F.min(F.struct(s.alias("seq"), n.alias("value"))).alias("first_tool"),
        *[F.count_if(n == t).alias(k) for k, t in counted.items()],
        first_of(arg_tool, payload).alias("arg_first"),
        *[first_of(t, result).alias(f"bound_{i}") for i, t in enumerate(bound)],
        steps.alias("_steps"),
    )
    part = part.withColumn("_ends", matched(F.col("_steps"), wanted)).drop("_steps")
    follow = F.aggregate(F.sort_array(F.collect_list(F.struct("_block", "_ends"))), F.lit(0), lambda at, b: F.get(b["_ends"], at))
    state = part.groupBy(item).agg(
        *[F.sum(c).alias(c) for c in ("n_calls", *counted)],
        *[F.min(c)["value"].alias(c) for c in ("first_tool", "arg_first", *(f"bound_{i}" for i in range(len(bound))))],
        follow.alias("reached"),
    )
    state = state.join(outputs.select(item, F.try_parse_json(output).alias("_output")), item, "left")

    results = F.create_map(*[x for i, t in enumerate(bound) for x in (F.lit(t), F.try_parse_json(f"bound_{i}"))]) if bound else None
    there = F.create_map(*[x for i, t in enumerate(bound) for x in (F.lit(t), F.col(f"bound_{i}").isNotNull())]) if bound else None
    pairs = F.array(*[F.struct(*[F.lit(b[k]).alias(k) for k in ("tool", "tool_path", "output_path")]) for b in bindings])
    differs = lambda b: ~json_path(results[b["tool"]], b["tool_path"]).eqNullSafe(json_path("_output", b["output_path"]))
    broken = F.get(F.filter(pairs, lambda b: ~there[b["tool"]] | differs(b)), 0) if bound else F.lit(None)
    bad = F.lit(bool(bound)) & F.col("_output").isNotNull() & broken.isNotNull() if bound else F.lit(False)
    missing = ~there[broken["tool"]] if bound else F.lit(False)

    state = state.withColumn("_args", F.to_variant_object(F.struct(F.col("arg_first").alias("text"))))
    text = lambda *parts: F.concat(*[F.coalesce(p, F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    said = lambda value: json.dumps(value)
    lacking = F.get(F.filter(F.array(*[F.when(F.col(f"has_{i}") == 0, F.lit(t)) for i, t in enumerate(spec["must_include"])]), lambda t: t.isNotNull()), 0)
    over = F.get(F.filter(F.array(*[F.when(F.col(f"used_{i}") > m, F.lit(f"{t}: at most {m}")) for i, (t, m) in enumerate(spec["max_calls"].items())]), lambda t: t.isNotNull()), 0)
    checks = {
        "required_first": (~F.col("first_tool").isin(*spec["required_first"]), "TOOL_SEQUENCE_MISSING", text(f"first call must be one of {said(spec['required_first'])}, was ", F.col("first_tool"))),
        "must_include": (lacking.isNotNull(), "TOOL_SEQUENCE_MISSING", text("never called: ", lacking)),
        "max_calls": (over.isNotNull(), "TOOL_MAX_CALLS_EXCEEDED", text("called too often: ", over)),
        "sequence": (F.col("reached") < len(wanted), "TOOL_SEQUENCE_MISSING", text(f"of the sequence {said(wanted)} only the first ", F.col("reached").cast("string"), " came in order")),
        "args_missing": (F.col("arg_calls") == 0, "TOOL_SEQUENCE_MISSING", text(f"never called: {arg_tool}")),
        "args": ((F.col("arg_calls") > 0) & (F.size(violations(spec["arg_schema"]["schema"], F.col("_args"))) > 0), "TOOL_ARGS_SCHEMA_FAILED", text(f"arguments of {arg_tool} break their schema")),
        "binding_output": (F.lit(bool(bound)) & F.col("_output").isNull(), "TOOL_BINDING_MISSING_OUTPUT", text("the output is no JSON")),
        "binding_missing": (bad & missing, "TOOL_BINDING_MISSING_TOOL", text("never called: ", broken["tool"]) if bound else text("")),
        "binding": (bad & ~missing, "TOOL_BINDING_MISMATCH", text(broken["tool"], " at ", broken["tool_path"], " differs from the output at ", broken["output_path"]) if bound else text("")),
    }
    flags = {k: F.coalesce(test, F.lit(False)) for k, (test, _, _) in checks.items()}
    named = lambda values: F.coalesce(*[F.when(flags[k], v) for k, v in values.items()], F.lit(""))
    return state.select(
        item,
        "n_calls",
        *[test.alias(f"bad_{k}") for k, test in flags.items()],
        named({k: F.lit(c) for k, (_, c, _) in checks.items()}).alias("code"),
        named({k: F.lit(k) for k in checks}).alias("step"),
        named({k: m for k, (_, _, m) in checks.items()}).alias("message"),
    )


def spec_json(spec: Mapping[str, Any]) -> Column:
    return F.parse_json(F.lit(json.dumps(spec)))

"""Work that is done once: plans without copies of heavy expressions, in the session's default settings."""

import re

import __spark_entry__ as driver
from verdictframe.functions import rules, schema, text
from verdictframe.operators import trajectory

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_not_scored_in_a_filter_below(spark):
    """An inferred filter on the evidence carried the scorer, Python checks included, to every scan."""
    plan = plan_of(driver.queries()["verify_evidence"](spark, SF))
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]
    assert len(plan) < 400_000


def test_trace_steps_are_worked_out_once(spark):
    spec = """parse_json('{"n":' || id || ',"bindings":[{"tool":"t","tool_path":"$.a","output_path":"$.a"}]}') AS spec"""
    trace = """array(named_struct('name', 't', 'args', parse_json('{}'), 'result', parse_json('{"a":2}'))) AS trace"""
    rows = spark.range(1).selectExpr(spec, "parse_json('{\"a\":1}') AS parsed", trace)
    scored = trajectory.trace_codes(rows, "spec", "trace", "parsed")
    assert scored.columns == ["spec", "parsed", "trace", "trajectory", "trajectory_details"]
    assert plan_of(scored).count("$.bindings") == 1
    row = scored.first()
    assert (row.trajectory.code, row.trajectory_details.observed) == ("TOOL_BINDING_MISMATCH", '{"value":1}')


def test_schemas_without_ids_resolve_no_addresses(monkeypatch):
    """A schema of its own in nearly every row: looking it through cost most of the check."""
    def never(*_):
        raise AssertionError("address resolved")

    monkeypatch.setattr(schema, "urljoin", never)
    check = schema._ready('{"$defs":{"n":{"type":"integer","exclusiveMaximum":60061}},"properties":{"answer":{"anyOf":[{"$ref":"#/$defs/n"},{"const":"x"}]}}}')
    assert (check({"answer": 60060}), check({"answer": 60061}), check({"answer": "x"})) == ([], ["$.answer: anyOf"], [])


def test_orders_without_a_spec_stay_out_of_the_join(spark):
    """Nulls of an outer join all go to one task: nine orders in ten, here."""
    plan = plan_of(driver.queries()["oracle_router"](spark, SF)).splitlines()
    join = next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
    assert any("Union" in line for line in plan[:join])
    assert any("Filter" in line and "% 10) = 0" in line for line in plan[join + 1 : join + 4])


def test_patterns_of_tags_run_only_where_their_word_is(spark):
    assert [text.needed_word(p) for p in (r"\b(?:api|function)\s+calling\b", r"\blookup\s+flows?\b", "a|b", "(?:a|b)?c", "ab*", "(?i)a")] == ["calling", "lookup", "", "", "", ""]
    assert sum(text.needed_word(p) != "" for p, _ in rules.TAG_PATTERNS) >= 16
    briefs = ["Tool\tCalling by API calling", "no calling of tools", "Extract from text", "lookup flow", "a context based qa", "", None]
    rows = spark.createDataFrame(list(enumerate(briefs)), "i int, t string")
    plain = {k: sum(1 for p, _ in rules.TAG_PATTERNS if t is not None and re.search(p, t.lower())) for k, t in enumerate(briefs)}
    only = {r["i"]: r["tags"] for r in rows.select("i", text.rule_tags("t", {}, [(p, [str(n)]) for n, (p, _) in enumerate(rules.TAG_PATTERNS)]).alias("tags")).collect()}
    assert {k: len(v or []) for k, v in only.items()} == plain
    assert plan_of(rows.select(text.rule_tags("t").alias("tags"))).count("lower(") == 1


def test_checkers_read_texts_that_are_parsed_once(spark):
    """Named in an expression, the parse of an input came again wherever the checker read a number."""
    plan = plan_of(driver.queries()["verify_unknown_checker"](spark, SF))
    assert plan.count("parseJson(") == 2


def test_numbers_of_sums_are_read_once(spark):
    """A number that the checker of sums named again was read from the JSON value again."""
    for name in ("verify_all", "verify_unknown_checker"):
        plan = plan_of(driver.queries()[name](spark, SF))
        assert [plan.count(f"$.{n}, LongType") for n in ("a", "b", "c", "answer")] == [1, 1, 1, 1]

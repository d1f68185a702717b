"""Column functions: schema compiler, decisions, judges, envelopes, clusters."""

import json
import random

import pytest
from pyspark.sql import functions as F

from verdictframe.functions import decide, schema, text
from verdictframe.functions.jsonblock import extract_json_block
from verdictframe.operators import clusters, metrics, release, rubric, scoring
from verdictframe.operators.leaks import contained_texts
from verdictframe.sources import envelope, files

SCHEMAS = [
    {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 2}}},
    {"type": ["object", "null"], "properties": {"s": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^x"}}},
    {"type": "array", "minItems": 1, "maxItems": 2, "items": {"enum": [1, "b", None]}},
    {"properties": {"o": {"type": "object", "properties": {"b": {"const": True}}}, "we\"ird": {"type": "number", "maximum": 9}}},
]
VALUES = [
    {"a": 2}, {"a": 1}, {"a": 2.0}, {"a": 2.5}, {"a": "2"}, {"a": True}, {"a": 2, "z": 1}, {}, None, [], [1], [1, "b", None], ["c"],
    {"s": "x"}, {"s": "xy"}, {"s": "xyzz"}, {"s": "ab"}, {"s": 5}, {"o": {"b": True}}, {"o": {"b": False}}, {"o": []},
    {"we\"ird": 10}, {"we\"ird": 9.5}, {"a": None}, 7, "text", True, 1.5,
]


@pytest.mark.parametrize("one", SCHEMAS)
def test_compiled_schema_equals_plain_checker(spark, one):
    df = spark.createDataFrame([(json.dumps(v),) for v in VALUES], "j string").coalesce(1)
    v = F.parse_json("j")
    got = df.select("j", schema.violations(one, v).alias("m"), schema.violated(one, v).alias("b")).collect()
    for row in got:
        want = schema.python_violations(one, json.loads(row["j"]))
        assert sorted(row["m"]) == sorted(want), row["j"]
        assert row["b"] == bool(want)


def test_verdicts_do_not_change_when_schemas_are_added(spark):
    rows = [(json.dumps(s), json.dumps(v)) for s in SCHEMAS for v in VALUES]
    more = [(json.dumps({"maximum": n}), "5") for n in range(300)] + [("{broken", "1"), ('{"pattern":"("}', '"x"'), ('{"$ref":"#"}', "1")]

    def found(table):
        df = spark.createDataFrame(table, "s string, j string")
        return {(r["s"], r["j"]): r["m"] for r in df.select("s", "j", schema.violations_by_schema("s", F.parse_json("j")).alias("m")).collect()}

    few, many = found(rows), found(rows + more)
    assert few == {k: many[k] for k in few}
    assert few[json.dumps(SCHEMAS[0]), json.dumps({"a": 1})] == ["$.a: minimum"]
    for bad in more[-3:]:
        assert many[bad] == schema.UNUSABLE


KEYWORDS = [
    # schema, values that fit, values that do not
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 5, None], [4, 4.5]),
    ({"oneOf": [{"multipleOf": 3}, {"multipleOf": 5}]}, [3, 5, 9], [15, 7]),
    ({"allOf": [{"type": "integer"}, {"exclusiveMinimum": 0}], "not": {"const": 7}}, [1, 2.0], [0, 7, 1.5, "x"]),
    ({"exclusiveMaximum": 3, "multipleOf": 0.1}, [0.3, -1, 2.9], [3, 0.25]),
    ({"type": "integer"}, [12345678901234567890123, -3, 2.0], [2.5, "1", True]),
    ({"pattern": r"^\w+$"}, ["été", "a1", 5], ["a b", ""]),
    ({"pattern": r"^(?P<a>x)\d$"}, ["x1"], ["y1"]),
    ({"uniqueItems": True}, [[1, 2, True], [[1], [2]], []], [[1, 1.0], [{"a": 1}, {"a": 1}]]),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, [["a", 1, 2], [], ["a"]], [[1], ["a", "b"]]),
    ({"contains": {"const": 1}, "maxContains": 2}, [[1], [0, 1, 1]], [[], [0], [1, 1, 1]]),
    ({"minProperties": 1, "maxProperties": 2, "propertyNames": {"maxLength": 2}}, [{"a": 1}, {"a": 1, "bb": 2}, 5], [{}, {"abc": 1}]),
    ({"patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": {"type": "string"}}, [{"n_a": 1, "b": "x"}], [{"n_a": "x"}, {"b": 1}]),
    ({"dependentRequired": {"a": ["b"]}, "dependentSchemas": {"c": {"required": ["d"]}}}, [{"b": 1}, {"a": 1, "b": 2}, {"c": 1, "d": 1}], [{"a": 1}, {"c": 1}]),
    ({"if": {"required": ["k"]}, "then": {"required": ["v"]}, "else": {"maxProperties": 0}}, [{"k": 1, "v": 2}, {}], [{"k": 1}, {"z": 1}]),
    ({"$defs": {"tree": {"type": "object", "properties": {"kids": {"items": {"$ref": "#/$defs/tree"}}}}}, "$ref": "#/$defs/tree"}, [{"kids": [{"kids": []}]}], [{"kids": [{"kids": [3]}]}]),
    ({"enum": [1, "a", None, {"k": [1]}]}, [1.0, None, {"k": [1.0]}], [True, "b", {"k": []}]),
    (False, [], [1, None]),
    (True, [1, None], []),
]


@pytest.mark.parametrize(("one", "good", "bad"), KEYWORDS)
def test_keywords(one, good, bad):
    assert all(schema.python_violations(one, v) == [] for v in good)
    assert all(schema.python_violations(one, v) for v in bad)


def test_compiling_an_unknown_keyword_is_an_error():
    with pytest.raises(ValueError, match="anyOf"):
        schema.violated({"anyOf": []}, F.lit(None))


def test_math_reads_what_is_a_number(spark):
    rows = [('{"answer":3}', ""), ('{"answer":"3"}', ""), ('{"answer":4}', "PROGRAMMATIC_CHECK_FAILED"),
            ('{"answer":"x"}', "PROGRAMMATIC_CHECK_FAILED"), ("{}", "PROGRAMMATIC_CHECK_FAILED")]
    df = spark.createDataFrame(rows, "r string, w string")
    answer = F.try_variant_get(scoring.parse("r"), "$.answer", "bigint")
    out = scoring.math_sum(F.lit(1), F.lit(2), F.lit(None).cast("bigint"), answer)
    assert all(r["c"] == r["w"] for r in df.select("w", out["code"].alias("c")).collect())


def test_registered_checker(spark):
    scoring.register_checker("non_empty_v1", lambda row: scoring.outcome(
        F.to_json(row["parsed"]) != "{}", F.lit("EMPTY"), F.lit("checked")))
    df = spark.createDataFrame([("{}",), ('{"a":1}',)], "r string")
    row = {k: F.parse_json(F.lit("{}")) for k in ("input", "expected", "config")}
    row |= {"parsed": scoring.parse("r"), "rules": F.lit(None).cast("array<struct<from:string,to:string>>")}
    got = [r["c"] for r in df.select(scoring.programmatic_check(F.lit("non_empty_v1"), row)["code"].alias("c")).collect()]
    del scoring.CHECKERS["non_empty_v1"]
    assert got == ["EMPTY", ""]


def test_leak_check(spark):
    rows = [('say {"a":1} now', '{"a":1}', False), ('set "a":1', '{"a":1,"b":"X"}', False), ('the "B" : "x" pair', '{"B":"x"}', False),
            ('"b": "x"', '{"b":"x"}', True), ("nothing", "3", True), ("it is 3", "3", False)]
    df = spark.createDataFrame(rows, "p string, e string, w boolean")
    got = df.select("w", decide.leak_check("p", F.parse_json("e"))["passed"].alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)


def test_owner_words(spark):
    df = spark.createDataFrame([(" Model ", "model"), ("tooling crew", "tooling"), (None, "eval"), ("data/model", "model")], "o string, w string")
    got = df.select("w", decide.normalize_owner("o", F.lit("eval")).alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)


def test_judges(spark):
    rows = [("a", "pass", .8, "pass", .85, "fail", .5, "{\"r\":1}", "pass", .825, ""), ("b", "pass", .9, "fail", .3, "fail", .5, "{\"r\":1}", "fail", .5, "RUBRIC_JUDGE_FAILED"),
            ("c", "pass", .9, "pass", .5, "pass", .6, "{\"r\":1}", "pass", .6, ""), ("d", "pass", .9, "pass", .9, None, None, None, "fail", 0., "RUBRIC_JUDGE_FAILED"),
            ("e", "pass", .9, "fail", .9, None, None, "{\"r\":1}", "fail", 0., "JUDGE_SYSTEM_ERROR")]
    df = spark.createDataFrame(rows, """id string, verdict_1 string, score_1 double, verdict_2 string, score_2 double, verdict_3 string,
        score_3 double, evidence_requirements string, wv string, ws double, we string""")
    for r in rubric.rubric_outcome(df).collect():
        assert (r["verdict"], round(r["score"], 6), r["error_type"]) == (r["wv"], r["ws"], r["we"]), r["id"]


def test_judge_hook(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "mute")], "item_id bigint, prompt string")
    answers = {"good": '{"verdict":"pass","score":0.9}', "bad": '{"verdict":"no"}', "mute": "sorry"}
    got = {(r["item_id"], r["judge_index"]): r["judgement"] for r in rubric.ask_judges(df, lambda p: p.map(answers)).collect()}
    assert len(got) == 6 and got[3, 1] is None and got[3, 2] is None
    assert (got[1, 2]["verdict"], got[1, 2]["score"]) == ("pass", 0.9)
    assert (got[2, 1]["verdict"], got[2, 1]["score"]) == ("fail", 0.0)


def test_json_blocks(spark):
    rows = [("x ```json\n{\"a\": 1}\n``` y", '{"a": 1}'), ("see {\"a\": {\"b\": 2}} {", '{"a": {"b": 2}}'), ("{ open [1]", "[1]"),
            ("none", None), (None, None), ("``` raw ```", "raw")]
    df = spark.createDataFrame(rows, "t string, w string")
    assert all(r["w"] == r["g"] for r in df.select("w", extract_json_block("t").alias("g")).collect())


def test_text_functions(spark):
    row = spark.range(1).select(
        text.strip(F.lit("  a b ")).alias("s"), text.normalize_prompt(F.lit(" A  \n b ")).alias("n"),
        text.extract_name(F.lit("please contact ALICEx at home")).alias("name"), text.iso_to_millis(F.lit("2024-01-01T00:00:01Z")).alias("ms"),
        text.iso_to_millis(F.lit("soon")).alias("bad"), text.batch_size(F.lit("run 99999 cases")).alias("top"),
        F.array_join(text.rule_tags(F.lit("Email lookup and QA")), ",").alias("tags"),
    ).first()
    assert (row["s"], row["n"], row["name"], row["ms"], row["bad"], row["top"]) == ("a b", "a b", "Alicex", 1704067201000, None, 99999)
    assert row["tags"] == "email,extraction,grounded_qa,factual,trajectory"


RESULTS = "idx bigint, item_id string, verdict string, error_type string, evidence_code string, task_type string, eval_method string, message string"


def test_clusters_and_requests(spark):
    rows = [(0, "a", "fail", "EXACT_MATCH_FAILED", "EXACT_MATCH_FAILED", "json_extract_email", "exact_match", ""),
            (1, "b", "fail", "TRAJECTORY_CHECK_FAILED", "TOOL_BINDING_MISMATCH", "trajectory_email_then_answer", "trajectory_check", ""),
            (2, "c", "fail", "EXACT_MATCH_FAILED", "EXACT_MATCH_FAILED", "json_extract_email", "exact_match", ""),
            (3, "d", "fail", "TRAJECTORY_CHECK_FAILED", "", "t", "trajectory_check", "arg_schema failed for x"),
            (4, "e", "fail", "SUT_HTTP_ERROR", "", "t", "exact_match", ""), (5, "f", "pass", "", "", "t", "exact_match", "")]
    df = spark.createDataFrame(rows, RESULTS)
    found = clusters.failure_clusters(df, carry=["message"])
    ids = [(r["cluster_id"], r["n"], r["owner"]) for r in found.orderBy("rank").collect()]
    assert ids[0] == ("EXACT_MATCH_FAILED/EXACT_MATCH_FAILED|json_extract_email|exact_match", 2, "model")
    assert ids[1] == ("TRAJECTORY_CHECK_FAILED/TOOL_BINDING_MISMATCH|trajectory_email_then_answer|trajectory_check", 1, "model")
    assert clusters.cluster_members(df, found).count() == 5
    asked = clusters.data_requests(found)
    assert [r["issue_type"] for r in asked.orderBy("position").collect()] == [
        "LABEL_OR_FIELD_VALUE_WRONG", "TOOL_RESULT_IGNORED_OR_HALLUCINATION", "TOOL_ARGS_BAD"]


def test_run_without_failures_gets_a_pass_cluster(spark):
    df = spark.createDataFrame([(1, 0, "pass", "", "", "", ""), (2, 1, "fail", "X", "", "", "")],
                               "run bigint, idx bigint, verdict string, error_type string, evidence_code string, task_type string, eval_method string")
    got = clusters.with_pass_cluster(clusters.failure_clusters(df, ["run"]), df, ["run"]).orderBy("run").collect()
    assert [(r["cluster_id"], r["n"], r["priority"]) for r in got] == [("PASS", 0, 4), ("X", 1, 1)]


def test_groups_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("k"))
    plan = clusters.top_rows(df, ["k"], ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_latency_rounding(spark):
    df = spark.createDataFrame([(10,), (20,), (31,), (45,), (None,)], "latency_ms bigint")
    assert tuple(metrics.latency_percentiles(df).first()) == (25, 40)
    assert tuple(metrics.latency_percentiles(df, rounding="bankers").first()) == (26, 41)


def test_percentiles_by_parts_equal_the_aggregate(spark):
    """Groups with null keys, far values, ties and halves, found by parts and as one aggregate."""
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else i % 3, rng.choice([rng.randrange(50), rng.randrange(10**6), -rng.randrange(10**15)])) for i in range(6000)]
    rows += [(7, 5)] * 40 + [(8, 1), (8, 2), (9, None)]
    df = spark.createDataFrame(rows, "k bigint, latency_ms bigint")
    for rounding in ("trunc", "bankers"):
        whole = {tuple(r) for r in metrics.latency_percentiles(df, ["k"], rounding=rounding).collect()}
        assert {tuple(r) for r in metrics.latency_percentiles(df, ["k"], rounding=rounding, large=1).collect()} == whole
        assert len(whole) == 5
        assert metrics.latency_percentiles(df, rounding=rounding, large=1).collect() == metrics.latency_percentiles(df, rounding=rounding).collect()
    assert metrics.latency_percentiles(df.limit(0)).collect() == [(None, None)]
    assert metrics.latency_percentiles(df.limit(0), ["k"]).collect() == []


def test_no_task_sorts_a_large_group(spark):
    """Values are sorted inside parts of a group; the windows over whole groups see one row a part."""
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_021).alias("latency_ms"))
    plan = metrics.latency_percentiles(df, large=1000)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_part" in line for line in windows)
    values = sorted(r[0] for r in df.collect())
    low, high = (values[24_999], values[25_000])
    assert metrics.latency_percentiles(df, large=1000).first()["p50"] == (low + high) // 2


def test_empty_suite_fails_the_gate(spark):
    empty = spark.createDataFrame([], "verdict string, error_type string")
    row = metrics.regression_gate(empty).first()
    assert (row["n"], row["pass_rate"], row["passed"]) == (0, 0.0, False)


def test_release_decisions(spark):
    runs = spark.createDataFrame(
        [(1, 10, 8, 2, 1), (2, 10, 9, 1, 2), (3, 10, 9, 1, 3), (4, 0, 0, 0, 4), (5, 10, 10, 0, 5)],
        "run_id bigint, items_total bigint, eval_passed bigint, failures_total bigint, ended_at bigint",
    ).withColumns({"dataset_name": F.lit("d"), "model_version": F.lit("m")})
    found = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, "C")], "run_id bigint, error_type string")
    got = {r["run_id"]: (r["gate"], r["n_recovered"], r["n_introduced"]) for r in release.release_decision(runs, found, blocks=3).collect()}
    assert got == {1: ("WATCH", 0, 2), 2: ("PASS", 1, 0), 3: ("BLOCKED", 1, 1), 4: ("BLOCKED", 0, 0), 5: ("PASS", 0, 0)}


def test_envelopes(spark):
    rows = [(200, '{"output":{"b":1,"a":2},"model_version":"m1","latency_ms":5,"tool_trace":[{"name":"t","args":{"q":1}}]}'),
            (200, '{"output":"plain"}'), (200, "oops"), (500, '{"output":{}}'), (200, '{"other":1}')]
    got = envelope.decode_envelope(spark.createDataFrame(rows, "status_code int, body string")).collect()
    assert [r["raw_output"] for r in got] == ['{"a":2,"b":1}', "plain", "oops", '{"output":{}}', '{"other":1}']
    assert got[0]["tool_trace"][0]["name"] == "t" and got[0]["latency_ms"] == 5


def test_strict_suite_fails_closed(spark, tmp_path):
    lines = spark.createDataFrame([('{"item":{"a":1},"oracle":{}}',), ("",), ('{"item":{}}',)], "value string")
    loose = files.load_suite(lines, {}, strict=False).collect()
    assert [r["problem"] for r in loose] == ["", "missing_oracle"]
    with pytest.raises(Exception, match="missing_oracle"):
        files.load_suite(lines, {}).collect()
    assert files.read_jsonl(spark, str(tmp_path / "nothing"), "a int").count() == 0


def test_contained_texts_equal_brute_force(spark):
    docs = [(0, "The quick brown fox jumps over the lazy dog"), (1, "xthe QUICK brown foxes"), (2, "ab"), (3, "a,b!"), (4, "zzz quick zzz"),
            (5, "")] + [(10 + i, "the quick brown fox jumps") for i in range(20)]
    needles = [(0, "e quick brown fo"), (1, "fox jumps over the lazy d"), (2, "a"), (3, "ab"), (4, "uic"), (5, "b!"), (6, "quick zzz"),
               (7, "no such words in here at all"), (8, "!!"), (9, "x, y"), (10, "e quick brown fo")]
    got = contained_texts(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(needles, "item_id bigint, text string"))
    want = {(d, n) for d, t in docs for n, s in needles if s.lower() in t.lower()}
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


@pytest.mark.parametrize(("one", "good", "bad"), [
    ({"properties": {"a": {}}, "unevaluatedProperties": False}, [{"a": 1}, {}, 5], [{"a": 1, "b": 2}]),
    ({"allOf": [{"properties": {"a": {}}}], "anyOf": [{"properties": {"b": {"type": "string"}}}, {"properties": {"c": {"const": 1}}, "required": ["c"]}], "unevaluatedProperties": False},
     [{"a": 1, "b": "x"}, {"a": 1, "c": 1}], [{"a": 1, "b": "x", "d": 1}, {"b": 3, "c": 1}]),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"properties": {"x": {}}}, "else": {"properties": {"k": {}, "y": {}}}, "unevaluatedProperties": False},
     [{"k": 1, "x": 2}, {"k": 2, "y": 1}], [{"k": 1, "y": 1}, {"k": 2, "x": 1}]),
    ({"$ref": "#/$defs/n", "$defs": {"n": {"properties": {"a": {}}}}, "unevaluatedProperties": {"type": "integer"}}, [{"a": "x", "b": 1}], [{"a": "x", "b": "y"}]),
    ({"prefixItems": [{"type": "string"}], "unevaluatedItems": False}, [["x"], []], [["x", 1]]),
    ({"contains": {"type": "string"}, "unevaluatedItems": {"type": "integer"}}, [["x", 1, "y"]], [["x", 1.5]]),
    ({"properties": {"a": {"$ref": "#num"}}, "$defs": {"n": {"$anchor": "num", "type": "integer"}}}, [{"a": 1}], [{"a": "x"}]),
    ({"$id": "https://example.com/root", "properties": {"a": {"$ref": "item"}, "b": {"$ref": "item#/$defs/s"}}, "$defs": {"i": {"$id": "item", "type": "integer", "$defs": {"s": {"type": "string"}}}}},
     [{"a": 1, "b": "x"}], [{"a": "x"}, {"b": 1}]),
    # a tree that is closed by the schema that uses it
    ({"$id": "https://example.com/strict", "$dynamicAnchor": "node", "$ref": "tree", "unevaluatedProperties": False,
      "$defs": {"t": {"$id": "tree", "$dynamicAnchor": "node", "properties": {"data": True, "children": {"type": "array", "items": {"$dynamicRef": "#node"}}}}}},
     [{"data": 1, "children": [{"data": 2}]}], [{"children": [{"daat": 2}]}, {"daat": 1}]),
    ({"uniqueItems": True}, [[1, True, "1", [1], {"a": 1}, None, False, 0]], [[1, 1.0], [{"a": [1]}, {"a": [1.0]}]]),
])
def test_references_and_unevaluated_parts(one, good, bad):
    assert [schema.python_violations(one, v) for v in good] == [[]] * len(good)
    assert all(schema.python_violations(one, v) not in ([], schema.UNUSABLE) for v in bad)


@pytest.mark.parametrize("one", [
    {"properties": []}, {"required": "abc"}, {"required": [1]}, {"type": "text"}, {"type": []}, {"allOf": []}, {"minLength": -1}, {"maximum": "9"}, {"multipleOf": 0},
    {"items": [{}]}, {"properties": {"a": 5}}, {"$ref": "#/nowhere"}, {"$ref": "#nowhere"}, {"$ref": "https://example.com/other"}, {"not": {"uniqueItems": 1}}, 5, [], "x",
])
def test_texts_that_are_no_schema_fail_every_value(one):
    assert schema.python_violations(one, {"a": 1}) == schema.UNUSABLE
    assert schema._ready(json.dumps(one))({"a": 1}) == schema.UNUSABLE


def test_quick_test_equals_full_check():
    import random

    draw = random.Random(4)
    values = [None, True, 0, 1, 1.0, 2.5, 7, "", "ab", "abcdef", [], {}]
    for _ in range(400):
        members = {n: {k: v for k, v in (("type", draw.choice(["string", "integer", "number", "null", "object"])), ("minimum", 1), ("maximum", 6), ("minLength", 1), ("maxLength", 4)) if draw.random() < 0.5} for n in "abc" if draw.random() < 0.7}
        one = {"type": "object", "properties": members, "required": draw.sample("abc", draw.randrange(3)), "additionalProperties": draw.random() < 0.5}
        quick = schema._plain(one)
        for _ in range(10):
            value = {n: draw.choice(values) for n in "abcd" if draw.random() < 0.6}
            assert quick(value) == (schema.python_violations(one, value) == [])

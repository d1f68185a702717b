"""Statistical gate against the row-by-row loop, and single rules."""

import random

import pytest
from pyspark.sql import functions as F

from verdictframe.functions import hashing
from verdictframe.operators import gates, ordered


def loop(rows, planned):
    seen, counts, out = set(), {}, {}
    for idx, fp, slot in sorted(rows):
        if fp in seen:
            out[idx] = "DUPLICATE_ITEM"
        elif counts.get(slot, 0) + 1 > planned.get(slot, 0) + 1:
            out[idx] = "DISTRIBUTION_MISMATCH"
        else:
            seen.add(fp)
            counts[slot] = counts.get(slot, 0) + 1
            out[idx] = ""
    return out


@pytest.mark.parametrize("seed", range(3))
def test_stat_gate_equals_loop(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(gates, "id_blocks", lambda df, c: ordered.id_blocks(df, c, 13))
    monkeypatch.setattr(gates, "attach", lambda *a, **k: ordered.attach(*a, **k, hot_rows=20))
    # the hot fingerprint holds a third of all rows
    fps = ["hot"] * 40 + [f"f{i}" for i in range(80)]
    slot_of = {fp: rng.choice("xyz") for fp in set(fps)}
    rows = [(i, fp, slot_of[fp]) for i, fp in enumerate(rng.choice(fps) for _ in range(300))]
    planned = {"x": 5, "y": 12}
    df = spark.createDataFrame(rows, "idx bigint, fp string, slot string")
    plan = spark.createDataFrame(list(planned.items()), "slot string, planned bigint")
    got = {r["idx"]: r["stat_code"] for r in gates.stat_gate(df, ["slot"], plan).collect()}
    assert got == loop(rows, planned)


def test_fingerprints(spark):
    df = spark.createDataFrame([("Say  Hi", "bp_v1"), ("say hi ", "bp_v1"), ("say hi", "bp_v2"), ("say hi", "")], "p string, b string")
    plain = df.select(hashing.dedup_fingerprint("p", F.lit("t"), F.lit("easy")).alias("f")).distinct().count()
    full = [r["f"] for r in df.select(hashing.dedup_fingerprint("p", F.lit("t"), F.lit("easy"), "b").alias("f")).collect()]
    assert plain == 1
    assert full[0] == full[1] and len(set(full)) == 3


RULES = [
    # method, requirements, schema -> unverifiable, several answers, rubric incomplete, bad schema
    ("exact_match", None, "{}", (False, False, False, True)),
    ("exact_match", None, '{"type":"object"}', (False, True, False, False)),
    ("rubric_judge", "{}", '{"type":"object","properties":{"a":{"type":"string"}}}', (True, True, True, False)),
    ("rubric_judge", '{"x":1}', '{"type":"object","required":["a"],"properties":{"a":{"type":"string"}}}', (False, False, False, False)),
    ("unit_test", None, '{"properties":{"a":{"type":"string","enum":["b"]}}}', (False, False, False, False)),
    ("unit_test", None, "not json", (True, False, False, True)),
]


def test_semantic_rules(spark):
    df = spark.createDataFrame([r[:3] for r in RULES], "m string, e string, s string")
    m, e, s = F.col("m"), F.col("e"), F.col("s")
    got = df.select(gates.unverifiable(m, e, s).alias("a"), gates.multiple_answers(m, s).alias("b"),
                    gates.rubric_incomplete(m, e).alias("c"), gates.bad_output_schema(s).alias("d")).collect()
    assert [tuple(r) for r in got] == [r[3] for r in RULES]


def test_header_phrases(spark):
    rows = [("Do a vibe check. Input JSON: {}", True, False), ("Add. Input JSON: which looks BEST, vibe check", False, False),
            ("I bestow this", False, True)]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string")
    got = df.select(gates.subjective(F.col("p")), gates.ambiguous(F.col("p"), F.lit("unit_test"), F.lit(None).cast("string"))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_locked_fields(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "item_id string, f int, g string")
    new = spark.createDataFrame([("a", 1, None), ("b", 2, "y")], "item_id string, f int, g string")
    got = gates.locked_field_drift(old, new, ["f", "g"]).collect()
    assert [(r["item_id"], r["failure_code"]) for r in got] == [("b", "TASK_DEFINITION_DRIFT:g")]

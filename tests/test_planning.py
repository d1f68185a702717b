"""Quota allocation against the one-by-one hand-out; expansion, fan-out, audits."""

import random

import pytest
from pyspark.sql import functions as F

from verdictframe.operators import generate, planning, verify
from verdictframe.functions import rules

DDL = "idx bigint, target_id bigint, quota_weight bigint, min_count bigint, max_count bigint"


def hand_out(targets, quota):
    counts = [t[3] for t in targets]
    left = quota - sum(counts)
    total = sum(max(1, t[2]) for t in targets)
    ideal = [left * (max(1, t[2]) / total) for t in targets]
    base = [min(int(i), max(0, t[4] - t[3])) for i, t in zip(ideal, targets)]
    counts = [c + b for c, b in zip(counts, base)]
    fractions = {i: ideal[i] - base[i] for i in range(len(targets))}
    for _ in range(left - sum(base)):
        open_ = [i for i in fractions if counts[i] < targets[i][4]]
        if open_:
            best = max(open_, key=lambda i: (fractions[i], -i))
            del fractions[best]
            counts[best] += 1
        else:
            free = next((i for i in range(len(targets)) if counts[i] < targets[i][4]), None)
            if free is None:
                break
            counts[free] += 1
    return counts


@pytest.mark.parametrize("seed", range(6))
def test_quota_equals_hand_out(spark, seed):
    rng = random.Random(seed)
    targets = [(i, i, rng.randint(0, 30), rng.randint(0, 2), rng.randint(0, 9)) for i in range(rng.randint(3, 40))]
    quota = sum(t[3] for t in targets) + rng.randint(0, 120)
    got = planning.allocate_quota(spark.createDataFrame(targets, DDL), quota, blocks=3).collect()
    assert {r["idx"]: r["count"] for r in got} == {i: n for i, n in enumerate(hand_out(targets, quota)) if n}


def test_quota_without_bounds(spark):
    rows = [(0, 0, 1, None, None), (1, 1, 1, 0, 0), (2, 2, None, 1, 2)]
    got = planning.allocate_quota(spark.createDataFrame(rows, DDL), 9).collect()
    assert {r["idx"]: r["count"] for r in got} == {0: 7, 2: 2}


def test_quota_examples(spark):
    def counts(rows, quota):
        return [r["count"] for r in planning.allocate_quota(spark.createDataFrame(rows, DDL), quota).orderBy("idx").collect()]

    assert counts([(0, 0, 2, 1, 10), (1, 1, 1, 0, 10)], 10) == [7, 3]
    assert counts([(0, 0, 1, 0, 5), (1, 1, 1, 0, 5)], 4) == [2, 2]
    with pytest.raises(Exception, match="exceeds the quota"):
        counts([(0, 0, 1, 5, 9)], 3)


def test_expand_plan_cuts_huge_targets(spark):
    plan = spark.createDataFrame([(0, 5), (1, 0), (2, 23), (3, 1)], "idx bigint, count bigint")
    slots = planning.expand_plan(plan, per_task=4).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(29))
    assert [r["idx"] for r in slots] == [0] * 5 + [2] * 23 + [3]
    assert [r["copy"] for r in slots if r["idx"] == 2] == list(range(23))


def test_repetition_index(spark):
    slots = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "a")], "slot bigint, bp string")
    got = planning.repetition_index(slots, F.col("bp")).orderBy("slot").collect()
    assert [r["repetition_index"] for r in got] == [0, 0, 1, 2]


def test_variants(spark):
    rows = [("math.add", 1, False, False, "easy"), ("math.add", 2, False, True, "hard"), ("math.add", 2, True, True, "hard"),
            ("x.y", 4, False, True, "easy")]
    df = spark.createDataFrame(rows, "family_id string, slot_weight int, hard_mix boolean, hard_mode boolean, difficulty string")
    got = [(r["blueprint_id"], r["scenario_subtype"]) for r in planning.variant_fanout(df).collect()]
    assert ("bp_math_add_easy", "default") in got
    assert ("bp_math_add_hardv2", "wording_distraction") in got
    assert got.count(("bp_x_y_easyv3", "multi")) == 1 and len(got) == 1 + 2 + 3 + 3


def test_generated_items_are_scored_as_passes(spark):
    tasks = [t for t in rules.TASKS if t != "trajectory_email_then_answer"]
    rows = [(i, tasks[i % len(tasks)], "easy", ["t"], f"bp{i % 5}", i // 5, "default" if i % 2 else "noisy") for i in range(120)]
    slots = spark.createDataFrame(rows, """slot bigint, task_type string, difficulty string, domain_tags array<string>,
        blueprint_id string, repetition_index bigint, scenario_subtype string""")
    items = generate.expected_answers(generate.materialize_items(slots, 42))
    again = generate.expected_answers(generate.materialize_items(slots.repartition(3), 42))
    assert {tuple(map(str, r)) for r in items.collect()} == {tuple(map(str, r)) for r in again.collect()}
    assert items.select("item_id").distinct().count() == 120
    answered = items.withColumn("raw_output", F.col("expected"))
    verdicts = verify.verify(answered).groupBy("verdict").count().collect()
    assert [(r["verdict"], r["count"]) for r in verdicts] == [("pass", 120)]
    wrong = verify.verify(items.withColumn("raw_output", F.lit("{}"))).select("error_type").distinct().collect()
    assert [r[0] for r in wrong] == ["MODEL_OUTPUT_SCHEMA_VIOLATION"]


def test_every_hard_scenario_shows_its_keyword(spark):
    pairs = [(t, s) for f, (t, _) in rules.FAMILIES.items() for s in rules.HARD_VARIANTS[f] if t in {x[0] for x in generate.TEMPLATES}]
    rows = [(i, t, "hard", ["t"], "bp", i, s) for i, (t, s) in enumerate(pairs)]
    slots = spark.createDataFrame(rows, """slot bigint, task_type string, difficulty string, domain_tags array<string>,
        blueprint_id string, repetition_index bigint, scenario_subtype string""")
    flagged = planning.reflection_audit(generate.materialize_items(slots, 1)).where("flagged").select("scenario_subtype").collect()
    assert {r[0] for r in flagged} <= {"multi", "wrapped", "wording_distraction"}  # these have no keyword


def test_critic(spark):
    families = spark.createDataFrame([(0, "f", "a,b"), (1, "f", "c"), (2, "g", "a")], "idx bigint, family_id string, allowed_methods string")
    specs = spark.createDataFrame([("1", "f", "c", None), ("2", "g", "a", None), ("3", "h", "rubric_judge", "{}"), ("4", "g", "z", "x")],
                                  "judge_spec_id string, family_id string, eval_method string, evidence_requirements string")
    got = {(r["code"], r["location"]) for r in planning.plan_critic(families, specs).collect()}
    assert got == {("DUPLICATE_FAMILY", "family_id=f"), ("RUBRIC_WITHOUT_EVIDENCE", "judge_spec_id=3"),
                   ("INVALID_EVAL_METHOD", "family_id=f"), ("INVALID_EVAL_METHOD", "family_id=g")}

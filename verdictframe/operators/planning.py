"""Test planning: quota allocation, plan expansion, variants, catalogue checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions import rules
from verdictframe.functions.decide import canonical_family, lookup
from verdictframe.operators.ordered import id_blocks, range_blocks, running_rank, running_sums
from verdictframe.session import materialize

SLOTS_PER_TASK = 100_000


def allocate_quota(targets: DataFrame, quota: int | Column, blocks: int | None = None) -> DataFrame:
    """Targets that get any, with ``count``: minimum, floor of the proportional share up to the maximum, one more for
    the largest fractions (ties: input order), then what is left in input order.

    The one-by-one hand-out has a closed form over two running totals, both taken over blocks.
    Capacity may fall short of the quota; ``shortfall`` tells by how much.
    """
    # no maximum: up to the quota; no minimum: none
    quota_col = quota if isinstance(quota, Column) else F.lit(quota)
    bounded = targets.withColumns({
        "max_count": F.coalesce("max_count", quota_col).cast("bigint"), "min_count": F.coalesce("min_count", F.lit(0)).cast("bigint")
    })
    base = bounded.withColumn("_w", F.greatest(F.lit(1), F.coalesce("quota_weight", F.lit(1))).cast("bigint"))
    totals = base.agg(F.sum("_w").alias("w"), F.sum("min_count").alias("m"))
    remaining = quota_col - totals.select("m").scalar()
    checked = F.when(remaining < 0, F.raise_error(F.lit("sum of min_count exceeds the quota")).cast("bigint")).otherwise(remaining)
    ideal = F.col("_rem") * (F.col("_w") / totals.select("w").scalar())
    capacity = F.greatest(F.lit(0), F.col("max_count") - F.col("min_count"))
    shared = (
        base.withColumn("_rem", checked.cast("bigint"))
        .withColumn("_ideal", ideal)
        .withColumn("_fl", F.least(F.floor("_ideal"), capacity))
        .withColumn("_room", F.col("min_count") + F.col("_fl") < F.col("max_count"))
        .withColumn("_order", F.when(F.col("_room"), F.col("_fl") - F.col("_ideal")).otherwise(F.lit(1.0)))
    )
    ranked = running_rank(range_blocks(shared, [], ["_order", "idx"], blocks), [], ["_order", "idx"], "_rank")
    ranked = materialize(ranked.drop("_block"), "quota")
    sums = ranked.agg(
        (F.max("_rem") - F.sum("_fl")).alias("r"), F.count_if("_room").alias("rooms")
    )
    rest = sums.select("r").scalar()
    second = ranked.withColumn(
        "_c2",
        F.col("min_count") + F.col("_fl") + F.when(F.col("_room") & (F.col("_rank") <= rest), 1).otherwise(0),
    ).withColumn("_left", F.greatest(F.lit(0), rest - sums.select("rooms").scalar()))
    second = second.withColumn("_space", F.greatest(F.lit(0), F.col("max_count") - F.col("_c2")))
    filled = running_sums(id_blocks(second, "idx"), [], ["idx"], {"_space_sum": F.col("_space")})
    extra = F.greatest(F.lit(0), F.least(F.col("_space"), F.col("_left") - (F.col("_space_sum") - F.col("_space"))))
    counted = filled.withColumn("count", (F.col("_c2") + extra).cast("bigint"))
    return counted.where(F.col("count") > 0).select(*targets.columns, "count")


def shortfall(plan: DataFrame, quota: int | Column) -> DataFrame:
    quota_col = quota if isinstance(quota, Column) else F.lit(quota)
    return plan.agg(F.sum("count").alias("planned")).withColumn("shortfall", quota_col - F.col("planned"))


def expand_plan(plan: DataFrame, count: str = "count", idx: str = "idx", per_task: int = SLOTS_PER_TASK) -> DataFrame:
    """One row per slot, in plan order: ``slot`` numbers all slots from 0, ``copy`` those of a target.

    A target with a huge count is cut into chunks first, so no single row grows into one huge task.
    """
    planned = running_sums(id_blocks(plan.where(F.col(count) > 0), idx), [], [idx], {"_end": F.col(count)})
    chunks = planned.drop("_block").select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / F.lit(per_task)))).alias("_chunk")
    )
    spread = chunks.repartition(idx, "_chunk")
    low = F.col("_chunk") * per_task
    high = F.least(F.col(count), low + per_task) - 1
    return spread.select("*", F.explode(F.sequence(low, high)).alias("copy")).select(
        *plan.columns, "copy", (F.col("_end") - F.col(count) + F.col("copy")).alias("slot")
    )


def repetition_index(slots: DataFrame, key: Column, idx: str = "slot") -> DataFrame:
    """Number of earlier slots with the same blueprint (or target)."""
    ranked = running_rank(id_blocks(slots.withColumn("_key", key), idx), ["_key"], [idx], "_rank")
    return ranked.withColumn("repetition_index", F.col("_rank") - 1).drop("_key", "_rank", "_block")


def planned_counts(slots: DataFrame, slot: Sequence[str]) -> DataFrame:
    return slots.groupBy(*slot).agg(F.count("*").alias("planned"))


def resolve_tags(tags: Column) -> Column:
    """Families of capability tokens, first seen first, each once."""
    clean = F.transform(tags, lambda t: F.lower(F.trim(t)))
    groups = F.transform(
        clean,
        lambda t: F.coalesce(
            *[F.when(t == k, F.array(*map(F.lit, v))) for k, v in rules.CAPABILITY_FAMILIES.items()],
            F.array().cast("array<string>"),
        ),
    )
    return F.array_distinct(F.flatten(groups))


def variant_fanout(families: DataFrame, longest: int = 64) -> DataFrame:
    """Rows per family: 1, 2 from weight 2, 3 from weight 4 or for a hard mix; names go round the pool.

    A name beyond ``longest`` characters is cut in front of its suffix and gets eight digits of its hash, so
    that variants and families stay apart.
    """
    weight, hard_mix = F.col("slot_weight"), F.col("hard_mix")
    n = F.when((weight >= 4) | (hard_mix & (weight >= 2)), 3).when(weight >= 2, 2).otherwise(1)
    hard_pool = F.coalesce(
        *[F.when(F.col("family_id") == k, F.array(*map(F.lit, v))) for k, v in rules.HARD_VARIANTS.items()],
        F.array(*map(F.lit, rules.DEFAULT_VARIANTS)),
    )
    pool = F.when(F.col("hard_mode"), hard_pool).otherwise(F.array(*map(F.lit, rules.DEFAULT_VARIANTS)))
    rows = families.withColumn("_n", n).withColumn("_pool", pool)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    suffix = F.when(F.col("_n") > 1, F.concat(F.lit("v"), F.col("_i") + 1)).otherwise("")
    stem = F.concat(F.lit("bp_"), F.replace("family_id", F.lit("."), F.lit("_")), F.lit("_"), F.col("difficulty"))
    stem = F.replace(stem, F.lit(" "), F.lit("_"))
    room = F.lit(longest) - F.length(suffix)
    short = F.concat(F.left(stem, room - 9), F.lit("_"), F.left(F.sha2(stem, 256), F.lit(8)))
    return rows.select(
        *families.columns,
        F.concat(F.when(F.length(stem) > room, short).otherwise(stem), suffix).alias("blueprint_id"),
        F.get("_pool", F.col("_i") % F.size("_pool")).alias("scenario_subtype"),
    )


def conform_to_catalog(incoming: DataFrame, whitelist: Sequence[str] = tuple(rules.METHOD_PRIORITY)) -> DataFrame:
    """Overlay the catalogue on incoming family rows; ``status`` is kept, renamed or rejected."""
    fam = canonical_family("family_id")
    rows = incoming.withColumn("_f", fam)
    key = F.col("_f.family_id")
    allowed = F.coalesce(
        *[F.when(key == k, F.array(*map(F.lit, v[1]))) for k, v in rules.FAMILIES.items()], F.array().cast("array<string>")
    )
    usable = F.array_intersect(allowed, F.array(*map(F.lit, whitelist)))
    usable = F.when(F.size(usable) == 0, F.array(F.lit("schema_check"))).otherwise(usable)
    return rows.select(
        *[c for c in incoming.columns if c != "family_id"],
        F.col("family_id").alias("given_family_id"),
        key.alias("family_id"),
        F.when(key.isNotNull(), F.array_join(usable, ",")).alias("allowed_methods"),
        lookup(key, {k: v[0] for k, v in rules.FAMILIES.items()}).alias("materializer_type"),
        F.when(key.isNull(), "rejected").when(F.col("_f.reason") == "alias_map", "renamed").otherwise("kept").alias("status"),
    )


def plan_critic(families: DataFrame, specs: DataFrame) -> DataFrame:
    """Issues of a plan, one row each: duplicate families, rubric specs without evidence, methods that the
    family does not allow. The first family row of an id counts."""
    per_family = families.groupBy("family_id").agg(
        F.count("*").alias("copies"), F.min_by("allowed_methods", "idx").alias("allowed_methods")
    )
    dup = per_family.where(F.col("copies") > 1).select(
        F.lit("warning").alias("severity"),
        F.lit("DUPLICATE_FAMILY").alias("code"),
        F.concat(F.lit("family_id="), F.col("family_id")).alias("location"),
        (F.col("copies") - 1).alias("n"),
    )
    rubric = specs.where((F.col("eval_method") == "rubric_judge") & (F.coalesce("evidence_requirements", F.lit("")).isin("", "{}"))).select(
        F.lit("error").alias("severity"),
        F.lit("RUBRIC_WITHOUT_EVIDENCE").alias("code"),
        F.concat(F.lit("judge_spec_id="), F.col("judge_spec_id")).alias("location"),
        F.lit(1).cast("bigint").alias("n"),
    )
    # specs per (family, method) are counted first, so a family with very many specs is one row here
    used = specs.where(F.coalesce("eval_method", F.lit("")) != "").groupBy("family_id", "eval_method").agg(F.count("*").alias("n"))
    invalid = (
        used.join(per_family, "family_id")
        .where(~F.array_contains(F.split("allowed_methods", ","), F.col("eval_method")))
        .groupBy("family_id").agg(F.sum("n").alias("n"))
        .select(
            F.lit("error").alias("severity"),
            F.lit("INVALID_EVAL_METHOD").alias("code"),
            F.concat(F.lit("family_id="), F.col("family_id")).alias("location"),
            "n",
        )
    )
    return dup.unionByName(rubric).unionByName(invalid)


def starvation_audit(families: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned slots per family; a family without any is starved."""
    slots = plan.groupBy("family_id").agg(F.sum("count").alias("planned"))
    return families.select("family_id").distinct().join(slots, "family_id", "left").select(
        "family_id",
        F.coalesce("planned", F.lit(0)).cast("bigint").alias("planned"),
        (F.coalesce("planned", F.lit(0)) < 1).alias("starved"),
    )


def distribution_report(items: DataFrame, plan: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Realised against planned counts of every value of every column; mismatches are flagged."""
    def counts(df: DataFrame, weight: Column, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
        return df.select(weight.alias("_n"), F.inline(pairs)).groupBy("dimension", "value").agg(F.sum("_n").alias(name))

    realised = counts(items, F.lit(1).cast("bigint"), "realised")
    planned = counts(plan, F.col("count"), "planned")
    both = realised.join(planned, ["dimension", "value"], "full_outer")
    r, p = F.coalesce("realised", F.lit(0)).cast("bigint"), F.coalesce("planned", F.lit(0)).cast("bigint")
    return both.select("dimension", "value", r.alias("realised"), p.alias("planned"), (r != p).alias("mismatch"))


def subset_audit(items: DataFrame, plan: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of items that the plan does not know, with their number of items."""
    used = items.groupBy(*key).agg(F.count("*").alias("n"))
    return used.join(plan.select(*key).distinct(), list(key), "left_anti")


def coverage_audit(items: DataFrame, oracles: DataFrame, results: DataFrame) -> DataFrame:
    """How many ids are in which of the three tables."""
    def ids(df: DataFrame, flag: str) -> DataFrame:
        return df.groupBy("item_id").agg(F.count("*").alias(flag))

    joined = ids(items, "n_item").join(ids(oracles, "n_oracle"), "item_id", "full_outer").join(
        ids(results, "n_result"), "item_id", "full_outer"
    )
    flags = {f"has_{n}": F.col(f"n_{n}").isNotNull() for n in ("item", "oracle", "result")}
    return joined.groupBy(*[c.alias(n) for n, c in flags.items()]).agg(
        F.count("*").alias("n_ids"),
        F.count_if(F.greatest("n_item", "n_oracle", "n_result") > 1).alias("n_repeated"),
    )


def reflection_audit(items: DataFrame, keywords: dict[str, str] = rules.REFLECTION_KEYWORDS) -> DataFrame:
    """Hard items whose prompt or input shows none of the scenario keywords."""
    prompt, given = F.lower("prompt"), F.lower(F.coalesce("input", F.lit("")))
    shown = F.lit(False)
    for word in keywords.values():
        shown = shown | prompt.contains(word.lower()) | given.contains(word.lower())
    three_terms = (F.col("task_type") == "json_math_add") & F.try_variant_get(
        F.try_parse_json(F.coalesce("input", F.lit(""))), "$.c", "variant"
    ).isNotNull()
    hard = (F.col("difficulty") == "hard") & (F.col("scenario_subtype") != "default")
    return items.select("*", (hard & ~shown & ~F.coalesce(three_terms, F.lit(False))).alias("flagged"))

"""Queries that plan tests and make items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.functions import rules
from verdictframe.functions.text import rule_tags
from verdictframe.operators import generate, planning
from verdictframe.plans.registry import query
from verdictframe.plans.scalars import _BRIEFS, _FAMILY_PICK, _tag_sql, sql_case, sql_text
from verdictframe.plans.views import table, view
from verdictframe.session import spread

ALLOCATE = """
    t0 AS (SELECT * REPLACE (coalesce(max_count, 2 * count(*) OVER ()) AS max_count, coalesce(min_count, 0) AS min_count), greatest(1, quota_weight) AS w FROM v_targets),
    tt AS (SELECT 2 * count(*) AS quota, sum(w) AS sw, sum(min_count) AS sm FROM t0),
    a1 AS (SELECT t0.*, quota, CAST(quota - sm AS BIGINT) AS rem, CAST(quota - sm AS BIGINT) * (w / sw) AS ideal,
              greatest(0, max_count - min_count) AS cap FROM t0, tt),
    a2 AS (SELECT *, least(CAST(floor(ideal) AS BIGINT), cap) AS fl FROM a1),
    a3 AS (SELECT *, min_count + fl < max_count AS room, rem - sum(fl) OVER () AS r FROM a2),
    a4 AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY ideal - fl DESC, idx) AS rn, count(*) FILTER (WHERE room) OVER () AS rooms FROM a3),
    a5 AS (SELECT *, min_count + fl + CASE WHEN room AND rn <= r THEN 1 ELSE 0 END AS c2, greatest(0, r - rooms) AS rest FROM a4),
    a6 AS (SELECT *, greatest(0, max_count - c2) AS space FROM a5),
    a7 AS (SELECT *, sum(space) OVER (ORDER BY idx) AS run FROM a6),
    al AS (SELECT idx, target_id, family_id, task_type, quota_weight, quota,
                 CAST(c2 + greatest(0, least(space, rest - (run - space))) AS BIGINT) AS count FROM a7),
    alloc AS (SELECT * FROM al WHERE count > 0)"""


def allocated(spark: SparkSession, sf: str) -> DataFrame:
    targets = view(spark, sf, "v_targets")
    return planning.allocate_quota(targets, targets.select(2 * F.count("*")).scalar())


@query("allocate_quota", f"WITH {ALLOCATE} SELECT target_id, count FROM alloc", ("v_targets",))
def allocate_quota(spark: SparkSession, sf: str) -> DataFrame:
    return allocated(spark, sf).select("target_id", "count")


@query("quota_shortfall", f"""
    WITH {ALLOCATE} SELECT CAST(sum(count) AS BIGINT) AS planned, CAST(any_value(quota) - sum(count) AS BIGINT) AS shortfall FROM alloc""", ("v_targets",))
def quota_shortfall(spark: SparkSession, sf: str) -> DataFrame:
    targets = view(spark, sf, "v_targets")
    return planning.shortfall(allocated(spark, sf), targets.select(2 * F.count("*")).scalar())


SLOTS = """
    sl AS (SELECT target_id, family_id, task_type, copy, row_number() OVER (ORDER BY idx, copy) - 1 AS slot
           FROM (SELECT *, unnest(range(count)) AS copy FROM alloc WHERE count > 0))"""


def slots(spark: SparkSession, sf: str) -> DataFrame:
    plan = allocated(spark, sf).select("idx", "target_id", "family_id", "task_type", "count")
    return planning.expand_plan(plan)


@query("expand_plan", f"WITH {ALLOCATE}, {SLOTS} SELECT target_id, copy, slot FROM sl", ("v_targets",))
def expand_plan(spark: SparkSession, sf: str) -> DataFrame:
    return slots(spark, sf).select("target_id", "copy", "slot")


@query("repetition_index", f"""
    WITH {ALLOCATE}, {SLOTS}
    SELECT slot, family_id, row_number() OVER (PARTITION BY family_id ORDER BY slot) - 1 AS repetition_index FROM sl""", ("v_targets",))
def repetition_index(spark: SparkSession, sf: str) -> DataFrame:
    return planning.repetition_index(slots(spark, sf), F.col("family_id")).select("slot", "family_id", "repetition_index")


@query("planned_counts", f"WITH {ALLOCATE}, {SLOTS} SELECT family_id, task_type, count(*) AS planned FROM sl GROUP BY ALL", ("v_targets",))
def planned_counts(spark: SparkSession, sf: str) -> DataFrame:
    return planning.planned_counts(slots(spark, sf), ["family_id", "task_type"])


@query("starvation_audit", f"""
    WITH {ALLOCATE}, f AS (SELECT DISTINCT c_mktsegment AS family_id FROM customer UNION SELECT DISTINCT family_id FROM alloc)
    SELECT f.family_id, CAST(coalesce(sum(count), 0) AS BIGINT) AS planned, coalesce(sum(count), 0) < 1 AS starved
    FROM f LEFT JOIN alloc USING (family_id) GROUP BY f.family_id""", ("v_targets",))
def starvation_audit(spark: SparkSession, sf: str) -> DataFrame:
    families = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("family_id")).unionByName(
        view(spark, sf, "v_targets").select("family_id")
    )
    return planning.starvation_audit(families, allocated(spark, sf))


@query("distribution_report", f"""
    WITH {ALLOCATE}, real AS (SELECT family_id, CASE WHEN idx % 6 = 0 THEN 'other' ELSE task_type END AS task_type FROM v_targets),
    r AS (SELECT 'family_id' AS dimension, family_id AS value, count(*) AS n FROM real GROUP BY ALL
          UNION ALL SELECT 'task_type', task_type, count(*) FROM real GROUP BY ALL),
    p AS (SELECT 'family_id' AS dimension, family_id AS value, sum(count) AS n FROM alloc GROUP BY ALL
          UNION ALL SELECT 'task_type', task_type, sum(count) FROM alloc GROUP BY ALL)
    SELECT coalesce(r.dimension, p.dimension) AS dimension, coalesce(r.value, p.value) AS value,
           coalesce(r.n, 0) AS realised, CAST(coalesce(p.n, 0) AS BIGINT) AS planned, coalesce(r.n, 0) <> coalesce(p.n, 0) AS mismatch
    FROM r FULL JOIN p ON r.dimension = p.dimension AND r.value = p.value""", ("v_targets",))
def distribution_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every sixth item was made as another task than planned."""
    items = view(spark, sf, "v_targets").withColumn("task_type", F.when(F.col("idx") % 6 == 0, "other").otherwise(F.col("task_type")))
    return planning.distribution_report(items, allocated(spark, sf), ["family_id", "task_type"])


@query("plan_subset_audit", f"""
    WITH {ALLOCATE}, i AS (SELECT p_brand || CASE WHEN p_partkey % 10 = 0 THEN '-x' ELSE '' END AS family_id FROM part)
    SELECT family_id, count(*) AS n FROM i WHERE family_id NOT IN (SELECT family_id FROM alloc WHERE count > 0) GROUP BY family_id""", ("v_targets",))
def plan_subset_audit(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.when(F.col("p_partkey") % 10 == 0, "-x").otherwise("")
    items = table(spark, sf, "part").select(F.concat("p_brand", suffix).alias("family_id"))
    return planning.subset_audit(items, allocated(spark, sf).where("count > 0"), ["family_id"])


_RESOLVE_SQL = (
    "flatten(list_transform(tags, lambda t: CASE t "
    + " ".join(f"WHEN {sql_text(k)} THEN [{', '.join(map(sql_text, v))}]" for k, v in rules.CAPABILITY_FAMILIES.items())
    + " ELSE [] END))"
)


@query("resolve_tags", f"""
    WITH b AS (SELECT doc_id, lower({_BRIEFS}) AS t FROM documents),
    g AS (SELECT doc_id, {_tag_sql()} AS tags FROM b),
    l AS (SELECT doc_id, unnest({_RESOLVE_SQL}) AS family, unnest(range(len({_RESOLVE_SQL}))) AS pos FROM g),
    f AS (SELECT doc_id, family, min(pos) AS pos FROM l GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM f)
    SELECT d.doc_id, coalesce(string_agg(family, ',' ORDER BY pos), '') AS families
    FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id""")
def resolve_tags(spark: SparkSession, sf: str) -> DataFrame:
    briefs = spread(table(spark, sf, "documents")).select("doc_id", rule_tags(F.expr(_BRIEFS)).alias("tags"))
    return briefs.select("doc_id", F.array_join(planning.resolve_tags(F.col("tags")), ",").alias("families"))


_WEIGHT = "p_size % 6"
_VARIANTS_SQL = "[" + ", ".join(map(sql_text, rules.DEFAULT_VARIANTS)) + "]"
_PART_FAMILY = _FAMILY_PICK.replace("c_custkey", "p_partkey")
# every eighth name is too long for an id
_LONG_FAMILY = f"{_PART_FAMILY} || CASE WHEN p_partkey % 8 = 0 THEN repeat('.part', 8) || CAST(p_partkey % 5 AS STRING) ELSE '' END"
_HARD_SQL = (
    "CASE family_id "
    + " ".join(f"WHEN {sql_text(k)} THEN [{', '.join(map(sql_text, v))}]" for k, v in rules.HARD_VARIANTS.items())
    + f" ELSE {_VARIANTS_SQL} END"
)


@query("variant_fanout", f"""
    WITH f AS (SELECT p_partkey, {_LONG_FAMILY} AS family_id, {_WEIGHT} AS slot_weight, p_partkey % 3 = 0 AS hard_mix,
                  p_partkey % 2 = 0 AS hard_mode, CASE WHEN p_partkey % 2 = 0 THEN 'hard' ELSE 'easy' END AS difficulty FROM part),
    n AS (SELECT *, CASE WHEN slot_weight >= 4 OR (hard_mix AND slot_weight >= 2) THEN 3 WHEN slot_weight >= 2 THEN 2 ELSE 1 END AS n,
             CASE WHEN hard_mode THEN {_HARD_SQL} ELSE {_VARIANTS_SQL} END AS pool FROM f),
    y AS (SELECT *, unnest(range(n)) AS i FROM n),
    x AS (SELECT *, CASE WHEN n > 1 THEN 'v' || (i + 1) ELSE '' END AS suffix, replace('bp_' || replace(family_id, '.', '_') || '_' || difficulty, ' ', '_') AS stem FROM y)
    SELECT p_partkey, CASE WHEN length(stem) > 64 - length(suffix) THEN left(stem, 55 - length(suffix)) || '_' || left(sha256(stem), 8) ELSE stem END || suffix
           AS blueprint_id, pool[(i % len(pool)) + 1] AS scenario_subtype FROM x""")
def variant_fanout(spark: SparkSession, sf: str) -> DataFrame:
    hard = F.col("p_partkey") % 2 == 0
    families = table(spark, sf, "part").select(
        "p_partkey",
        F.expr(_LONG_FAMILY).alias("family_id"),
        F.expr(_WEIGHT).alias("slot_weight"),
        (F.col("p_partkey") % 3 == 0).alias("hard_mix"),
        hard.alias("hard_mode"),
        F.when(hard, "hard").otherwise("easy").alias("difficulty"),
    )
    return planning.variant_fanout(families).select("p_partkey", "blueprint_id", "scenario_subtype")


_TASK_OF = {k: v[0] for k, v in rules.FAMILIES.items()}
_METHODS_OF = {k: ",".join(v[1]) for k, v in rules.FAMILIES.items()}
_ALIAS_SQL = sql_case("given_family_id", rules.FAMILY_ALIASES, "NULL")
_KNOWN_SQL = "given_family_id IN (" + ", ".join(map(sql_text, rules.FAMILIES)) + ")"


@query("conform_to_catalog", f"""
    WITH i AS (SELECT c_custkey, {_FAMILY_PICK} AS given_family_id FROM customer),
    c AS (SELECT *, CASE WHEN {_KNOWN_SQL} THEN given_family_id ELSE {_ALIAS_SQL} END AS family_id FROM i)
    SELECT c_custkey, given_family_id, family_id,
           CASE WHEN family_id IS NOT NULL THEN coalesce(nullif(replace({sql_case("family_id", _METHODS_OF, "''")}, ',rubric_judge', ''), ''), 'schema_check') END AS allowed_methods,
           {sql_case("family_id", _TASK_OF, "NULL")} AS materializer_type,
           CASE WHEN {_KNOWN_SQL} THEN 'kept' WHEN family_id IS NOT NULL THEN 'renamed' ELSE 'rejected' END AS status FROM c""")
def conform_to_catalog(spark: SparkSession, sf: str) -> DataFrame:
    incoming = table(spark, sf, "customer").select("c_custkey", F.expr(_FAMILY_PICK).alias("family_id"))
    return planning.conform_to_catalog(incoming, [m for m in rules.METHOD_PRIORITY if m != "rubric_judge"])


_CRITIC_FAMILY = "'fam_' || CAST(c_custkey % 400 AS STRING)"
_CRITIC_ALLOWED = "CASE c_custkey % 3 WHEN 0 THEN 'exact_match,schema_check' WHEN 1 THEN 'programmatic_check,rubric_judge' ELSE 'rubric_judge' END"
_CRITIC_METHOD = "CASE o_orderkey % 4 WHEN 0 THEN 'exact_match' WHEN 1 THEN 'rubric_judge' WHEN 2 THEN 'programmatic_check' ELSE '' END"


@query("plan_critic", f"""
    WITH f AS (SELECT c_custkey AS idx, {_CRITIC_FAMILY} AS family_id, {_CRITIC_ALLOWED} AS allowed FROM customer),
    s AS (SELECT 'js_' || o_orderkey AS judge_spec_id, 'fam_' || o_custkey % 500 AS family_id, {_CRITIC_METHOD} AS eval_method,
             CASE WHEN o_orderkey % 8 = 1 THEN '{{}}' WHEN o_orderkey % 12 = 5 THEN NULL ELSE '{{"a":1}}' END AS er FROM orders),
    g AS (SELECT family_id, count(*) AS copies, arg_min(allowed, idx) AS allowed FROM f GROUP BY family_id)
    SELECT 'warning' AS severity, 'DUPLICATE_FAMILY' AS code, 'family_id=' || family_id AS location, copies - 1 AS n FROM g WHERE copies > 1
    UNION ALL SELECT 'error', 'RUBRIC_WITHOUT_EVIDENCE', 'judge_spec_id=' || judge_spec_id, 1 FROM s
              WHERE eval_method = 'rubric_judge' AND (er IS NULL OR er = '{{}}')
    UNION ALL SELECT 'error', 'INVALID_EVAL_METHOD', 'family_id=' || s.family_id, count(*) FROM s JOIN g USING (family_id)
              WHERE eval_method <> '' AND NOT list_contains(string_split(allowed, ','), eval_method) GROUP BY s.family_id""")
def plan_critic(spark: SparkSession, sf: str) -> DataFrame:
    families = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("idx"), F.expr(_CRITIC_FAMILY).alias("family_id"), F.expr(_CRITIC_ALLOWED).alias("allowed_methods")
    )
    key = F.col("o_orderkey")
    specs = table(spark, sf, "orders").select(
        F.concat(F.lit("js_"), key).alias("judge_spec_id"),
        F.concat(F.lit("fam_"), F.col("o_custkey") % 500).alias("family_id"),
        F.expr(_CRITIC_METHOD).alias("eval_method"),
        F.when(key % 8 == 1, "{}").when(key % 12 == 5, F.lit(None)).otherwise('{"a":1}').alias("evidence_requirements"),
    )
    return planning.plan_critic(families, specs)


@query("coverage_audit", """
    WITH i AS (SELECT item_id, count(*) AS n FROM v_result_items GROUP BY item_id), o AS (SELECT item_id, count(*) AS n FROM v_result_oracles GROUP BY item_id),
    r AS (SELECT item_id, count(*) AS n FROM (SELECT item_id FROM v_results UNION ALL SELECT item_id FROM v_results WHERE idx % 10 = 3) GROUP BY item_id)
    SELECT i.item_id IS NOT NULL AS has_item, o.item_id IS NOT NULL AS has_oracle, r.item_id IS NOT NULL AS has_result, count(*) AS n_ids,
           count(*) FILTER (WHERE greatest(coalesce(i.n, 0), coalesce(o.n, 0), coalesce(r.n, 0)) > 1) AS n_repeated
    FROM i FULL JOIN o ON i.item_id = o.item_id FULL JOIN r ON coalesce(i.item_id, o.item_id) = r.item_id GROUP BY ALL""",
       ("v_results", "v_result_items", "v_result_oracles"))
def coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    results = view(spark, sf, "v_results")
    twice = results.select("item_id").unionByName(results.where("idx % 10 = 3").select("item_id"))
    return planning.coverage_audit(view(spark, sf, "v_result_items"), view(spark, sf, "v_result_oracles"), twice)


_SUBTYPES = ["default", *rules.REFLECTION_KEYWORDS]
_SUBTYPE_PICK = "CASE " + " ".join(f"WHEN idx % {len(_SUBTYPES)} = {i} THEN {sql_text(s)}" for i, s in enumerate(_SUBTYPES)) + " END"
_REFLECTED = " OR ".join(
    f"contains(lower(prompt), {sql_text(w.lower())}) OR contains(lower(family_id), {sql_text(w.lower())})"
    for w in dict.fromkeys(rules.REFLECTION_KEYWORDS.values())
)


@query("reflection_audit", f"""
    WITH i AS (SELECT * REPLACE (prompt || CASE WHEN idx % 5 = 1 THEN ' Step 1 and the CARRY' ELSE '' END AS prompt), {_SUBTYPE_PICK} AS st FROM v_items)
    SELECT idx, st AS scenario_subtype, difficulty = 'hard' AND st <> 'default' AND NOT ({_REFLECTED}) AS flagged FROM i""", ("v_items",))
def reflection_audit(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "v_items").withColumns({
        "prompt": F.concat("prompt", F.when(F.col("idx") % 5 == 1, " Step 1 and the CARRY").otherwise("")),
        "scenario_subtype": F.expr(_SUBTYPE_PICK),
        "input": F.col("family_id"),
    })
    return planning.reflection_audit(items).select("idx", "scenario_subtype", "flagged")


@query("ground_items", f"""
    WITH n AS (SELECT count(*) AS n FROM pages),
    i AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'web_grounded' ELSE 'image_grounded' END AS source_policy,
             o_orderkey % n AS page_id, 'Which priority? ' || o_orderpriority AS prompt FROM orders, n)
    SELECT o_orderkey, source_policy AS source, CASE WHEN source_policy = 'web_grounded' THEN url ELSE '' END AS source_ref,
           sha256(CASE source_policy WHEN 'web_grounded' THEN {sql_text(generate.INSTRUCTION)} || chr(10) || 'Context: ' || html || chr(10) || 'Question: ' || prompt
             WHEN 'image_grounded' THEN {sql_text(generate.INSTRUCTION)} || chr(10) || 'Image description: ' || html ELSE prompt END) AS prompt_digest
    FROM i JOIN pages USING (page_id)""")
def ground_items(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", F.col("html").alias("content"))
    kind = F.col("o_orderkey") % 3
    items = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(kind == 0, "synthetic").when(kind == 1, "web_grounded").otherwise("image_grounded").alias("source_policy"),
        (F.col("o_orderkey") % pages.select(F.count("*")).scalar()).alias("page_id"),
        F.concat(F.lit("Which priority? "), "o_orderpriority").alias("prompt"),
    )
    return generate.ground_items(items, pages).select(
        "o_orderkey", "source", "source_ref", F.sha2("prompt", 256).alias("prompt_digest")
    )

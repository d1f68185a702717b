"""Queries over single columns: normalisers, hashes, decision lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.functions import decide, hashing, rules, text
from verdictframe.operators import rubric, trajectory
from verdictframe.plans.registry import query
from verdictframe.plans.views import table, view
from verdictframe.session import spread


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_case(key: str, mapping: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in mapping.items())
    return f"CASE {key} {arms} ELSE {default} END"


@query("normalize_prompt", r"""
    SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest,
           length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS n_chars FROM documents""")
def normalize_prompt(spark: SparkSession, sf: str) -> DataFrame:
    norm = text.normalize_prompt("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(norm, 256).alias("digest"), F.length(norm).cast("bigint").alias("n_chars")
    )


@query("canonical_json_hash", """
    SELECT event_id, sha256('{"k":' || (props->>'$.k') || '}') AS digest FROM events""")
def canonical_json_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", hashing.canonical_json_hash("props").alias("digest"))


@query("dedup_fingerprint", r"""
    SELECT idx, sha256(trim(regexp_replace(lower(prompt), '\s+', ' ', 'g')) || chr(1) || task_type || chr(1) || difficulty
           || chr(1) || 'b=' || blueprint_id || chr(1) || 'f=' || family_id) AS fp FROM v_items""", ("v_items",))
def dedup_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    fp = hashing.dedup_fingerprint("prompt", "task_type", "difficulty", "blueprint_id", "family_id")
    return view(spark, sf, "v_items").select("idx", fp.alias("fp"))


_BRIEF = (
    "CASE doc_id % 5 WHEN 0 THEN 'Q' || text WHEN 1 THEN 'Sum it up. Input JSON: ' || text "
    "WHEN 2 THEN 'Explain' || chr(10) || 'Input follows ' || text "
    "WHEN 3 THEN 'lower' || chr(10) || 'input then Input JSON: ' || text ELSE 'input json: ' || text END"
)


@query("instruction_header", rf"""
    WITH p AS (SELECT doc_id, {_BRIEF} AS t FROM documents),
    h AS (SELECT doc_id, CASE WHEN strpos(t, 'Input JSON:') > 0 THEN substr(t, 1, strpos(t, 'Input JSON:') - 1)
             WHEN strpos(t, 'input json:') > 0 THEN substr(t, 1, strpos(t, 'input json:') - 1)
             WHEN strpos(t, chr(10) || 'Input ') > 0 THEN substr(t, 1, strpos(t, chr(10) || 'Input ') - 1)
             WHEN strpos(t, chr(10) || 'input ') > 0 THEN substr(t, 1, strpos(t, chr(10) || 'input ') - 1)
             ELSE t END AS h FROM p)
    SELECT doc_id, regexp_replace(h, '^\s+|\s+$', '', 'g') AS header FROM h""")
def instruction_header(spark: SparkSession, sf: str) -> DataFrame:
    prompts = table(spark, sf, "documents").select("doc_id", F.expr(_BRIEF).alias("t"))
    return prompts.select("doc_id", text.instruction_header("t").alias("header"))


@query("json_path_get", """
    SELECT idx, CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.output.k') AS VARCHAR) END AS k,
           CAST(NULL AS VARCHAR) AS no_path FROM v_envelope""", ("v_envelope",))
def json_path_get(spark: SparkSession, sf: str) -> DataFrame:
    v = F.try_parse_json("body")
    return view(spark, sf, "v_envelope").select(
        "idx",
        trajectory.json_path(v, F.lit("$.output.k")).alias("k"),
        trajectory.json_path(v, F.lit("output.k")).alias("no_path"),
    )


@query("first_evidence_code", """
    SELECT idx, evidence_code AS code FROM v_results""", ("v_results",))
def first_evidence_code(spark: SparkSession, sf: str) -> DataFrame:
    evidence = F.array(
        F.struct(F.lit("note").alias("kind"), F.lit(None).cast("string").alias("code")),
        F.struct(F.lit("check").alias("kind"), F.col("evidence_code").alias("code")),
        F.struct(F.lit("check").alias("kind"), F.lit("").alias("code")),
    )
    return view(spark, sf, "v_results").select("idx", decide.evidence_code(evidence).alias("code"))


@query("field_normalizers", r"""
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS stripped,
           CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lower(c_name) END AS lowered FROM customer""")
def field_normalizers(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit(" \t"), "c_name", F.lit("\n ")))
    return table(spark, sf, "customer").select(
        "c_custkey", text.strip(padded).alias("stripped"), text.strip_lower(padded).alias("lowered")
    )


@query("extract_email", rf"""
    SELECT doc_id, coalesce(regexp_extract(text, '{rules.EMAIL_PATTERN}', 0), '') AS email FROM documents""")
def extract_email(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", text.extract_email("text").alias("email"))


_CONTACT = "'Please contact ' || lower(c_mktsegment) || CASE WHEN c_custkey % 4 = 0 THEN ' on ' ELSE ' at  ' END || c_name"


@query("extract_name", rf"""
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ''
           ELSE upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) END AS name FROM customer""")
def extract_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", text.extract_name(F.expr(_CONTACT)).alias("name"))


_SENTIMENT_KEYS = list(rules.SENTIMENT_LABELS)
_PICK = "CASE " + " ".join(
    f"WHEN event_id % {len(_SENTIMENT_KEYS) + 3} = {i} THEN {sql_text(k)}" for i, k in enumerate(_SENTIMENT_KEYS)
) + " ELSE 'unknown text' END"


@query("label_lookup", f"""
    WITH labels_of(t, label) AS (VALUES {", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v in rules.SENTIMENT_LABELS.items())}),
    e AS (SELECT event_id, {_PICK} AS t FROM events)
    SELECT event_id, coalesce(label, 'neutral') AS label FROM e LEFT JOIN labels_of USING (t)""")
def label_lookup(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "events").select("event_id", F.expr(_PICK).alias("t"))
    return texts.select("event_id", decide.lookup("t", rules.SENTIMENT_LABELS, rules.DEFAULT_LABEL).alias("label"))


@query("numeric_oracle", "SELECT l_orderkey, l_linenumber, a, b, a + b + coalesce(c, 0) AS answer FROM v_math", ("v_math",))
def numeric_oracle(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_math").select(
        "l_orderkey", "l_linenumber", "a", "b", (F.col("a") + F.col("b") + F.coalesce("c", F.lit(0))).alias("answer")
    )


_PAGE_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'),
    '(?is)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"""


@query("context_oracle", f"""
    SELECT page_id, CASE page_id % 3 WHEN 1 THEN 'description' ELSE 'answer' END AS field,
           coalesce(CASE page_id % 3 WHEN 0 THEN {_PAGE_TEXT} WHEN 1 THEN regexp_extract(html, '(?is)<title>(.*?)</title>', 1) END, '') AS expected FROM pages""")
def context_oracle(spark: SparkSession, sf: str) -> DataFrame:
    """Grounding answers from whole pages: the text of the page, or its title as the description of a picture."""
    third = F.col("page_id") % 3
    given = table(spark, sf, "pages").select(
        "page_id", F.when(third == 0, text.plain_text("html")).alias("context"),
        F.when(third == 1, F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("image_description"),
    )
    return given.select("page_id", F.inline(F.array(decide.context_oracle("context", "image_description"))))


_METHOD_OF = {k: v[0] for k, v in rules.TASKS.items()}
_CHECKER_OF = {k: v[1] for k, v in rules.TASKS.items() if v[1]}
_TASK_PICK = "CASE " + " ".join(
    f"WHEN o_orderkey % 9 = {i} THEN {sql_text(t)}" for i, t in enumerate(rules.TASKS)
) + " ELSE 'free_form' END"


@query("oracle_router", f"""
    WITH t AS (SELECT o_orderkey, {_TASK_PICK} AS task_type, o_orderkey % 10 = 0 AS has_spec FROM orders)
    SELECT o_orderkey, task_type,
           CASE WHEN has_spec THEN 'rubric_judge' ELSE {sql_case("task_type", _METHOD_OF, "'schema_check'")} END AS eval_method,
           CASE WHEN has_spec THEN '' ELSE {sql_case("task_type", _CHECKER_OF, "''")} END AS checker_name
    FROM t""")
def oracle_router(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr(_TASK_PICK).alias("task_type"),
        F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("spec_"), "o_orderkey")).alias("judge_spec_id"),
    )
    specs = table(spark, sf, "orders").where(F.col("o_orderkey") % 10 == 0).select(
        F.concat(F.lit("spec_"), "o_orderkey").alias("judge_spec_id"),
        F.lit("rubric_judge").alias("spec_method"),
        F.lit("").alias("spec_checker"),
    )
    method = decide.pick_by_priority(decide.applicable_methods("task_type"))["selected"]
    # most orders name no spec: in the join all of them would meet in one task
    named, rest = F.col("judge_spec_id").isNotNull(), F.lit(None).cast("string")
    joined = orders.where(named).join(specs, "judge_spec_id", "left").unionByName(
        orders.where(~named).select("*", rest.alias("spec_method"), rest.alias("spec_checker"))
    )
    return joined.select(
        "o_orderkey",
        "task_type",
        F.coalesce("spec_method", method).alias("eval_method"),
        F.coalesce("spec_checker", decide.lookup("task_type", _CHECKER_OF, "")).alias("checker_name"),
    )


@query("pick_by_priority", f"""
    WITH t AS (SELECT o_orderkey, {_TASK_PICK} AS task_type FROM orders),
    m AS (SELECT o_orderkey, {sql_case("task_type", _METHOD_OF, "'schema_check'")} AS own FROM t)
    SELECT o_orderkey, own AS selected,
           CASE WHEN own = 'schema_check' THEN 'schema_check,rubric_judge' ELSE own || ',schema_check,rubric_judge' END AS candidates,
           CASE WHEN own = 'schema_check' THEN 'rubric_judge' ELSE 'schema_check,rubric_judge' END AS rejected,
           {sql_case("own", rules.METHOD_REASONS, "''")} AS rationale FROM m""")
def pick_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    picked = decide.pick_by_priority(decide.applicable_methods(F.expr(_TASK_PICK)))
    return table(spark, sf, "orders").select("o_orderkey", picked.alias("p")).select(
        "o_orderkey",
        F.col("p.selected").alias("selected"),
        F.array_join("p.candidates", ",").alias("candidates"),
        F.array_join("p.rejected", ",").alias("rejected"),
        F.col("p.rationale").alias("rationale"),
    )


_LEAKY = (
    "'Pick one. ' || CASE c_custkey % 5 WHEN 0 THEN '{\"label\":\"' || c_mktsegment || '\"}' "
    "WHEN 1 THEN '\"label\" : \"' || c_mktsegment || '\"' WHEN 2 THEN '\"label\": \"' || c_mktsegment || '\"' ELSE c_name END"
)


@query("leak_check", """
    SELECT c_custkey, c_custkey % 5 > 1 AS passed,
           CASE c_custkey % 5 WHEN 0 THEN 'canonical expected JSON appears in prompt; completed key/value pair leaked for key=label'
                WHEN 1 THEN 'completed key/value pair leaked for key=label' ELSE '' END AS notes FROM customer""")
def leak_check(spark: SparkSession, sf: str) -> DataFrame:
    expected = F.parse_json(F.to_json(F.struct(F.col("c_mktsegment").alias("label"))))
    return table(spark, sf, "customer").select(
        "c_custkey", decide.leak_check(F.expr(_LEAKY), expected).alias("c")
    ).select("c_custkey", "c.passed", "c.notes")


_RAW_JUDGE = (
    "'{\"verdict\":\"' || CASE doc_id % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'pass' ELSE 'maybe' END || '\"' "
    "|| CASE doc_id % 4 WHEN 0 THEN ',\"score\":1.5' WHEN 1 THEN ',\"score\":-0.5' WHEN 2 THEN ',\"score\":0.25' ELSE '' END "
    "|| ',\"evidence\":[{\"rule\":\"r1\"},3,{\"observation\":\"o\"}]}'"
)


@query("normalize_judgement", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'fail' ELSE 'pass' END AS verdict,
           CASE doc_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.25::DOUBLE
                ELSE CASE WHEN doc_id % 3 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score,
           'r1=|unknown=o' AS evidence, 'stub' AS model_version FROM labels""")
def normalize_judgement(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "labels").select(
        "doc_id", rubric.normalize_judgement(F.try_parse_json(F.expr(_RAW_JUDGE))).alias("j")
    )
    return out.select(
        "doc_id",
        "j.verdict",
        "j.score",
        F.array_join(F.transform("j.evidence", lambda e: F.concat(e["rule"], F.lit("="), e["observation"])), "|").alias("evidence"),
        "j.model_version",
    )


@query("judge_verdict_map", """
    SELECT event_id, CASE WHEN event_type = 'purchase' THEN '' WHEN event_type = 'view' THEN 'CUSTOM_CODE'
           WHEN event_type = 'error' THEN 'JUDGE_SYSTEM_ERROR' ELSE 'RUBRIC_JUDGE_FAILED' END AS error_type FROM events""")
def judge_verdict_map(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    verdict = F.when(kind == "purchase", "PASS").when(kind == "error", "ERROR").otherwise("FAIL")
    given = F.when(kind == "view", "CUSTOM_CODE")
    return table(spark, sf, "events").select("event_id", rubric.verdict_error(verdict, given).alias("error_type"))


_OWNERS = (
    "CASE s_suppkey % 9 WHEN 0 THEN ' Data ' WHEN 1 THEN 'training team' WHEN 2 THEN 'UX research' WHEN 3 THEN 'toolsmith' "
    "WHEN 4 THEN 'eval' WHEN 5 THEN 'data and model' WHEN 6 THEN NULL WHEN 7 THEN 'metadata' ELSE s_name END"
)


@query("owner_normalize", """
    SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 'data' WHEN 1 THEN 'model' WHEN 2 THEN 'product' WHEN 3 THEN 'tooling'
           WHEN 4 THEN 'eval' WHEN 5 THEN 'model' WHEN 6 THEN 'fallback' WHEN 7 THEN 'data' ELSE 'fallback' END AS owner
    FROM supplier""")
def owner_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        "s_suppkey", decide.normalize_owner(F.expr(_OWNERS), F.lit("fallback")).alias("owner")
    )


_FAMILY_NAMES = list(rules.FAMILIES) + list(rules.FAMILY_ALIASES) + ["", "video.qa"]
_FAMILY_PICK = "CASE " + " ".join(
    f"WHEN c_custkey % {len(_FAMILY_NAMES)} = {i} THEN {sql_text(f)}" for i, f in enumerate(_FAMILY_NAMES)
) + " END"


@query("alias_canonicalize", f"""
    WITH f AS (SELECT c_custkey, {_FAMILY_PICK} AS given FROM customer),
    known(k) AS (VALUES {", ".join(f"({sql_text(k)})" for k in rules.FAMILIES)}),
    alias(a, target) AS (VALUES {", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v in rules.FAMILY_ALIASES.items())})
    SELECT c_custkey, given, coalesce(k, target) AS family_id,
           CASE WHEN k IS NOT NULL THEN '' WHEN target IS NOT NULL THEN 'alias_map' ELSE 'unsupported' END AS reason
    FROM f LEFT JOIN known ON given = k LEFT JOIN alias ON given = a""")
def alias_canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "customer").select("c_custkey", F.expr(_FAMILY_PICK).alias("given"))
    return given.withColumn("f", decide.canonical_family("given")).select("c_custkey", "given", "f.family_id", "f.reason")


_BRIEFS = (
    "CASE doc_id % 8 WHEN 0 THEN 'Smoke test: 25 easy items, email lookup flows. ' "
    "WHEN 1 THEN 'Adversarial tool  calling with multi-step reasoning, 20000 cases. ' "
    "WHEN 2 THEN 'Grounded factual QA from the web. ' WHEN 3 THEN 'Regression of structured parsing and math. ' "
    "WHEN 4 THEN 'Image classification, hard edge cases. ' WHEN 5 THEN 'Schema adherence. 0 items. ' "
    "WHEN 6 THEN 'Extract text, canonical labels, sentiment. ' ELSE '' END || text"
)


def _tag_sql() -> str:
    keywords = [
        f"CASE WHEN contains(t, {sql_text(k)}) THEN [{', '.join(map(sql_text, v))}] ELSE [] END"
        for k, v in rules.TAG_KEYWORDS.items()
    ]
    patterns = [
        f"CASE WHEN regexp_matches(t, {sql_text(p)}) THEN [{', '.join(map(sql_text, v))}] ELSE [] END"
        for p, v in rules.TAG_PATTERNS
    ]
    return "flatten([" + ", ".join(keywords + patterns) + "])"


@query("rule_tagging", f"""
    WITH b AS (SELECT doc_id, lower({_BRIEFS}) AS t FROM documents),
    hits AS (SELECT doc_id, {_tag_sql()} AS tags FROM b),
    long AS (SELECT doc_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM hits),
    firsts AS (SELECT doc_id, tag, min(pos) AS pos FROM long GROUP BY ALL)
    SELECT d.doc_id, coalesce(string_agg(tag, ',' ORDER BY pos), '') AS tags
    FROM documents d LEFT JOIN firsts f ON d.doc_id = f.doc_id GROUP BY d.doc_id""")
def rule_tagging(spark: SparkSession, sf: str) -> DataFrame:
    briefs = spread(table(spark, sf, "documents")).select("doc_id", F.expr(_BRIEFS).alias("brief"))
    return briefs.select("doc_id", F.array_join(text.rule_tags("brief"), ",").alias("tags"))


@query("text_first_match", rf"""
    WITH b AS (SELECT doc_id, {_BRIEFS} AS t FROM documents),
    n AS (SELECT *, try_cast(regexp_extract(t, '(?i)\b(\d+)\s*(?:items?|samples?|cases?|batch)?\b', 1) AS BIGINT) AS n FROM b)
    SELECT doc_id,
           CASE WHEN regexp_matches(lower(t), '{rules.OBJECTIVE_PATTERNS[0][0]}') THEN 'smoke'
                WHEN regexp_matches(lower(t), '{rules.OBJECTIVE_PATTERNS[1][0]}') THEN 'regression'
                WHEN regexp_matches(lower(t), '{rules.OBJECTIVE_PATTERNS[2][0]}') THEN 'failure_seeking' ELSE 'balanced' END AS objective,
           CASE WHEN regexp_matches(lower(t), '{rules.GROUNDING_PATTERNS[0][0]}') THEN 'web_grounded'
                WHEN regexp_matches(lower(t), '{rules.GROUNDING_PATTERNS[1][0]}') THEN 'image_grounded' ELSE 'synthetic' END AS grounding,
           CASE WHEN regexp_matches(t, '{rules.HARD_PATTERN}') THEN 'hard'
                WHEN regexp_matches(t, '{rules.EASY_PATTERN}') THEN 'easy' ELSE 'even' END AS difficulty_mix,
           CAST(greatest(1, coalesce(n, 12)) AS BIGINT) AS batch_size
    FROM n""")
def text_first_match(spark: SparkSession, sf: str) -> DataFrame:
    briefs = spread(table(spark, sf, "documents")).select("doc_id", F.expr(_BRIEFS).alias("brief"))
    return briefs.select(
        "doc_id",
        text.objective("brief").alias("objective"),
        text.grounding("brief").alias("grounding"),
        text.difficulty_mix("brief").alias("difficulty_mix"),
        text.batch_size("brief").alias("batch_size"),
    )


_FENCED = (
    "CASE doc_id % 4 WHEN 0 THEN 'Answer: ```json' || chr(10) || '{\"a\": {\"b\": 1}}' || chr(10) || '``` done ' || text "
    "WHEN 1 THEN 'so {\"x\": {\"y\": [1]}} and {2} ' || text WHEN 2 THEN 'list [1, [2]] end ' || translate(text, '{}[]`', '') "
    "ELSE translate(text, '{}[]`', '') END"
)


@query("extract_json_block", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"a": {"b": 1}}' WHEN 1 THEN '{"x": {"y": [1]}}' WHEN 2 THEN '[1, [2]]' END AS block
    FROM documents""")
def extract_json_block(spark: SparkSession, sf: str) -> DataFrame:
    from verdictframe.functions.jsonblock import extract_json_block as block

    return spread(table(spark, sf, "documents")).select("doc_id", block(F.expr(_FENCED)).alias("block"))


@query("run_status", """
    SELECT run_id, CASE WHEN run_id % 41 = 0 THEN 'BLOCKED' WHEN items_total <= 0 THEN 'FAIL' WHEN failures_total = 0 THEN 'PASS'
           WHEN eval_passed = 0 THEN 'FAIL' ELSE 'PARTIAL' END AS status FROM v_runs""", ("v_runs",))
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    runs = view(spark, sf, "v_runs").withColumn("blocked", F.col("run_id") % 41 == 0)
    return runs.select("run_id", decide.run_status("items_total", "eval_passed", "failures_total", "blocked").alias("status"))


@query("blast_radius", """
    WITH n AS (SELECT run_id, error_type, count(*) AS n FROM v_run_clusters GROUP BY ALL),
    t AS (SELECT n.run_id, error_type, n, CASE WHEN items_total <= 0 THEN 'unknown'
          WHEN n / items_total >= 0.3 OR n >= 10 THEN 'high' WHEN n / items_total >= 0.1 OR n >= 3 THEN 'medium'
          ELSE 'low' END AS tier FROM n JOIN v_runs USING (run_id))
    SELECT run_id, error_type, tier, CASE tier WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority,
           tier || ' (' || n || ' items in run)' AS radius FROM t""", ("v_runs", "v_run_clusters"))
def blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    counts = view(spark, sf, "v_run_clusters").groupBy("run_id", "error_type").agg(F.count("*").alias("n"))
    joined = counts.join(view(spark, sf, "v_runs").select("run_id", "items_total"), "run_id")
    tier = decide.blast_tier("n", "items_total")
    return joined.select(
        "run_id", "error_type", tier.alias("tier"), decide.blast_priority(tier).alias("priority"),
        F.concat(tier, F.lit(" ("), "n", F.lit(" items in run)")).alias("radius"),
    )


@query("cluster_id", """
    SELECT idx, error_type || CASE WHEN evidence_code <> '' THEN '/' || evidence_code ELSE '' END
           || CASE WHEN idx % 5 = 0 THEN '' ELSE '|' || task_type || '|' || eval_method END AS cluster_id
    FROM v_results WHERE verdict = 'fail'""", ("v_results",))
def cluster_id(spark: SparkSession, sf: str) -> DataFrame:
    failed = view(spark, sf, "v_results").where("verdict = 'fail'")
    blank = F.col("idx") % 5 == 0
    return failed.select(
        "idx",
        decide.cluster_id("error_type", "evidence_code", F.when(blank, "").otherwise(F.col("task_type")),
                          F.when(blank, "").otherwise(F.col("eval_method"))).alias("cluster_id"),
    )


_CAUSE_CASES = [
    ("PROGRAMMATIC_CHECK_FAILED", "STRUCTURED_FIELD_VALUE_MISMATCH", "json_extract_structured", 0),
    ("PROGRAMMATIC_CHECK_FAILED", "STRUCTURED_FIELD_MISSING", "json_extract_structured", 1),
    ("PROGRAMMATIC_CHECK_FAILED", "STRUCTURED_EXTRA_FIELD_PRESENT", "json_extract_structured", 2),
    ("EVAL_METHOD_UNSUPPORTED", "UNKNOWN_CHECKER", "json_math_add", 3),
    ("MODEL_OUTPUT_NOT_JSON", "", "json_math_add", 4),
    ("MODEL_OUTPUT_SCHEMA_VIOLATION", "TOOL_ARGS_SCHEMA_FAILED", "json_math_add", 4),
    ("TRAJECTORY_CHECK_FAILED", "TOOL_ARGS_SCHEMA_FAILED", "trajectory_email_then_answer", 5),
    ("TRAJECTORY_CHECK_FAILED", "TOOL_BINDING_MISSING_TOOL", "trajectory_email_then_answer", 6),
    ("EXACT_MATCH_FAILED", "EXACT_MATCH_FAILED", "json_extract_email", 7),
    ("TRAJECTORY_CHECK_FAILED", "TOOL_SEQUENCE_MISSING", "trajectory_email_then_answer", 8),
    ("RUBRIC_JUDGE_FAILED", "", "free_form", 9),
    ("PROGRAMMATIC_CHECK_FAILED", "STRUCTURED_FIELD_MISSING", "json_math_add", 10),
    ("SUT_HTTP_ERROR", "", "json_math_add", 11),
    ("TRAJECTORY_CHECK_FAILED", "", "trajectory_email_then_answer", 11),
]


def _cause_pick(column: int, key: str = "event_id") -> str:
    arms = " ".join(f"WHEN {i} THEN {sql_text(c[column])}" for i, c in enumerate(_CAUSE_CASES))
    return f"CASE {key} % {len(_CAUSE_CASES)} {arms} END"


@query("root_cause_rules", f"""
    WITH leaf(id, leaf) AS (VALUES {", ".join(f"({i}, {c[3]})" for i, c in enumerate(_CAUSE_CASES))}),
    rule(leaf, root_cause, owner, next_action) AS (VALUES {", ".join(
        f"({i}, {sql_text(r[1])}, {sql_text(r[2])}, {sql_text(r[3])})" for i, r in enumerate(rules.ROOT_CAUSES))})
    SELECT event_id, root_cause, owner, next_action FROM events
    JOIN leaf ON event_id % {len(_CAUSE_CASES)} = id JOIN rule USING (leaf)""")
def root_cause_rules(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "events").select("event_id", *[F.expr(_cause_pick(i)).alias(c) for i, c in enumerate("ect")])
    return cases.select("event_id", decide.root_cause("e", "c", "t").alias("r")).select("event_id", "r.*")


_ERRORS = list(rules.OWNER_BY_ERROR) + ["RUBRIC_JUDGE_FAILED"]
_ERROR_PICK = "CASE " + " ".join(f"WHEN event_id % {len(_ERRORS)} = {i} THEN {sql_text(e)}" for i, e in enumerate(_ERRORS)) + " END"


@query("owner_lookup", f"""
    WITH o(error_type, owner, action) AS (VALUES {", ".join(
        f"({sql_text(k)}, {sql_text(v[0])}, {sql_text(v[1])})" for k, v in rules.OWNER_BY_ERROR.items())}),
    e AS (SELECT event_id, {_ERROR_PICK} AS error_type FROM events)
    SELECT event_id, coalesce(owner, {sql_text(rules.DEFAULT_OWNER[0])}) AS owner,
           coalesce(action, {sql_text(rules.DEFAULT_OWNER[1])}) AS action FROM e LEFT JOIN o USING (error_type)""")
def owner_lookup(spark: SparkSession, sf: str) -> DataFrame:
    errors = table(spark, sf, "events").select("event_id", F.expr(_ERROR_PICK).alias("error_type"))
    return errors.select(
        "event_id", decide.default_owner("error_type").alias("owner"), decide.default_action("error_type").alias("action")
    )


@query("judge_prompts", f"""
    SELECT idx, sha256('# Rubric judge (prompt_version=v1, rubric_schema_version=v1)' || chr(10) || chr(10) || '## Task' || chr(10)
        || '- task_type: ' || task_type || chr(10) || '- raw_prompt: ' || prompt || chr(10) || chr(10)
        || '## Evidence requirements (you must cite these rule-by-rule)' || chr(10) || coalesce(evidence_requirements, '{{}}')
        || chr(10) || chr(10) || '## Model output to evaluate (parsed)' || chr(10) || '{{"answer":' || idx || '}}' || chr(10)
        || chr(10) || '## Instructions' || chr(10) || {sql_text(rubric.JUDGE_INSTRUCTIONS)}) AS prompt_digest
    FROM v_items""", ("v_items",))
def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    output = F.to_json(F.struct(F.col("idx").alias("answer")))
    prompt = rubric.judge_prompt(
        "task_type", "prompt", F.coalesce("evidence_requirements", F.lit("{}")), output, F.lit("v1")
    )
    return view(spark, sf, "v_items").select("idx", F.sha2(prompt, 256).alias("prompt_digest"))


@query("arbiter_prompts", f"""
    SELECT item_id, sha256('# Arbiter (rubric_schema_version=v1)' || chr(10) || chr(10) || '## Task' || chr(10) || '- task_type: open_rubric' || chr(10)
        || '- You are resolving disagreement between two judges. Your output must cite rule-by-rule evidence.' || chr(10) || chr(10)
        || '## Evidence requirements' || chr(10) || coalesce(evidence_requirements, '{{}}') || chr(10) || chr(10)
        || '## Judge 1' || chr(10) || '{{"verdict":"' || verdict_1 || '","score":' || score_1 || ',"reason":"length ' || n_chars || '","evidence":[{{"rule":"reasoning","observation":"' || verdict_1 || '"}}]}}' || chr(10) || chr(10)
        || '## Judge 2' || chr(10) || '{{"verdict":"' || verdict_2 || '","score":' || score_2 || ',"reason":"length ' || n_chars || '","evidence":[{{"rule":"reasoning","observation":"' || verdict_2 || '"}}]}}' || chr(10) || chr(10)
        || '## Model output' || chr(10) || '{{"n_chars":' || n_chars || '}}' || chr(10) || chr(10)
        || '## Instructions' || chr(10) || {sql_text(rubric.ARBITER_INSTRUCTIONS)}) AS prompt_digest
    FROM v_judges WHERE verdict_1 <> verdict_2""", ("v_judges",))
def arbiter_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """What the arbiter is asked where the two judges disagree."""

    def judge(n: int) -> Column:
        verdict = F.col(f"verdict_{n}")
        cited = F.array(F.struct(F.lit("reasoning").alias("rule"), verdict.alias("observation")))
        reason = F.concat(F.lit("length "), F.col("n_chars").cast("string"))
        return F.struct(verdict.alias("verdict"), F.col(f"score_{n}").alias("score"), reason.alias("reason"), cited.alias("evidence"))

    prompt = rubric.arbiter_prompt(
        F.lit("open_rubric"), F.coalesce("evidence_requirements", F.lit("{}")), judge(1), judge(2), F.to_json(F.struct("n_chars")), F.lit("v1")
    )
    return view(spark, sf, "v_judges").where("verdict_1 <> verdict_2").select("item_id", F.sha2(prompt, 256).alias("prompt_digest"))


@query("iso_to_millis", """
    SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS ms FROM events""")
def iso_to_millis(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    iso = (
        F.when(F.col("event_id") % 10 == 0, "not a time")
        .when(F.col("event_id") % 10 == 1, F.concat(stamp, F.lit("+00:00")))
        .otherwise(F.concat(stamp, F.lit("Z")))
    )
    return table(spark, sf, "events").select("event_id", text.iso_to_millis(iso).alias("ms"))

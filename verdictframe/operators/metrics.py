"""Run metrics: slice pass rates, latency, counts and gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.functions import rules
from verdictframe.operators.ordered import attach
from verdictframe.session import materialize


def latest_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key. ``max_by`` keeps one row per key on the map side, however many there are."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*key, "_row.*")


def join_results(results: DataFrame, items: DataFrame, oracles: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Results with their item and oracle; results without both are dropped.

    With ``order`` an item or oracle may come more than once: its last row in that order counts.
    """
    if order:
        items, oracles = (latest_by_key(df, ["item_id"], order).drop(*order) for df in (items, oracles))
    return results.join(items, "item_id").join(oracles, "item_id")


def _rates(*by: str) -> list[Column]:
    n, passed = F.count("*"), F.count_if(F.col("verdict") == "pass")
    return [n.alias("n"), passed.alias("n_pass"), F.round(passed / n, 4).alias("pass_rate")]


def slice_by(joined: DataFrame, column: str) -> DataFrame:
    return joined.groupBy(F.col(column).alias("slice_value")).agg(*_rates())


def slice_by_tag(joined: DataFrame, tags: str = "domain_tags") -> DataFrame:
    """A row counts once under each of its tags."""
    return joined.select("verdict", F.explode(tags).alias("slice_value")).groupBy("slice_value").agg(*_rates())


def slice_all(joined: DataFrame, columns: Sequence[str], tags: str = "domain_tags") -> DataFrame:
    """All slices as one long table in a single pass: every row is expanded to its (slice, value) pairs."""
    pairs = F.concat(
        F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).alias("slice_value")) for c in columns]),
        F.transform(F.col(tags), lambda t: F.struct(F.lit(tags).alias("slice"), t.alias("slice_value"))),
    )
    return joined.select("verdict", F.inline(pairs)).groupBy("slice", "slice_value").agg(*_rates())


#: Groups of more distinct values are searched by parts, of which each holds about a thousandth of them.
LARGE_GROUP = 1_000_000
PARTS, STEP = 1024, 32
SHARES = {"p50": 0.5, "p90": 0.9}


def latency_percentiles(
    results: DataFrame, by: Sequence[str] = (), latency: str = "latency_ms", rounding: str = "trunc", large: int = LARGE_GROUP
) -> DataFrame:
    """p50 and p90 by linear interpolation, truncated or rounded half to even; null without samples.

    Equal latencies are counted first. A group of up to ``large`` distinct ones is one percentile aggregate, whose state is an
    entry per distinct value; a larger group is searched by parts, so no task gets all its values. Both are exact.
    """
    group = F.struct(F.lit(0).alias("all"), *by).alias("_g")
    counted = results.where(F.col(latency).isNotNull()).groupBy(group, F.col(latency).alias("_v")).agg(F.count("*").alias("_n"))
    counted = materialize(counted, "latencies")
    sizes = counted.groupBy("_g").agg(F.count("*").alias("_d"), F.sum("_n").alias("_total")).where(F.col("_d") > large)
    # at most one row for each `large` rows
    sizes = materialize(sizes, "large")
    small = counted.join(F.broadcast(sizes), "_g", "left_anti").groupBy("_g").agg(
        *[F.percentile("_v", p, F.col("_n")).alias(name) for name, p in SHARES.items()]
    )
    found = small.unionByName(_by_parts(counted, sizes)) if not sizes.isEmpty() else small
    if not by:  # a row also for no samples
        found = found.groupBy().agg(*[F.max(name).alias(name) for name in SHARES])
    cut = (lambda c: F.floor(c)) if rounding == "trunc" else (lambda c: F.bround(c, 0))
    return found.select(*[F.col("_g")[c].alias(c) for c in by], *[cut(F.col(name)).cast("bigint").alias(name) for name in SHARES])


def _by_parts(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """Exact percentiles of the groups in ``sizes``: a sketch cuts a group's values into parts, the parts are counted anew, and
    only those that hold a wanted rank are sorted."""
    mine = counted.join(F.broadcast(sizes.select("_g")), "_g", "left_semi")
    cuts = mine.groupBy("_g").agg(F.array_distinct(F.percentile_approx("_v", [i / PARTS for i in range(1, PARTS)], 16 * PARTS)).alias("_cuts"))
    heads = F.filter("_cuts", lambda c, i: i % STEP == 0)
    placed = attach(mine, sizes.join(cuts, "_g").withColumn("_heads", heads), ["_g"], "_v", "_d")
    row = F.greatest(F.size(F.filter("_heads", lambda c: c <= F.col("_v"))) - 1, F.lit(0)) * STEP
    inside = F.size(F.filter(F.slice("_cuts", F.col("_row") + 1, STEP), lambda c: c <= F.col("_v")))
    placed = placed.withColumn("_row", row).select("_g", "_v", "_n", "_total", (F.col("_row") + inside).alias("_part"))
    placed = materialize(placed, "placed")

    order = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("_rows").over(order)
    parts = placed.groupBy("_g", "_total", "_part").agg(F.sum("_n").alias("_rows")).withColumn("_before", upto - F.col("_rows"))
    at = {name: F.lit(p) * (F.col("_total") - 1) for name, p in SHARES.items()}
    ranks = [end(at[name]) for name in SHARES for end in (F.floor, F.ceil)]
    holds = lambda rank, before, n: (before <= rank) & (rank < before + n)
    hit = reduce(or_, [holds(r, F.col("_before"), F.col("_rows")) for r in ranks])
    # at most four rows a group
    chosen = parts.where(hit).select("_g", "_part", "_before")
    values = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = placed.join(F.broadcast(chosen), ["_g", "_part"]).withColumn("_at", F.col("_before") + F.sum("_n").over(values) - F.col("_n"))
    picked = exact.groupBy("_g", "_total").agg(
        *[F.max(F.when(holds(r, F.col("_at"), F.col("_n")), F.col("_v").cast("double"))).alias(f"_r{i}") for i, r in enumerate(ranks)]
    )

    def between(i: int, name: str) -> Column:
        low, high, x = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}"), at[name]
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    return picked.select("_g", *[between(i, name).alias(name) for i, name in enumerate(SHARES)])


def run_metrics(results: DataFrame, by: Sequence[str] = (), log: DataFrame | None = None) -> DataFrame:
    """Items, passes and failures of each run; with the event ``log`` also attempts, failed gates and aborted items (0 without events).

    Runs that are in the log alone have no results and are left out.
    """
    counted = results.groupBy(*by).agg(
        F.count("*").alias("items_total"),
        F.count_if(F.col("verdict") == "pass").alias("eval_passed"),
        F.count_if(F.col("verdict") == "fail").alias("failures_total"),
    )
    if log is None:
        return counted
    added = ("attempted", "qa_failed", "aborted")
    seen = qa_throughput(log, by).select(*by, *added)
    both = counted.join(seen, list(by), "left") if by else counted.join(seen, F.lit(True))  # one row each
    return both.withColumns({name: F.coalesce(name, F.lit(0).cast("bigint")) for name in added})


def qa_throughput(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attempted and evaluated items, failed gates and aborted items. An overfull slot ends without counting as aborted."""
    stage, status = F.col("stage"), F.col("status")
    return events.groupBy(*by).agg(
        F.count_if((stage == "GENERATE_ITEM") & (status == "start")).alias("attempted"),
        F.count_if((stage == "VERIFY") & (status == "ok")).alias("evaluated"),
        F.count_if((stage == "QA_GATE") & (status == "fail")).alias("qa_failed"),
        F.count_if((stage == "QA_GATE") & (status == "fail") & (F.col("failure_code") != "DISTRIBUTION_MISMATCH")).alias("aborted"),
    )


def model_versions(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct versions of a run; the single one, or ``mixed``."""
    seen = results.select(*by, "model_version").distinct().groupBy(*by).agg(
        F.sort_array(F.collect_list("model_version")).alias("versions")
    )
    return seen.select(
        *by,
        F.array_join("versions", ",").alias("model_versions"),
        F.when(F.size("versions") == 1, F.get("versions", 0)).otherwise("mixed").alias("model_version"),
    )


def regression_gate(
    results: DataFrame,
    by: Sequence[str] = (),
    min_pass_rate: float = rules.MIN_PASS_RATE,
    critical: Sequence[str] = rules.CRITICAL_FAILURE_CODES,
) -> DataFrame:
    """Gate: pass rate at least the minimum and no critical failure. An empty suite fails with rate 0."""
    n = F.count("*")
    hits = F.count_if(F.col("error_type").isin(*critical))
    rate = F.when(n > 0, F.count_if(F.col("verdict") == "pass") / n).otherwise(0.0)
    return results.groupBy(*by).agg(
        n.alias("n"),
        F.round(rate, 6).alias("pass_rate"),
        hits.alias("critical_hits"),
        ((rate >= min_pass_rate) & (hits == 0) & (n > 0)).alias("passed"),
    )


def critical_codes(results: DataFrame, by: Sequence[str] = (), critical: Sequence[str] = rules.CRITICAL_FAILURE_CODES) -> DataFrame:
    """Critical codes that occurred."""
    return results.where(F.col("error_type").isin(*critical)).select(*by, "error_type").distinct()


def duplicate_audit(items: DataFrame, fp: str = "fp") -> DataFrame:
    return items.agg(F.count("*").alias("n"), F.count_distinct(fp).alias("n_distinct")).withColumn(
        "n_duplicates", F.col("n") - F.col("n_distinct")
    )


def data_card(items: DataFrame, name: str, version: str, tag: str = "domain_tag") -> DataFrame:
    per_tag = items.groupBy(tag).agg(F.count("*").alias("n"))
    return per_tag.agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list(tag)), ", ").alias("tags")).select(
        F.lit(name).alias("dataset_name"),
        F.lit(version).alias("dataset_spec_version"),
        F.concat(F.col("n"), F.lit(" synthetic items across domains ["), F.col("tags"), F.lit("].")).alias("composition"),
    )

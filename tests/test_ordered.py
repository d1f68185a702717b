"""Running values over blocks against plain loops, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from verdictframe.operators import ordered


def skewed(n, seed=7):
    rng = random.Random(seed)
    ids = list(range(n))
    rng.shuffle(ids)
    return [(i, "hot" if rng.random() < 0.6 else rng.choice("abcd"), rng.randint(0, 5)) for i in ids]


@pytest.mark.parametrize("rows_per_block", [7, 1 << 20])
def test_rank_and_sum_by_id_blocks(spark, rows_per_block):
    rows = skewed(500)
    df = spark.createDataFrame(rows, "id bigint, g string, v bigint")
    blocked = ordered.id_blocks(df, "id", rows_per_block)
    got = {r["id"]: (r["rank"], r["total"]) for r in ordered.running_sums(
        blocked, ["g"], ["id"], {"rank": F.lit(1).cast("bigint"), "total": F.col("v")}).collect()}
    seen, want = {}, {}
    for i, g, v in sorted(rows):
        n, t = seen.get(g, (0, 0))
        seen[g] = want[i] = (n + 1, t + v)
    assert got == want


@pytest.mark.parametrize("blocks", [1, 5])
def test_range_blocks_with_ties(spark, blocks):
    rows = [(i, "hot", i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, g string, at bigint")
    blocked = ordered.range_blocks(df, ["g"], ["at", "id"], blocks)
    assert blocked.select("_block").distinct().count() <= blocks
    got = {r["id"]: r["rank"] for r in ordered.running_rank(blocked, ["g"], ["at", "id"]).collect()}
    want = {i: k + 1 for k, (_, i) in enumerate(sorted((at, i) for i, _, at in rows))}
    assert got == want


@pytest.mark.parametrize("blocks", [1, 6])
def test_previous_row(spark, blocks):
    rows = skewed(300, 3)
    df = spark.createDataFrame(rows, "id bigint, g string, v bigint")
    got = {r["id"]: r["previous"]["id"] if r["previous"] else None for r in ordered.previous_row(
        ordered.range_blocks(df, ["g"], ["id"], blocks), ["g"], ["id"], ["id", "v"]).collect()}
    last, want = {}, {}
    for i, g, _ in sorted(rows):
        want[i] = last.get(g)
        last[g] = i
    assert got == want


def test_previous_row_without_groups_and_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id bigint, g string")
    whole = ordered.previous_row(ordered.range_blocks(df, [], ["id"], 3), [], ["id"], ["id"])
    assert [r["previous"]["id"] if r["previous"] else None for r in whole.orderBy("id").collect()] == [None, 1, 2]
    grouped = ordered.running_rank(ordered.range_blocks(df, ["g"], ["id"], 3), ["g"], ["id"])
    assert [r["rank"] for r in grouped.orderBy("id").collect()] == [1, 2, 1]


@pytest.mark.parametrize("hot_rows", [20, 50])
def test_attach_keeps_every_row(spark, hot_rows):
    rows = [(i, "hot" if i % 3 else f"k{i % 30}") for i in range(900)] + [(900, "none")]
    df = spark.createDataFrame(rows, "id bigint, k string")
    lookup = df.where("k <> 'none'").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = ordered.attach(df, lookup, ["k"], "id", "n", hot_rows=hot_rows).collect()
    first = {}
    for i, k in rows:
        first.setdefault(k, i)
    first["none"] = None
    assert sorted((r["id"], r["k"]) for r in got) == sorted(rows)
    assert all(r["first"] == first[r["k"]] for r in got)


def test_ids_far_apart_do_not_give_a_block_each(spark):
    rows = [(i << 40, "hot" if i % 3 else "cold") for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, g string")
    assert ordered.id_blocks(df, "id").select("_block").distinct().count() == 1
    blocked = ordered.id_blocks(df, "id", 100)
    assert blocked.select("_block").distinct().count() == 10
    got = {r["id"]: r["rank"] for r in ordered.running_rank(blocked, ["g"], ["id"]).collect()}
    seen = {}
    for i, g in rows:
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == seen[g]


def test_blocks_of_ids_that_lie_unevenly(spark):
    """A dense run of ids, one id far away, ids that double: no block has more than twice the mean."""
    dense = spark.range(1_000_000).select("id")
    ids = dense.unionByName(spark.createDataFrame([(1 << 62,), (-(1 << 40),), *[((1 << 30) + (1 << k),) for k in range(21, 60)]], "id bigint"))
    sizes = [r["count"] for r in ordered.id_blocks(ids, "id", 50_000).groupBy("_block").count().collect()]
    assert 20 <= len(sizes) <= 22
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    order = ordered.id_blocks(ids, "id", 50_000).groupBy("_block").agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("_block").collect()
    assert all(a["high"] < b["low"] for a, b in zip(order, order[1:], strict=False))


def test_more_blocks_than_one_sketch_has_quantiles(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CUTS", 8)
    monkeypatch.setattr(ordered, "PRECISION", 1000)
    ids = spark.range(3000).select((F.col("id") * F.col("id")).alias("id"))
    blocked = ordered.id_blocks(ids, "id", 50)
    sizes = [r["count"] for r in blocked.groupBy("_block").count().collect()]
    assert len(sizes) >= 55
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    ranks = {r["id"]: r["rank"] for r in ordered.running_rank(blocked, [], ["id"]).collect()}
    assert ranks == {k * k: k + 1 for k in range(3000)}


def test_blocks_of_nothing(spark):
    assert ordered.id_blocks(spark.range(0), "id", 5).count() == 0

"""Releases that are visible as a whole or not at all, and merges that leave other files alone."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from verdictframe.sources import stored


def tables(spark, runs, lost=False, null=False):
    results = [(r, f"i{r}{k}", None if null and k == 1 else "pass") for r in runs for k in range(4)]
    items = [(r, i) for r, i, _ in results if not (lost and i.endswith("3"))]
    return {
        "results": spark.createDataFrame(results, "run_id bigint, item_id string, verdict string"),
        "items": spark.createDataFrame(items, "run_id bigint, item_id string"),
    }


def release(folder, given):
    stored.package_release(given, folder, required={"results": ["verdict"]}, references=[("results", "items", ["run_id", "item_id"])])


def seen(spark, folder, given, name="results"):
    schema = stored.release_schema(given[name], "run_id")
    return sorted(tuple(r) for r in stored.read_release(spark, folder, name, schema).select(given[name].columns).collect())


def test_releases_add_up_and_broken_ones_are_not_seen(spark, tmp_path):
    folder = str(tmp_path / "release")
    one, two = tables(spark, [1, 2]), tables(spark, [3])
    assert seen(spark, folder, one) == []
    release(folder, one)
    before = seen(spark, folder, one)
    assert before == sorted(tuple(r) for r in one["results"].collect())
    with pytest.raises(stored.BrokenRelease, match=r"results: not in items \(1 rows\)"):
        release(folder, tables(spark, [4], lost=True))
    with pytest.raises(stored.BrokenRelease, match=r"results: incomplete \(2 rows\)"):
        release(folder, tables(spark, [5, 6], null=True))
    assert seen(spark, folder, one) == before
    release(folder, two)
    assert seen(spark, folder, one) == sorted(before + [tuple(r) for r in two["results"].collect()])


def test_two_writers_of_one_version_do_not_both_win(spark, tmp_path):
    folder = str(tmp_path / "release")
    stored._list(spark, folder, 1, {"a": "x"})
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        stored._list(spark, folder, 1, {"a": "y"})
    assert stored._listed(spark, folder) == (1, {"a": "x"})


def test_upsert_equals_a_loop_and_leaves_other_files_alone(spark, tmp_path):
    folder, draw, want = str(tmp_path / "runs"), random.Random(3), {}
    schema = "run_id bigint, seq bigint, value string"
    for arrival in range(4):
        rows = [(draw.randrange(200) if arrival < 3 else 7, 100 * draw.randrange(50) + arrival, f"v{arrival}.{k}") for k in range(120 if arrival < 3 else 3)]
        rows = list({(r, s): (r, s, v) for r, s, v in rows}.values())
        for r, s, v in rows:
            if r not in want or want[r][0] < s:
                want[r] = (s, v)
        files = {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}
        before = stored._listed(spark, folder)[1]
        touched = stored.upsert(folder, spark.createDataFrame(rows, schema), ["run_id"], ["seq"], buckets=16)
        now = stored._listed(spark, folder)[1]
        assert {b for b in now if now[b] != before.get(b)} == set(touched)
        assert all(p.stat().st_mtime_ns == t for p, t in files.items())
        table = stored.read_upserted(spark, folder, spark.createDataFrame([], schema).schema)
        assert {r["run_id"]: (r["seq"], r["value"]) for r in table.collect()} == want
    assert len(touched) == 1
    assert stored.upsert(folder, spark.createDataFrame([], schema), ["run_id"], ["seq"], buckets=16) == []
    assert table.select(F.count("*")).first()[0] == len(want)

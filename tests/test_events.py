"""Event pairing and run flags against loops."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest

from verdictframe.operators import events
from verdictframe.streaming import live

START = datetime(2024, 1, 1)


def make_log(n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        run = 1 if rng.random() < 0.6 else rng.randint(2, 5)
        status = rng.choice(["start", "start", "ok", "fail"])
        code = rng.choice(["A", "B", ""]) if status == "fail" else ""
        rows.append((i, run, rng.choice(["VERIFY", "QA_GATE"]), status, START + timedelta(seconds=rng.randint(0, 300)), code))
    return rows


DDL = "event_id bigint, run_id bigint, stage string, status string, ts timestamp, failure_code string"


def loop_pairs(rows):
    open_starts, pairs = defaultdict(deque), set()
    for i, run, stage, status, ts, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        queue = open_starts[run, stage]
        if status == "start":
            queue.append((i, ts))
        elif queue:
            first, began = queue.popleft()
            pairs.add((run, stage, first, i, int((ts - began).total_seconds() * 1_000_000)))
    return pairs


@pytest.mark.parametrize("blocks", [1, 4, 9])
def test_fifo_pairs(spark, blocks):
    for seed in (1, 2):
        rows = make_log(seed=seed)
        got = events.fifo_durations(spark.createDataFrame(rows, DDL), blocks=blocks).collect()
        assert {(r["run_id"], r["stage"], r["start_id"], r["end_id"], r["duration_us"]) for r in got} == loop_pairs(rows)


def test_end_before_any_start_is_dropped(spark):
    rows = [(0, 1, "VERIFY", "ok", START, ""), (1, 1, "VERIFY", "start", START + timedelta(seconds=1), ""),
            (2, 1, "VERIFY", "ok", START + timedelta(seconds=3), ""), (3, 1, "VERIFY", "ok", START + timedelta(seconds=4), "")]
    got = events.fifo_durations(spark.createDataFrame(rows, DDL)).collect()
    assert [(r["start_id"], r["end_id"], r["duration_us"]) for r in got] == [(1, 2, 2_000_000)]


def test_stage_metrics(spark):
    rows = [
        (0, 1, "INIT", "ok", START, ""),
        (1, 1, "VERIFY", "start", START, ""),
        (2, 1, "VERIFY", "fail", START + timedelta(milliseconds=250), "B"),
        (3, 1, "VERIFY", "fail", START + timedelta(seconds=1), "A"),
        (4, 1, "VERIFY", "fail", None, "A"),
    ]
    found = {r["stage"]: r for r in events.stage_metrics(spark.createDataFrame(rows, DDL)).collect()}
    assert len(found) == 9 and "DATA_REQUESTS" not in found
    assert found["INIT"]["input_count"] == 1  # a stage of the run counts one input
    verify = found["VERIFY"]
    assert (verify["input_count"], verify["fail_count"], verify["avg_latency_ms"]) == (1, 2, 250.0)
    assert found["PLAN"]["input_count"] == 0 and found["PLAN"]["avg_latency_ms"] is None


def test_top_code_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, "x", "B"), (2, "x", "A"), (3, "x", "A"), (4, "x", "B"), (5, "y", "")], "i bigint, k string, c string")
    assert [(r["k"], r["top_failure_code"]) for r in events.top_code(df, ["k"], "c", "i").collect()] == [("x", "B")]


def test_blocked_runs(spark):
    rows = [(1, 1, "QA_GATE", "fail", START, "X"), (2, 2, "QA_GATE", "fail", START, "X"), (3, 2, "VERIFY", "ok", START, "")]
    got = {r["run_id"]: r["blocked"] for r in events.run_flags(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {1: True, 2: False}


def test_streams_over_several_batches_equal_one_batch(spark, tmp_path):
    rows = sorted(make_log(240, 9), key=lambda r: (r[4], r[0]))
    folder = str(tmp_path / "log")
    for part in range(4):
        chunk = [r for k, r in enumerate(rows) if k * 4 // len(rows) == part]
        spark.createDataFrame(chunk, DDL).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema

    def stream():
        return live.read_stream(spark, folder, schema, files_per_trigger=1)

    pairs = live.fifo_stream(stream()).collect()
    assert {(r["run_id"], r["stage"], r["start_id"], r["end_id"], r["duration_us"]) for r in pairs} == loop_pairs(rows)

    whole = spark.createDataFrame(rows, DDL)
    counted = live.run_to_table(live.stage_counters(stream()), "update", ["run_id", "stage"])
    assert {tuple(r) for r in counted.select("run_id", "stage", "starts", "ok", "fail").collect()} == {
        tuple(r) for r in live.stage_counters(whole).collect()
    }
    kept = live.run_to_table(live.first_seen(stream().select("run_id", "event_id"), "run_id", "event_id"), "update", ["run_id"]).collect()
    first = {}
    for r in rows:
        first[r[1]] = min(first.get(r[1], 1 << 30), r[0])
    assert {r["run_id"]: r["event_id"] for r in kept} == first


def write_log(spark, folder, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(folder)


def pairs_of(spark, log, folder, **more):
    found = live.fifo_stream(live.read_stream(spark, log, spark.read.parquet(log).schema, files_per_trigger=1), folder=folder, **more)
    return sorted(((r["run_id"], r["k"], r["start_id"], r["end_id"], r["late"]) for r in found.collect()), key=str)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_state_of_closed_windows_is_dropped(spark, tmp_path):
    """Results over windows equal those of the whole log; at the end the state holds the open windows alone."""
    log, day = str(tmp_path / "log"), 86_400
    rows = [(100 * d + k, k % 20, "VERIFY", ("start", "ok", "fail")[k % 3], at(d * day + k), "") for d in range(5) for k in range(60)]
    for d in range(5):
        write_log(spark, log, rows[60 * d : 60 * d + 60])
    whole = spark.createDataFrame(rows, DDL)

    def stream():
        return live.read_stream(spark, log, spark.read.parquet(log).schema, files_per_trigger=1)

    report = {}
    counts = live.run_to_table(live.stage_counters(stream(), width="1 hour"), "update", ["run_id", "stage", live.WINDOW], report=report)
    assert {tuple(r) for r in live.merge_counters(counts).collect()} == {tuple(r) for r in live.stage_counters(whole).collect()}
    assert report == {"state_rows": 20, "late_rows": 0}
    latest = live.run_to_table(live.progress(stream(), width="1 hour"), "update", ["run_id", live.WINDOW], report=report)
    assert {tuple(r) for r in live.merge_progress(latest).collect()} == {tuple(r) for r in live.progress(whole).collect()}
    assert report["state_rows"] == 20
    seen = live.first_seen(stream().select("run_id", "event_id", "ts"), "run_id", "event_id", width="1 hour")
    first = live.merge_first_seen(live.run_to_table(seen, "update", ["run_id", live.WINDOW], report=report), "run_id", "event_id")
    assert {(r["run_id"], r["event_id"]) for r in first.collect()} == {(k, k) for k in range(20)} and report["state_rows"] == 20


def test_rows_too_late_are_counted(spark, tmp_path):
    """The engine goes by the watermark of one batch earlier: a row is too late from the second batch on."""
    log = str(tmp_path / "log")
    write_log(spark, log, [(1, 1, "VERIFY", "start", at(0), ""), (2, 1, "VERIFY", "ok", at(86_400), "")])
    write_log(spark, log, [(5, 3, "GENERATE_ITEM", "start", at(86_400), "")])
    write_log(spark, log, [(3, 2, "VERIFY", "start", at(5), ""), (4, 1, "VERIFY", "ok", at(86_300), "")])
    report = {}
    stream = live.read_stream(spark, log, spark.read.parquet(log).schema, files_per_trigger=1)
    counts = live.run_to_table(live.stage_counters(stream, width="1 hour"), "update", ["run_id", "stage", live.WINDOW], report=report)
    assert [tuple(r) for r in live.merge_counters(counts).collect() if r["run_id"] != 3] == [(1, "VERIFY", 1, 2, 0)]
    assert report["late_rows"] == 1


def test_pairing_goes_on_from_its_checkpoint(spark, tmp_path):
    """A second query on the same folder finds the starts that the first left open, and writes no pair again."""
    log, folder = str(tmp_path / "log"), str(tmp_path / "state")
    write_log(spark, log, [(1, 1, "VERIFY", "start", at(0), ""), (2, 1, "VERIFY", "start", at(1), ""), (3, 1, "VERIFY", "ok", at(2), "")])
    assert pairs_of(spark, log, folder) == [(1, 1, 1, 3, False)]
    write_log(spark, log, [(4, 1, "VERIFY", "fail", at(5), ""), (5, 1, "VERIFY", "ok", at(6), ""), (6, 2, "VERIFY", "ok", at(6), "")])
    assert pairs_of(spark, log, folder) == [(1, 1, 1, 3, False), (1, 2, 2, 4, False)]


def test_late_rows_are_given_out_without_a_pair(spark, tmp_path):
    """A row that its key has passed is marked late; one beyond the watermark is dropped by the engine."""
    log, folder = str(tmp_path / "log"), str(tmp_path / "state")
    write_log(spark, log, [(1, 1, "VERIFY", "start", at(0), ""), (2, 1, "VERIFY", "start", at(3600), "")])
    assert pairs_of(spark, log, folder) == []
    write_log(spark, log, [(3, 1, "VERIFY", "ok", at(3500), ""), (4, 1, "VERIFY", "ok", at(10), ""), (5, 1, "VERIFY", "ok", at(3700), "")])
    assert pairs_of(spark, log, folder) == [(1, 1, 1, 5, False), (1, None, None, 3, True)]


def test_keys_that_rest_are_forgotten(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "state")
    day = 86_400
    write_log(spark, log, [(1, 1, "VERIFY", "start", at(0), ""), (2, 2, "VERIFY", "start", at(0), "")])
    write_log(spark, log, [(3, 2, "VERIFY", "start", at(day), ""), (4, 3, "VERIFY", "start", at(3 * day), "")])
    assert pairs_of(spark, log, folder, expiry=timedelta(days=2)) == []
    write_log(spark, log, [(5, 1, "VERIFY", "ok", at(3 * day + 1), ""), (6, 2, "VERIFY", "ok", at(3 * day + 1), ""), (7, 3, "VERIFY", "ok", at(3 * day + 1), "")])
    found = pairs_of(spark, log, folder, expiry=timedelta(days=2))
    assert (3, 1, 4, 7, False) in found and not [r for r in found if r[0] == 1]


def test_keys_of_one_bucket_are_paired_and_forgotten_one_by_one(spark, tmp_path):
    """State is held by bucket, with keys as they are: null, beyond 2**53, quoted; a key at rest goes, its neighbours stay."""
    log, folder, day, large = str(tmp_path / "log"), str(tmp_path / "state"), 86_400, (1 << 53) + 1
    write_log(spark, log, [(1, None, "a", "start", at(0), ""), (2, large, 'b"', "start", at(1), ""), (3, large + 1, 'b"', "start", at(2), "")])
    write_log(spark, log, [(4, large, 'b"', "ok", at(day), ""), (5, None, "a", "start", at(day), ""), (6, 7, None, "start", at(3 * day), "")])
    assert pairs_of(spark, log, folder, expiry=timedelta(days=2), buckets=1) == [(large, 1, 2, 4, False)]
    write_log(spark, log, [(7, large + 1, 'b"', "ok", at(3 * day + 1), ""), (8, 7, None, "ok", at(3 * day + 1), "")])
    found = pairs_of(spark, log, folder, expiry=timedelta(days=2), buckets=1)
    assert sorted(found, key=str) == [(7, 1, 6, 8, False), (large, 1, 2, 4, False)]

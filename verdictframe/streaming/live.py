"""The event log as a stream: counters, progress, duplicate screening, durations, failure rate."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from verdictframe.operators.events import STAGE_KEY
from verdictframe.operators.metrics import latest_by_key
from verdictframe.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


#: How far event time may lag behind the newest row.
LATE = "10 minutes"


def _windows(events: DataFrame, width: str | None, late: str) -> tuple[DataFrame, list]:
    """Rows and the window to group them by. State of windows that the watermark has passed is dropped; what comes for them later
    is left out and counted. Rows without a time belong to no window."""
    if width is None:
        return events, []
    return events.withWatermark("ts", late), [F.window("ts", width).alias("_w")]


def _start(grouped: DataFrame) -> DataFrame:
    if "_w" not in grouped.columns:
        return grouped
    return grouped.select(*[c for c in grouped.columns if c != "_w"], F.col("_w.start").alias(WINDOW))


#: The column that tells the window of a partial result.
WINDOW = "window_start"


def stage_counters(events: DataFrame, key: Sequence[str] = STAGE_KEY, width: str | None = None, late: str = LATE) -> DataFrame:
    """Starts, good and failed ends of each stage; with ``width`` for each window of event time, see ``merge_counters``."""
    status = F.col("status")
    rows, window = _windows(events, width, late)
    return _start(rows.groupBy(*window, *key).agg(
        F.count_if(status == "start").alias("starts"),
        F.count_if(status == "ok").alias("ok"),
        F.count_if(status == "fail").alias("fail"),
    ))


def merge_counters(partial: DataFrame, key: Sequence[str] = STAGE_KEY) -> DataFrame:
    return partial.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("starts", "ok", "fail")])


def progress(events: DataFrame, width: str | None = None, late: str = LATE) -> DataFrame:
    """Latest stage and status of every run, and how many events it has written; with ``width`` for each window."""
    at = F.struct("ts", "event_id")
    last = F.struct("stage", "status", "event_id")
    rows, window = _windows(events, width, late)
    grouped = _start(rows.groupBy(*window, "run_id").agg(F.max_by(last, at).alias("_last"), F.count("*").alias("n_events")))
    return grouped.select("run_id", "_last.*", "n_events", *[c for c in grouped.columns if c == WINDOW])


def merge_progress(partial: DataFrame) -> DataFrame:
    """The run's last window has its last event."""
    last = F.max_by(F.struct("stage", "status", "event_id"), WINDOW).alias("_last")
    return partial.groupBy("run_id").agg(last, F.sum("n_events").alias("n_events")).select("run_id", "_last.*", "n_events")


def first_seen(items: DataFrame, fp: str, idx: str, width: str | None = None, late: str = LATE) -> DataFrame:
    """First row by ``idx`` of every fingerprint, over all batches.

    The engine's state holds one row for each fingerprint (with ``width``: of the windows that are open) and no batch reads
    history again. Copies inside a batch are combined before the shuffle, so a key that floods the stream is no hot task. Run it
    in update mode with the fingerprint (and the window) as the key.
    """
    rest = [c for c in items.columns if c != fp]
    rows, window = _windows(items, width, late)
    grouped = _start(rows.groupBy(*window, fp).agg(F.min_by(F.struct(*rest), idx).alias("_row")))
    return grouped.select(fp, "_row.*", *[c for c in grouped.columns if c == WINDOW])


def merge_first_seen(partial: DataFrame, fp: str, idx: str) -> DataFrame:
    rest = [c for c in partial.columns if c not in (fp, WINDOW)]
    return partial.groupBy(fp).agg(F.min_by(F.struct(*rest), idx).alias("_row")).select(fp, "_row.*")


def failure_rate(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Ended events and failures per window of event time."""
    ended = F.col("status").isin("ok", "fail")
    return (
        events.withWatermark("ts", late)
        .where(ended)
        .groupBy(F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("n_ended"), F.count_if(F.col("status") == "fail").alias("n_failed"))
        .select(F.col("w.start").alias("window_start"), "n_ended", "n_failed")
    )


def run_to_table(
    stream: DataFrame, mode: str, key: Sequence[str] | None = None, label: str = "stream", folder: str | None = None, report: dict | None = None
) -> DataFrame:
    """Run all available input through ``stream`` into a written table and read the result.

    In update mode each batch adds the rows it changed, and the last one per key counts. With a ``folder`` of an earlier run
    the stream goes on where that ended, also where it was broken off. ``report`` is told the rows that the state holds at the
    end, and the rows that were too late for it: rows as they reach the state, copies within a task's part of a batch
    already combined.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again replaces what it wrote before
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")

    seen = _drain(stream, write, mode, folder)
    if report is not None:
        report.update(state_rows=seen[-1][0] if seen else 0, late_rows=sum(late for _, late in seen))
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    rows = spark.read.schema(schema).option("basePath", f"{folder}/data").parquet(f"{folder}/data")
    if key is None:
        return rows.drop("batch")
    return latest_by_key(rows, key, ["batch"]).drop("batch")


#: Settings of a run. The state store spills to disk and is kept in the checkpoint as changes; what is told of each batch is kept
#: for so many of them.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.numRecentProgressUpdates": "10000",
}


def _drain(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, folder: str) -> list[tuple[int, int]]:
    """Runs the stream; rows in its state after each batch, and rows that came too late in it."""
    spark = stream.sparkSession
    before = {name: spark.conf.get(name) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    batches = [batch.stateOperators for batch in query.recentProgress]
    return [(sum(s.numRowsTotal for s in states), sum(s.numRowsDroppedByWatermark for s in states)) for states in batches]


class Pairing(StatefulProcessor):
    """Pairs ends with open starts, first in, first out, for the keys of one bucket; its state is what came last of each key and the
    queues of open starts.

    A row that comes in a later batch but lies before what its key has seen is late: it is not paired but given out with ``late``
    set. A key that rests for ``expiry`` of event time is forgotten with its open starts. Calls into the state cost far more than
    rows, so a bucket's state is read once and written once in a batch, however many keys it has.
    """

    def __init__(self, expiry_ms: int) -> None:
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "key string, at long, event_id long")
        self.last = handle.getListState("last", "key string, at long, event_id long, k long")
        self.timer = handle.getValueState("timer", "due long")

    def _read(self) -> tuple[dict, dict]:
        """What came last of each key, and its open starts in order."""
        last = {key: tuple(seen) for key, *seen in self.last.get()} if self.last.exists() else {}
        queues: dict[str, deque] = {}
        if self.open.exists():
            for key, at, event in self.open.get():
                queues.setdefault(key, deque()).append((at, event))
        return last, queues

    def _write(self, last: dict, queues: dict, fired: int | None = None) -> None:
        for state, rows in (
            (self.last, [(key, *seen) for key, seen in last.items()]),
            (self.open, [(key, *start) for key, queue in queues.items() for start in queue]),
        ):
            state.put(rows) if rows else state.clear()
        due = min((at for at, _, _ in last.values()), default=None)
        due = None if due is None else due // 1000 + self.expiry_ms
        timer = self.timer.get()[0] if self.timer.exists() else None
        if due != timer:
            if timer not in (None, fired):
                self.handle.deleteTimer(timer)
            if due is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(due)
                self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  named by the engine
        batch, (last, queues), out = pd.concat(list(rows)).sort_values(["at", "event_id"]), self._read(), []
        for name, now, event, status in zip(*(batch[c].tolist() for c in ("key", "at", "event_id", "status")), strict=True):
            at, event_id, k = last.get(name, (None, None, 0))
            if at is not None and (now, event) <= (at, event_id):
                out.append((name, None, event, None, None, True) if status == "start" else (name, None, None, event, None, True))
                continue
            if status == "start":
                queues.setdefault(name, deque()).append((now, event))
            elif queue := queues.get(name):
                started, start = queue.popleft()
                k += 1
                out.append((name, k, start, event, now - started, False))
            last[name] = now, event, k
        self._write(last, queues)
        if out:
            table = pd.DataFrame(out, columns=["key", "k", "start_id", "end_id", "duration_us", "late"])
            yield table.astype({c: "Int64" for c in ("k", "start_id", "end_id", "duration_us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Forgets the keys that have rested long enough; the timer is that of the bucket's oldest."""
        passed, (last, queues) = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), self._read()
        gone = [key for key, (at, _, _) in last.items() if at // 1000 + self.expiry_ms <= passed]
        for key in gone:
            del last[key]
            queues.pop(key, None)
        self._write(last, queues, expiredTimerInfo.getExpiryTimeInMs())
        yield from ()

    def close(self) -> None:
        """Nothing is held outside the state."""


#: Groups of keys whose state is held together.
BUCKETS = 128
#: How the values of a key are written as one text and read again, to the microsecond.
KEY_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def fifo_stream(
    events: DataFrame, key: Sequence[str] = STAGE_KEY, late: str = LATE, expiry: timedelta = timedelta(days=3650), label: str = "fifo", folder: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Durations as ``fifo_durations`` gives them, of a stream that arrives in time order: in a batch any order will do.

    Open starts are keyed state of the engine, so a run that is broken off goes on from its checkpoint (``folder``). Rows older
    than ``late`` before the newest one are dropped by the watermark; rows between, that their key has passed, come out with
    ``late`` set and no pair. Keys are dealt into ``buckets``, the same number for each run on a folder; the rows and the state of
    one bucket in one batch are one call of one task: bound batches by files per trigger, and take more buckets for many more keys.
    """
    timed = events.where(F.col("ts").isNotNull() & F.col("status").isin("start", "ok", "fail")).withWatermark("ts", late)
    name = F.to_json(F.struct(*key), KEY_TEXT).alias("key")
    at, bucket = F.unix_micros("ts").alias("at"), F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("_bucket")
    rows = timed.select(name, F.col("event_id").cast("long").alias("event_id"), "status", "ts", at, bucket)
    pairs = rows.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=Pairing(int(expiry.total_seconds() * 1000)),
        outputStructType="key string, k bigint, start_id bigint, end_id bigint, duration_us bigint, late boolean",
        outputMode="Append", timeMode="EventTime",
    )
    kinds = events.select(*key).schema
    found = pairs.select(F.from_json("key", kinds, KEY_TEXT).alias("key"), *pairs.columns[1:]).select("key.*", *pairs.columns[1:])
    return run_to_table(found, "append", label=label, folder=folder)

"""Structured Streaming forms of the time-driven operators.

Each takes a streaming frame of events (event_id, ts, user_id, event_type, value, props) and returns
a streaming frame; ``run_available`` drives one over all that is there now and gives its output.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from marlstone.operators.graph import shared_folder

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events as a stream of Parquet files; ``ts`` as a timestamp, ``doc_id`` from the props."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("doc_id"))


def run_available(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all available input and returns what it wrote.

    Append goes to a Parquet sink. Complete and update write a folder for each batch (written anew if
    the batch is repeated): of complete the last counts, of update the last row of each of ``keys``.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").start(f"{base}/out")
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}" if mode == "update" else f"{base}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("epoch", LongType())])).option("basePath", f"{base}/out").parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("last"))
    return last.select(*keys, "last.*").select(*stream.columns)


def tumbling_sessions(stream: DataFrame, width: str = "300 seconds", late: str = "1 hour") -> DataFrame:
    """Events of each client in tumbling windows: (session_id, start, n)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "session_id").agg(F.count("*").alias("n")).select("session_id", F.col("window.start").alias("start"), "n")


def sliding_rates(stream: DataFrame, width: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events of each document in sliding windows: (doc_id, start, n)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "doc_id").agg(F.count("*").alias("n")).select("doc_id", F.col("window.start").alias("start"), "n")


def first_deliveries(stream: DataFrame, late: str = "60 days") -> DataFrame:
    """The first delivery of each document in its session within the watermark; repeats are elided."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "doc_id"]).select("session_id", "doc_id")


def requeries(stream: DataFrame, other: DataFrame, seconds: int = 3600) -> DataFrame:
    """Stream-stream interval join: pairs of a session's events at most ``seconds`` apart (event, later event)."""
    a = stream.withWatermark("ts", f"{seconds} seconds").select("session_id", F.col("event_id").alias("event_id"), F.col("ts").alias("t1"))
    b = other.withWatermark("ts", f"{seconds} seconds").select(F.col("session_id").alias("s2"), F.col("event_id").alias("later_id"), F.col("ts").alias("t2"))
    return a.join(b, F.expr(f"session_id = s2 AND t2 > t1 AND t2 <= t1 + INTERVAL {seconds} SECONDS")).select("session_id", "event_id", "later_id")


def error_stats(stream: DataFrame) -> DataFrame:
    """Running totals by type, for complete mode."""
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("total"))


def last_seen(stream: DataFrame, keep: int = 100, late: str = "60 days", idle_ms: int = 90 * 86_400_000) -> DataFrame:
    """State by session: the last time and how many of the last ``keep`` stamps are held (a ring buffer in state).

    A session's state goes once the watermark (``late`` behind) has passed its last event by ``idle_ms``.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stamps = list(state.get[0]) if state.exists else []
        total = state.get[1] if state.exists else 0
        for batch in batches:
            found = (batch["ts"].astype("int64") / (1e9 if str(batch["ts"].dtype).startswith("datetime64[ns") else 1e6)).tolist()
            stamps += found
            total += len(found)
        stamps = sorted(stamps)[-keep:]
        state.update((stamps, total))
        state.setTimeoutTimestamp(max(int(stamps[-1] * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"session_id": [key[0]], "last_seen": [stamps[-1]], "held": [len(stamps)], "total": [total]})

    return stream.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(update, "session_id long, last_seen double, held long, total long", "stamps array<double>, total long", "update", GroupStateTimeout.EventTimeTimeout)


class Presence(StatefulProcessor):
    """Changes of a session's status by event time, each emitted once the watermark has passed it.

    State is a list of runs of heartbeats (first, last) whose gaps keep the session active. Runs that a later
    one before the watermark has ended are dropped, so a session holds at most one run and those within the
    lateness, however many heartbeats it has. A timer stands at the next change; with the last, the deletion,
    the state goes. Heartbeats behind the watermark are dropped.
    """

    def __init__(self, active: float, idle: float, gone: float, delete: float) -> None:
        self.active, *self.ends = (int(x * 1e6) for x in (active, idle, gone, delete))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "first long, last long")
        self.done = handle.getValueState("done", "until long")

    def _changes(self, runs: list[tuple[int, int]]) -> Iterator[tuple[int, str]]:
        """The changes in order, as if no more heartbeats came."""
        for (first, last), (after, _) in zip(runs, [*runs[1:], (None, None)], strict=True):
            yield first, "active"
            for wait, status in zip((self.active, *self.ends), ("idle", "stale", "gone", "deleted"), strict=True):
                if after is None or after > last + wait:
                    yield last + wait, status

    def _advance(self, key: tuple, runs: list[tuple[int, int]], now: int) -> Iterator[pd.DataFrame]:
        """Emits the changes before ``now`` (microseconds) that were not emitted yet, and keeps what can still change."""
        done = self.done.get()[0] if self.done.exists() else None
        changes = list(self._changes(runs))
        new = [x for x in changes if (done is None or x[0] >= done) and x[0] < now]
        due = [at for at, _ in changes if at >= now]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due:
            begun = sum(first < now for first, _ in runs)
            self.runs.put(runs[max(begun - 1, 0) :])
            self.done.update((now,))
            self.handle.registerTimer(due[0] // 1000 + 1)
        else:
            self.runs.clear()
            self.done.clear()
        if new:
            yield pd.DataFrame({"session_id": [key[0]] * len(new), "at_us": [at for at, _ in new], "status": [status for _, status in new]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        spans = [tuple(x) for x in self.runs.get()] if self.runs.exists() else []
        for batch in rows:
            stamps = batch["us"].to_numpy()
            spans += [(x, x) for x in stamps[stamps >= now].tolist()]
            spans = self._joined(spans)
        if spans:
            yield from self._advance(key, spans, now)

    def _joined(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for first, last in sorted(spans):
            if out and first <= out[-1][1] + self.active:
                out[-1] = (out[-1][0], max(out[-1][1], last))
            else:
                out.append((first, last))
        return out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.runs.exists():
            yield from self._advance(key, [tuple(x) for x in self.runs.get()], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def presence_changes(stream: DataFrame, active: float = 120.0, idle: float = 240.0, gone: float = 86400.0, delete: float = 7 * 86400.0, late: str = "1 hour") -> DataFrame:
    """Every change of a session's status before the watermark: (session_id, at_us, status), in append mode.

    A heartbeat makes a session active; it is idle, stale, gone and deleted when its last one is more than
    so many seconds old, and active again with the next. The times are those of the events (microseconds),
    not of the triggers. Equals ``operators.sessions.presence_changes`` up to the watermark. Rows without a
    session or a time are dropped. Timers need the RocksDB state store, which is set for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    beats = stream.where("session_id IS NOT NULL AND ts IS NOT NULL").select("session_id", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    return beats.groupBy("session_id").transformWithStateInPandas(Presence(active, idle, gone, delete), "session_id long, at_us long, status string", "Append", "EventTime")

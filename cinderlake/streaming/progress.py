"""Live indexing progress as a keyed state."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.progress import LOG_LINES

TTL_MS = 600_000
STATE = "project_id long, status string, progress int, stage string, current_step string, model string, chunk_count int, logs array<string>, last_updated timestamp"
_KEPT = "progress int, stage string, current_step string, at long, seq long, model string, model_at long, model_seq long, chunk_count int, chunk_at long, chunk_seq long, logs array<struct<at:long,seq:long,line:string>>"
_NEVER = (-(1 << 62), -(1 << 62))


class ProgressProcessor(StatefulProcessor):
    """Keeps the last values of each project and its last log lines, for ten minutes after its last update.

    Every value is kept with the event time and number it came with, so an update that arrives late, in
    the same batch or a later one, replaces only what is older. A batch's updates are read frame by
    frame; of log lines only the last LOG_LINES are held.
    """

    def __init__(self, ttl_ms: int | None = TTL_MS) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", _KEPT, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        if (kept := self.state.get()) is not None:
            progress, stage, step, at, seq, model, model_at, model_seq, chunks, chunk_at, chunk_seq, logs = kept
            last, of_model, of_chunks, lines = (at, seq), (model_at, model_seq), (chunk_at, chunk_seq), [(r[0], r[1], r[2]) for r in logs or []]
        else:
            progress, stage, step, model, chunks, last, of_model, of_chunks, lines = 0, None, None, None, 0, _NEVER, _NEVER, _NEVER, []
        heapq.heapify(lines)
        for frame in rows:
            for r in frame.itertuples(index=False):
                now = (int(r.at), int(r.seq))
                if now > last:
                    progress, stage, step, last = int(r.progress), r.stage, r.current_step, now
                if r.model and now > of_model:
                    model, of_model = r.model, now
                if r.chunk_count and now > of_chunks:
                    chunks, of_chunks = int(r.chunk_count), now
                if r.new_log:
                    (heapq.heappush if len(lines) < LOG_LINES else heapq.heappushpop)(lines, (*now, r.new_log))
        lines.sort()
        self.state.update((progress, stage, step, *last, model, *of_model, chunks, *of_chunks, lines))
        self.last_at = last[0]
        status = {"completed": "completed", "failed": "failed"}.get(stage, "indexing")
        out = (key[0], status, progress, stage, step, model, chunks, [line for _, _, line in lines], pd.Timestamp(last[0], unit="us"))
        yield pd.DataFrame([out], columns=[c.split()[0] for c in STATE.split(", ")])

    def close(self) -> None:
        pass


class ExpiringProgressProcessor(ProgressProcessor):
    """The same, but a state goes when the watermark is ttl_ms past the event time of its last update, however fast events are read.

    Timers of earlier updates are left to expire and do nothing then: each call of the store is a round trip.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("progress", _KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        yield from super().handleInputRows(key, rows, timer_values)
        self.handle.registerTimer(self.last_at // 1000 + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        if (kept := self.state.get()) is not None and kept[3] // 1000 + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter([])


def expiring_progress(updates: DataFrame, ttl_ms: int = TTL_MS, delay: str = "0 seconds") -> DataFrame:
    """States after each micro-batch, as live_progress gives them; a state is dropped by event time.

    The watermark is delay behind the latest event, and updates behind it are not taken. What is live is in the state
    store; see read_states.
    """
    timed = updates.withWatermark("event_time", delay).withColumn("at", F.unix_micros("event_time"))
    return timed.groupBy("project_id").transformWithStateInPandas(ExpiringProgressProcessor(ttl_ms), outputStructType=STATE, outputMode="Update", timeMode="EventTime")


def read_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The live states of a stream, from its checkpoint: the columns of STATE."""
    held = spark.read.format("statestore").option("stateVarName", "progress").load(checkpoint)
    v = F.col("value")
    status = F.when(v["stage"].isin("completed", "failed"), v["stage"]).otherwise(F.lit("indexing"))
    lines = F.transform(F.array_sort(v["logs"]), lambda x: x["line"])
    return held.select(
        F.col("key")["project_id"].alias("project_id"), status.alias("status"), v["progress"].alias("progress"), v["stage"].alias("stage"), v["current_step"].alias("current_step"),
        v["model"].alias("model"), v["chunk_count"].alias("chunk_count"), lines.alias("logs"), F.timestamp_micros(v["at"]).alias("last_updated"),
    )


def live_progress(updates: DataFrame, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """States after each micro-batch of updates (project_id, event_time, seq, progress, stage, current_step, new_log, model, chunk_count).

    Needs the RocksDB state store provider. Without a TTL a state stays for good.
    """
    timed = updates.withColumn("at", F.unix_micros("event_time")).drop("event_time")
    return timed.groupBy("project_id").transformWithStateInPandas(ProgressProcessor(ttl_ms), outputStructType=STATE, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")

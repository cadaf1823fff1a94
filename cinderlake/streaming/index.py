"""The incremental index as a stream: runs of chunks come in any order, in any number of batches, and more than once.

State is kept for each project and bucket of chunk ids: a map from chunk id to its stored rows and to the run that it
last came in. A run is announced once for a project, which reaches every bucket. It ends in a bucket when a later run
begins there, or by a timer when the watermark passes its event time and a grace; then what did not come again
is pruned. Each change goes out with the number of its batch, so a sink that
replaces a batch's rows by its number is idempotent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 64
GRACE_MS = 600_000
CHANGES = "project_id long, run long, change string, chunk_id string, id long, start_line int, end_line int"
_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
_CHUNK = "first_run long, seen_run long, last_pos long, ids array<long>, starts array<int>, ends array<int>"


class IndexProcessor(StatefulProcessor):
    """Keeps the rows of a bucket's chunk ids as operators.index.diff leaves them.

    A chunk id that was stored before a run is a hit: of its rows, that of the largest id takes the lines of
    the run's last place. One that was not is new: each of its places in the run is a row, with the place as
    its id. A row that came before changes nothing, nor does one of a run that has ended. A batch's rows of one
    bucket are held together, and taken by their runs. A chunk is read from the store at most once for a run's rows
    in a batch, written once, and not asked for in a bucket that is new: each call of the store is a round trip.
    """

    def __init__(self, grace_ms: int) -> None:
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "chunk_id string", _CHUNK)
        self.latest = handle.getValueState("latest", "run long, due long")
        self.held: dict[str, tuple] = {}
        self.changed: set[str] = set()
        self.empty = False

    def _stored(self, chunk: str) -> tuple | None:
        if chunk not in self.held and not self.empty and self.chunks.containsKey((chunk,)):
            self.held[chunk] = tuple(self.chunks.getValue((chunk,)))
        return self.held.get(chunk)

    def _put(self, chunk: str, *value: object) -> None:
        self.held[chunk] = value
        self.changed.add(chunk)

    def _flush(self) -> None:
        for chunk in self.changed:
            self.chunks.updateValue((chunk,), self.held[chunk])
        self.empty = self.empty and not self.changed
        self.held, self.changed = {}, set()

    def _came(self, project: int, run: int, pos: int, chunk: str, start: int, end: int) -> Iterator[tuple]:
        if (stored := self._stored(chunk)) is None:
            self._put(chunk, run, run, pos, [pos], [start], [end])
            yield project, run, "new", chunk, pos, start, end
            return
        first, seen, last, ids, starts, ends = stored
        ids, starts, ends = list(ids), list(starts), list(ends)
        if first == run:
            if pos not in ids:
                self._put(chunk, first, run, max(last, pos), [*ids, pos], [*starts, start], [*ends, end])
                yield project, run, "new", chunk, pos, start, end
        elif seen < run or pos > last:
            at = ids.index(max(ids))
            moved = (starts[at], ends[at]) != (start, end)
            starts[at], ends[at] = start, end
            self._put(chunk, first, run, pos, ids, starts, ends)
            if moved:
                yield project, run, "moved", chunk, ids[at], start, end

    def _pruned(self, project: int, run: int) -> Iterator[tuple]:
        gone = [(chunk, *value[3:]) for (chunk,), value in self.chunks.iterator() if value[1] < run]
        for chunk, ids, starts, ends in gone:
            self.chunks.removeKey((chunk,))
            for row in zip(ids, starts, ends, strict=True):
                yield project, run, "pruned", chunk, *row

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        project, latest, due, out = int(key[0]), -1, -1, []
        self.empty = not self.latest.exists()
        if not self.empty:
            latest, due = self.latest.get()
        before = due
        for r in pd.concat(list(rows)).sort_values("run").itertuples(index=False):
            run = int(r.run)
            if run < latest:
                continue
            if run > latest:
                self._flush()
                out += self._pruned(project, latest)
                latest, due = run, -1
            due = max(due, int(r.at) + self.grace_ms)
            if r.chunk_id is not None:
                out += self._came(project, run, int(r.pos), r.chunk_id, int(r.start_line), int(r.end_line))
        self._flush()
        if latest >= 0 and due != before:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
            self.latest.update((latest, due))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        if out := list(self._pruned(int(key[0]), self.latest.get()[0])):
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def index_changes(chunks: DataFrame, delay: str = "0 seconds", grace_ms: int = GRACE_MS, buckets: int = BUCKETS) -> DataFrame:
    """Changes of the stored table (CHANGES: new, moved, pruned) from a stream of chunks (project_id, run, event_time, pos, chunk_id, start_line, end_line).

    A run's number grows with time within its project. A row without a chunk_id announces a run, and is to come before
    the watermark passes the run's grace, else a bucket that nothing comes to is not pruned. Runs that are not
    announced and bring nothing leave the table alone.
    """
    every = F.when(F.col("chunk_id").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")))
    dealt = chunks.withWatermark("event_time", delay).withColumn("at", F.unix_millis("event_time")).withColumn("bucket", F.explode(every))
    keyed = dealt.select("project_id", "bucket", "event_time", "at", "run", "pos", "chunk_id", "start_line", "end_line").groupBy("project_id", "bucket")
    return keyed.transformWithStateInPandas(IndexProcessor(grace_ms), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")


def write_changes(path: str):
    """A foreachBatch function that writes each batch's changes to a folder of its number, replacing what an attempt before has left there."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def indexed(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stored table as a stream's state has it: project_id, chunk_id, id, start_line, end_line."""
    held = spark.read.format("statestore").option("stateVarName", "chunks").load(checkpoint)
    value = F.col("user_map_value")
    rows = F.arrays_zip(value["ids"].alias("id"), value["starts"].alias("start_line"), value["ends"].alias("end_line"))
    spread = held.select(F.col("key")["project_id"].alias("project_id"), F.col("user_map_key")["chunk_id"].alias("chunk_id"), F.explode(rows).alias("r"))
    return spread.select("project_id", "chunk_id", F.col("r")["id"].alias("id"), F.col("r")["start_line"].alias("start_line"), F.col("r")["end_line"].alias("end_line"))

"""Streams that go by event time."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cinderlake.streaming import progress

FIELDS = "project_id long, micros long, seq long, progress int, stage string, current_step string, new_log string, model string, chunk_count int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def updates(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def put(number, *rows):
        made = spark.createDataFrame([(p, s * 1_000_000, s, 10, "parsing", f"step {s}", f"log {s}", "m", 1) for p, s in rows], FIELDS)
        made.withColumn("event_time", F.timestamp_micros("micros")).drop("micros").coalesce(1).write.parquet(f"{tmp_path}/in/{number}")

    return put


def test_states_expire_by_event_time(spark, tmp_path, updates):
    def run():
        schema = "project_id long, seq long, progress int, stage string, current_step string, new_log string, model string, chunk_count int, event_time timestamp"
        stream = progress.expiring_progress(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), ttl_ms=60_000)
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").foreachBatch(lambda batch, n: batch.write.format("noop").mode("append").save()).trigger(availableNow=True).start().awaitTermination()
        return {r["project_id"]: (r["current_step"], list(r["logs"]), r["status"]) for r in progress.read_states(spark, f"{tmp_path}/check").collect()}

    updates(0, (1, 1000), (2, 1000), (3, 1030))
    assert set(run()) == {1, 2, 3}
    updates(1, (2, 1050), (3, 1055))
    assert run()[2] == ("step 1050", ["log 1000", "log 1050"], "indexing")
    updates(2, (4, 1075))  # a minute after the only update of 1, not of the others
    assert set(run()) == {2, 3, 4}
    updates(3, (1, 1076))  # begins anew
    assert run()[1] == ("step 1076", ["log 1076"], "indexing")
    updates(4, (4, 5000))
    assert set(run()) == {4}


class Store:
    """A state and its timers, with the number of calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "update":
                self.value = args[0]
            elif name == "clear":
                self.value = None
            elif name == "registerTimer":
                self.timers.add(args[0])
            elif name == "deleteTimer":
                self.timers.discard(args[0])
            return {"exists": self.value is not None, "get": self.value, "listTimers": sorted(self.timers), "getValueState": self}.get(name)

        return call


def test_few_calls_of_the_store_for_a_batch(spark):
    class Timer:
        def __init__(self, at):
            self.getExpiryTimeInMs = lambda: at

    store, made = Store(), progress.ExpiringProgressProcessor(60_000)
    made.init(store)
    frame = lambda s: pd.DataFrame([(s * 1_000_000, s, 10, "parsing", f"step {s}", f"log {s}", "m", 1)], columns=["at", "seq", "progress", "stage", "current_step", "new_log", "model", "chunk_count"])
    for s in (1000, 1050, 1020):
        store.calls = 0
        assert len(list(made.handleInputRows((1,), iter([frame(s)]), None))) == 1
        assert store.calls == 3
    assert max(store.timers) == 1_110_000
    for at in sorted(store.timers - {1_110_000}) + [1_109_999]:
        assert list(made.handleExpiredTimer((1,), None, Timer(at))) == [] and store.value is not None
    assert list(made.handleExpiredTimer((1,), None, Timer(1_110_000))) == [] and store.value is None


CHUNK = "project_id long, run long, second long, pos long, chunk_id string, start_line int, end_line int"


def test_runs_as_a_stream_leave_what_the_diff_leaves(spark, tmp_path):
    import random

    from cinderlake.operators import index
    from cinderlake.streaming import index as stream_index

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    r, made = random.Random(4), {}
    for run in range(3):
        for project in (1, 2) if run < 2 else (1,):  # nothing of project 2 comes in the last run
            made[run, project] = [(project, run, 5000 + 1000 * run + p % 50, 1000 * run + p, f"c{r.randrange(60)}", r.randrange(9), 9 + r.randrange(9)) for p in range(80)]

    want = None
    for run in range(3):
        rows = [x for (n, _), own in made.items() if n == run for x in own]
        incoming = spark.createDataFrame(rows, CHUNK).drop("run", "second")
        stored = spark.createDataFrame([] if want is None else want, "project_id long, id long, chunk_id string, start_line int, end_line int")
        found = index.diff(stored, incoming)
        new = found.new.select("project_id", F.col("pos").alias("id"), "chunk_id", "start_line", "end_line")
        want = [tuple(x) for x in found.stored.select("project_id", "id", "chunk_id", "start_line", "end_line").union(new).collect()]

    def put(number, rows):
        frame = spark.createDataFrame(rows, CHUNK).withColumn("event_time", F.timestamp_seconds("second")).drop("second")
        frame.coalesce(1).write.parquet(f"{tmp_path}/chunks/{number}")

    def run_stream():
        schema = "project_id long, run long, pos long, chunk_id string, start_line int, end_line int, event_time timestamp"
        changes = stream_index.index_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/chunks/*"), delay="100 seconds", grace_ms=200_000, buckets=5)
        changes.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").foreachBatch(stream_index.write_changes(f"{tmp_path}/changes")).trigger(availableNow=True).start().awaitTermination()

    number = 0
    for run in range(3):
        rows = [x for (n, _), own in made.items() if n == run for x in own]
        rows += [(p, run, 5000 + 1000 * run, None, None, None, None) for p in {x[0] for x in rows}]
        r.shuffle(rows)
        half = len(rows) // 2
        put(number, rows[:half])
        put(number + 1, rows[half:] + rows[: half // 2])  # some once more
        run_stream()
        number += 2
    put(number, [(9, 0, 19000, None, None, None, None)])  # time goes on
    run_stream()
    got = [tuple(x) for x in stream_index.indexed(spark, f"{tmp_path}/check").select("project_id", "id", "chunk_id", "start_line", "end_line").collect()]
    assert sorted(got) == sorted(want)
    changes = spark.read.parquet(f"{tmp_path}/changes")
    ended = {(x["project_id"], x["chunk_id"], x["id"]) for x in changes.filter("change = 'new'").collect()} - {(x["project_id"], x["chunk_id"], x["id"]) for x in changes.filter("change = 'pruned'").collect()}
    assert ended == {(p, c, i) for p, i, c, _, _ in want}


def test_few_calls_of_the_store_for_chunks():
    from cinderlake.streaming import index as stream_index

    class Chunks:
        def __init__(self):
            self.kept, self.calls = {}, 0

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name == "updateValue":
                    self.kept[args[0]] = args[1]
                elif name == "removeKey":
                    del self.kept[args[0]]
                return {"containsKey": bool(args) and args[0] in self.kept, "getValue": args and self.kept.get(args[0]), "iterator": list(self.kept.items())}.get(name)

            return call

    made, chunks, store = stream_index.IndexProcessor(1000), Chunks(), Store()
    store.getMapState = lambda *args: chunks
    made.init(store)

    def batch(*rows):
        chunks.calls = 0
        frame = pd.DataFrame([(run, 1000 * run, pos, chunk, pos, pos + 1) for run, pos, chunk in rows], columns=["run", "at", "pos", "chunk_id", "start_line", "end_line"])
        out = list(made.handleInputRows((1, 0), iter([frame]), None))
        return [tuple(x) for x in out[0][["change", "chunk_id", "id"]].itertuples(index=False)] if out else []

    assert batch((0, 1, "a"), (0, 2, "b"), (0, 2, "b"), (0, 3, "a")) == [("new", "a", 1), ("new", "b", 2), ("new", "a", 3)]
    assert chunks.calls <= 3  # two chunks, and the sweep before the first run
    assert batch((1, 4, "a"), (1, 4, "a"), (1, 5, "c"), (2, 6, "c")) == [("moved", "a", 3), ("new", "c", 5), ("pruned", "b", 2), ("moved", "c", 5)]
    assert set(k for (k,) in chunks.kept) == {"a", "c"} and chunks.kept[("a",)][3:] == ([1, 3], [1, 4], [2, 5])

"""Folds over the rows of each file in order, of which no task needs a whole file.

Rows are dealt by ranges of file and order, so a file of any size spreads over partitions. A run is what a
partition has of one file. Where a run begins a file its state is known; a partition's first run may go
on from the partition before, so it is folded for every state that it could begin in: a summary. Summaries are
small, and only those of files over several partitions are put one after the other, which gives each run
the state it really begins in. A second pass over the rows, as they were written in pieces, then folds each
piece by itself.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ChunkingConfig
from ..session import materialize

#: Rows of a piece at most.
PIECE_ROWS = 4_096


class Fold:
    """What is folded: columns read, fields added, and states known and not known."""

    columns: tuple[str, ...]
    fields: list[T.StructField]

    def start(self) -> Any:
        """The state in front of a file."""
        raise NotImplementedError

    def step(self, state: Any, *columns: list) -> tuple[Any, list[list]]:
        """The state after rows, and their values of fields."""
        raise NotImplementedError

    def unknown(self) -> Any:
        """A summary of no rows."""
        raise NotImplementedError

    def summarise(self, summary: Any, *columns: list) -> Any:
        """The summary with more rows."""
        raise NotImplementedError

    def after(self, summary: Any, state: Any) -> Any:
        """The state after a summary's rows, if they begin in a state."""
        raise NotImplementedError


class PackFold(Fold):
    """place, pack and chunk (chunks of the packs before) of blocks; an oversized block is a pack alone, of as many chunks as it has slices.

    A state is the tokens of the open pack (-1 for none), the packs and chunks so far, and the blocks. A summary has
    these for every number of tokens that the open pack can have to begin with; beginnings that have come to the same
    number go on as one, which takes but a few blocks.
    """

    columns = ("n_tokens", "single_class")
    fields = [T.StructField("place", T.IntegerType()), T.StructField("pack", T.IntegerType()), T.StructField("chunk", T.IntegerType())]

    def __init__(self, config: ChunkingConfig) -> None:
        self.config = config
        self.most = max(config.ceiling, config.soft_max, config.oversized_tokens)

    def _taken(self, current: int, n: int, single: bool) -> tuple[int, int]:
        """The open pack's tokens after a block, and how many chunks are new (0 where it joins the open pack)."""
        large = n > self.config.oversized_tokens
        if current >= 0 and not large and self.config.absorbs(current, n):
            return current + n, 0
        return (-1, 1 if single else self.config.n_slices(n)) if large else (n, 1)

    def start(self) -> tuple[int, int, int, int, int]:
        return -1, 0, 0, 0, 0

    def step(self, state: tuple, tokens: list, single: list) -> tuple[tuple, list[list]]:
        current, packs, chunks, last, place = state  # last: chunks of the open or last pack
        places, numbers, before = [], [], []
        for n, alone in zip(tokens, single, strict=True):
            current, more = self._taken(current, n, alone)
            if more:
                packs, chunks, last = packs + 1, chunks + more, more
            places.append(place)
            numbers.append(packs - 1)
            before.append(chunks - last)
            place += 1
        return (current, packs, chunks, last, place), [places, numbers, before]

    def unknown(self) -> dict:
        n = self.most + 2
        return {"way": np.arange(n), "packs": np.zeros(n, np.int64), "chunks": np.zeros(n, np.int64), "ways": [[c - 1, 0, 0, 0] for c in range(n)], "rows": 0}

    def summarise(self, summary: dict, tokens: list, single: list) -> dict:
        way, packs, chunks, ways = summary["way"].copy(), summary["packs"].copy(), summary["chunks"].copy(), [list(w) for w in summary["ways"]]
        for n, alone in zip(tokens, single, strict=True):
            for w in ways:
                w[0], more = self._taken(w[0], n, alone)
                if more:
                    w[1], w[2], w[3] = w[1] + 1, w[2] + more, more
            if len(ways) > 1:
                first: dict[tuple[int, int], int] = {}
                to = [first.setdefault((w[0], w[3]), k) for k, w in enumerate(ways)]
                if len(first) < len(ways):  # some have come to the same number of tokens
                    numbers = {k: i for i, k in enumerate(first.values())}
                    for k, kept in enumerate(to):
                        if k != kept:
                            own = way == k
                            packs[own] += ways[k][1] - ways[kept][1]
                            chunks[own] += ways[k][2] - ways[kept][2]
                    way = np.array([numbers[kept] for kept in to])[way]
                    ways = [ways[k] for k in first.values()]
        return {"way": way, "packs": packs, "chunks": chunks, "ways": ways, "rows": summary["rows"] + len(tokens)}

    def after(self, summary: dict, state: tuple) -> tuple:
        current, packs, chunks, last, place = state
        at = current + 1
        end, more_packs, more_chunks, own = summary["ways"][summary["way"][at]]
        more_packs, more_chunks = more_packs + int(summary["packs"][at]), more_chunks + int(summary["chunks"][at])
        return end, packs + more_packs, chunks + more_chunks, own or last, place + summary["rows"]


class EnclosingFold(Fold):
    """enclosing: the signature of the outermost class around each row, '' for none, of rows by start, the larger end first, classes before others.

    A state is the classes that end later than all before them and not before the row at hand, in order, so the
    first whose end reaches a row's is its outermost; in nested code there is one at most. A summary is the same
    for a run's own classes.
    """

    columns = ("start_line", "end_line", "class_signature")
    fields = [T.StructField("enclosing", T.StringType())]

    def start(self) -> tuple[list[int], list[str]]:
        return [], []

    unknown = start

    def step(self, state: tuple, starts: list, ends: list, signatures: list) -> tuple[tuple, list[list]]:
        reach, names, out = *map(list, state), []
        for start, end, signature in zip(starts, ends, signatures, strict=True):
            if start is None or end is None:
                out.append("")
                continue
            dead = bisect_left(reach, start)
            del reach[:dead], names[:dead]
            if signature is not None and (not reach or end > reach[-1]):
                reach.append(end)
                names.append(signature)
            at = bisect_left(reach, end)
            out.append(names[at] if at < len(reach) else "")
        return (reach, names), [out]

    def summarise(self, summary: tuple, starts: list, ends: list, signatures: list) -> tuple:
        return self.step(summary, starts, ends, signatures)[0]

    def after(self, summary: tuple, state: tuple) -> tuple:
        reach, names = map(list, state)
        last = reach[-1] if reach else -(1 << 63)
        more = [(r, n) for r, n in zip(*summary, strict=True) if r > last]
        return reach + [r for r, _ in more], names + [n for _, n in more]


_FILE = "__file"


def _pieces(fold: Fold, columns: list[str], piece_rows: int):
    """(file, part, before, end, rows): pieces of runs with the state or summary in front of them; and, without rows, the ends of a partition's first and last run, which others may go on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_runs, held = TaskContext.get().partitionId(), 0, None
        known, state = False, fold.unknown()
        nothing: pa.StructArray | None = None

        def pieces(found: list[tuple], rows: pa.StructArray) -> pa.RecordBatch:
            files, before, ends, stops = zip(*found, strict=True)
            lists = pa.ListArray.from_arrays(pa.array([0, *stops], pa.int32()), rows)
            arrays = [pa.array(files), pa.array([part] * len(files), pa.int32()), pa.array(before, pa.binary()), pa.array(ends, pa.binary()), lists]
            return pa.RecordBatch.from_arrays(arrays, names=["file", "part", "before", "end", "rows"])

        for batch in batches:
            if not len(batch):
                continue
            files, found = batch.column(_FILE).to_pylist(), []
            read = [batch.column(c).to_pylist() for c in fold.columns]
            at = 0
            while at < len(files):
                if files[at] != held:
                    if n_runs == 1:
                        found.append((held, None, pickle.dumps((known, state)), at))
                    n_runs, held = n_runs + 1, files[at]
                    if n_runs > 1:
                        known, state = True, fold.start()
                stop = at + 1
                while stop < len(files) and stop - at < piece_rows and files[stop] == held:
                    stop += 1
                found.append((held, pickle.dumps((known, state)), None, stop))
                own = [c[at:stop] for c in read]
                state = fold.step(state, *own)[0] if known else fold.summarise(state, *own)
                at = stop
            rows = pa.StructArray.from_arrays([batch.column(c) for c in columns], fields=[batch.schema.field(c) for c in columns])
            nothing = rows[:0]
            yield pieces(found, rows)
        if nothing is not None:
            yield pieces([(held, None, pickle.dumps((known, state)), 0)], nothing)

    return cut


def _carried(fold: Fold):
    """The state that each run of a file begins in; a row a partition that the file is in."""

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        frame, state, out = frame.sort_values("part"), fold.start(), []
        for file, part, end in frame[["file", "part", "end"]].itertuples(index=False):
            out.append((file, part, pickle.dumps(state)))
            known, found = pickle.loads(end)
            state = found if known else fold.after(found, state)
        return pd.DataFrame(out, columns=["file", "part", "carried"])

    return carry


def _finished(fold: Fold, columns: list[str]):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, at = batch.column("rows"), 0
            rows = lists.flatten()
            read = [rows.field(columns.index(c)).to_pylist() for c in fold.columns]
            added: list[list] = [[] for _ in fold.fields]
            for size, before, carried in zip(lists.value_lengths().to_pylist(), batch.column("before").to_pylist(), batch.column("carried").to_pylist(), strict=True):
                known, state = pickle.loads(before)
                if not known:
                    state = fold.after(state, fold.start() if carried is None else pickle.loads(carried))
                for out, more in zip(added, fold.step(state, *(c[at : at + size] for c in read))[1], strict=True):
                    out += more
                at += size
            extra = [pa.array(v, pa.string() if isinstance(f.dataType, T.StringType) else pa.int32()) for v, f in zip(added, fold.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.flatten(), *extra], names=[*columns, *(f.name for f in fold.fields)])

    return finish


def fold_files(rows: DataFrame, file: Column, order: list[Column], fold: Fold, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """rows with the fields of a fold over each file's rows in an order, which is to tell them apart. No null files."""
    ordered = materialize(rows, "fold-rows").withColumn(_FILE, file)
    sorted_ = ordered.repartitionByRange(_FILE, *order).sortWithinPartitions(_FILE, *order)
    pieces = T.StructType([
        T.StructField("file", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("before", T.BinaryType()),
        T.StructField("end", T.BinaryType()), T.StructField("rows", T.ArrayType(rows.schema)),
    ])
    cut = materialize(sorted_.mapInArrow(_pieces(fold, rows.columns, piece_rows), pieces), "pieces")
    ends = cut.filter("end is not null").select("file", "part", "end")
    several = ends.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1").select("file")
    carried = materialize(ends.join(several, "file", "left_semi").groupBy("file").applyInPandas(_carried(fold), "file string, part int, carried binary"), "carried")
    joined = cut.filter("before is not null").select("file", "part", "before", "rows").join(carried, ["file", "part"], "left")
    return joined.select("before", "carried", "rows").mapInArrow(_finished(fold, rows.columns), T.StructType([*rows.schema.fields, *fold.fields]))

"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes, Spark's external sort places equal texts next
to each other, and a streaming pass compares each whole text with its neighbour's. Sort key and
splitters are the first bytes, the digest of the whole text and the id: a splitter's size is bounded
however long the texts are, texts with a common opening still spread, and a group of copies larger
than a partition is cut between partitions. The few runs that touch a partition's edge are compared
across it and joined up. Texts count as equal by comparison only, never by digest alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, materialize, read_table, shuffle_partitions

PREFIX_BYTES = 32


def _sorted_by_content(rows: DataFrame, keep: str) -> DataFrame:
    """rows with columns id and text, dealt and sorted by content; in a run of copies the id that stays comes first."""
    norm = F.encode(ascii_lower(F.coalesce("text", F.lit(""))), "UTF-8")
    rows = rows.withColumns({"prefix": F.substring(norm, 1, PREFIX_BYTES), "sha": F.sha2(norm, 256)})
    keys = ["prefix", "sha", F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()]
    return rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).drop("prefix")


class _Neighbours:
    """Finds in sorted batches the rows whose whole text differs from the row before."""

    def __init__(self) -> None:
        self.last: pa.Scalar | None = None

    def starts(self, text: pa.Array) -> np.ndarray:
        norm = pc.ascii_lower(pc.fill_null(text, ""))
        out = np.ones(len(norm), dtype=bool)
        if len(norm) > 1:
            out[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        if self.last is not None and len(norm):
            out[0] = norm[0].as_py() != self.last.as_py()
        if len(norm):
            self.last = pa.scalar(norm[-1].as_py(), norm.type)  # a slice would keep the whole batch
        return np.flatnonzero(out)


_RUNS = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("keep", pa.int64()), ("size", pa.int64()), ("first", pa.bool_()), ("part", pa.int32()), ("run", pa.int32()), ("edge", pa.string())])


def _label_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition with the first id of their run and its size in this partition.

    Held between batches: one text, and the ids of the run that is still open. The texts of the first
    and last run go along once, as edge.
    """
    part, seen, near = TaskContext.get().partitionId(), 0, _Neighbours()
    held: list[tuple[pa.Array, pa.Array]] = []
    opening: str | None = None

    def closed(at: np.ndarray, final: bool) -> pa.RecordBatch:
        """What is held, as runs that start at the given rows."""
        ids, sha = (pa.concat_arrays(x) for x in zip(*held, strict=True))
        sizes = np.diff([*at, len(ids)])
        first = np.zeros(len(ids), bool)
        first[at] = True
        edge: list[str | None] = [None] * len(ids)
        if not seen:
            edge[0] = opening
        if final:
            edge[at[-1]] = near.last.as_py()
        keep = ids.take(pa.array(np.repeat(at, sizes)))
        columns = [ids, sha, keep, np.repeat(sizes, sizes), first, np.full(len(ids), part, np.int32), np.repeat(np.arange(seen, seen + len(at), dtype=np.int32), sizes), edge]
        return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, _RUNS.types, strict=True)], schema=_RUNS)

    for batch in batches:
        if not len(batch):
            continue
        ids, sha, text = (batch.column(c) for c in ("id", "sha", "text"))
        if opening is None:
            opening = pc.ascii_lower(pc.fill_null(text[:1], ""))[0].as_py()
        at = near.starts(text)
        if not len(at):
            held.append((ids, sha))
            continue
        cut, before = int(at[-1]), sum(len(x) for x, _ in held)
        held.append((ids[:cut], sha[:cut]))
        done = np.concatenate([np.zeros(int(before > 0), np.int64), at[:-1] + before])
        if len(done):
            yield closed(done, False)
            seen += len(done)
        held = [(ids[cut:], sha[cut:])]
    if held:
        yield closed(np.zeros(1, np.int64), True)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole first rows of the runs in one sorted partition, with part, run and whether the run is its last.

    One row is held between batches.
    """
    part, run, near, held = TaskContext.get().partitionId(), -1, _Neighbours(), None

    def marked(rows: pa.Table, first_run: int, final: bool) -> pa.Table:
        n = len(rows)
        last = np.zeros(n, bool)
        last[n - 1] = final
        for name, column in (("part", np.full(n, part, np.int32)), ("run", np.arange(first_run, first_run + n, dtype=np.int32)), ("final", last)):
            rows = rows.append_column(name, pa.array(column))
        return rows

    for batch in batches:
        at = near.starts(batch.column("text"))
        if not len(at):
            continue
        rows = pa.Table.from_batches([batch]).drop_columns(["sha"]).take(pa.array(at))
        if held is not None:
            yield from marked(held, run, False).combine_chunks().to_batches()
        if len(at) > 1:
            yield from marked(rows[:-1], run + 1, False).combine_chunks().to_batches()
        run, held = run + len(at), rows[len(at) - 1 :].combine_chunks()
    if held is not None:
        yield from marked(held, run, True).combine_chunks().to_batches()


def _chains(edges: DataFrame) -> DataFrame:
    """Runs at partition edges (part, run, keep, size, edge), joined up where neighbours hold the same text.

    At most two rows a partition go in. Only their numbers meet in one window; texts are compared in joins.
    Returns part, run, chain_keep, chain_size, and head: whether the run is its chain's first.
    """
    in_order = Window.orderBy("part", "run")
    before = edges.select("part", "run").withColumns({"prev_part": F.lag("part").over(in_order), "prev_run": F.lag("run").over(in_order)})
    left = edges.select(F.col("part").alias("prev_part"), F.col("run").alias("prev_run"), F.col("edge").alias("prev_edge"))
    linked = before.filter(F.col("prev_part") < F.col("part")).join(left, ["prev_part", "prev_run"]).join(edges.select("part", "run", "edge"), ["part", "run"])
    linked = linked.filter(F.col("prev_edge") == F.col("edge")).select("part", "run", F.lit(True).alias("linked"))
    runs = edges.drop("edge").join(linked, ["part", "run"], "left").withColumn("chain", F.count_if(F.col("linked").isNull()).over(in_order))
    whole = Window.partitionBy("chain").orderBy("part", "run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return runs.select("part", "run", F.first("keep").over(whole).alias("chain_keep"), F.sum("size").over(whole).alias("chain_size"), F.col("linked").isNull().alias("head"))


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    smallest (or largest, by ``keep``) id of a group stays; a null id stays only if the group has no
    other. Of repeated rows with the id that stays, one is kept. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    runs = materialize(_sorted_by_content(rows, keep).select("id", "sha", "text").mapInArrow(_label_runs, T.StructType([T.StructField(f.name, t) for f, t in zip(_RUNS, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.BooleanType(), T.IntegerType(), T.IntegerType(), T.StringType()), strict=True)])), "runs")
    chains = _chains(runs.filter(F.col("edge").isNotNull()).select("part", "run", "keep", "size", "edge"))
    out = runs.drop("edge").join(F.broadcast(chains), ["part", "run"], "left")  # at most two rows a partition
    size = F.coalesce("chain_size", "size")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("chain_size").isNull(), F.col("keep")).otherwise(F.col("chain_keep")).alias("keep_id"),
        size.alias("group_size"),
        (F.col("first") & F.coalesce("head", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that label_copies keeps, whole and with the columns of docs.

    Rows pass through the sort once; of the rows it leaves, those that open a partition go if the
    partition before ends with their text.
    """
    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("others"))
    ordered = _sorted_by_content(packed, keep)
    names = ["id", "text", "others", "sha"]
    schema = T.StructType([*(ordered.schema[c] for c in names[:3]), T.StructField("part", T.IntegerType()), T.StructField("run", T.IntegerType()), T.StructField("final", T.BooleanType())])
    firsts = materialize(ordered.select(*names).mapInArrow(_firsts, schema), "firsts")
    edges = firsts.filter((F.col("run") == 0) | F.col("final"))
    edges = edges.select("part", "run", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"), ascii_lower(F.coalesce("text", F.lit(""))).alias("edge"))
    repeats = _chains(edges).filter(~F.col("head")).select("part", "run")
    left = firsts.join(F.broadcast(repeats), ["part", "run"], "left_anti")  # at most one row a partition
    return left.select(*[F.col("text").alias(c) if c == text_col else F.col("others")[c].alias(c) for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents, the largest id of each group staying. Null texts count as empty; see label_copies."""
    return label_copies(read_table(spark, sf_dir, "documents"), keep="largest")


OP1_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

"""Codes of vectors by parts: a codebook of entries for each part, trained by exact Lloyd rounds over heaps.

Vectors become integers and are packed into blocks, a few thousand to a row. For each part and entry a block keeps a
heap of its vectors there, keyed by how much farther the second nearest entry is at least than their own
(lower minus upper bound). When entries move, a key can shrink by no more than the entry's own move and the largest
move of the others; these drifts are added up, so keys need no update: a round pops only the vectors whose key the
drift since they were pushed has used up, and measures these against all entries anew, exactly. Sums of entries change by what has
moved, so a round brings the driver one row of differences for each entry that changed.

Codebooks have a fixed size, whatever the table's; blocks are the only state and are written to the shared folder
after each round, so a lost executor costs no more than its tasks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block at most; a heap's items hold a vector's place in the block in the lower bits of the key.
BLOCK_BITS = 13
#: Steps that keys are rounded down to, in units of distance, and what roots of squares may be off by.
KEY_STEPS, SLACK = 64, 1e-6
#: Components beyond this would let squared distances leave 64 bits.
LARGEST = 1 << 25
#: Up to so many labels are sent to the vectors; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000

_BLOCK = "ids array<long>, labels array<string>, values binary, nearest binary, heaps binary, sizes binary, moved binary, counts binary"


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label (as text) and the integer components x of vectors without null or non-finite ones."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & F.forall(x, lambda v: F.coalesce((v < float("inf")) & (v > float("-inf")), F.lit(False)))
    rows = vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), x.alias("v"))
    return rows.select("id", "label", F.transform("v", lambda v: F.floor(v * SCALE)).alias("x"))


def _parted(x: np.ndarray, parts: int) -> np.ndarray:
    """(vectors, components) as (parts, vectors, components of a part)."""
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).swapaxes(0, 1))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x from each entry, in 64-bit integers."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - entries[None, :, k]
        out += d * d
    return out


def _pushed(x: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries of the rows of x (the lowest of equals), and their keys, from which the drift so far is not to be taken off again."""
    d = squares(x, entries)
    near = d.argmin(axis=1)
    own = d[np.arange(len(x)), near]
    d[np.arange(len(x)), near] = np.iinfo(np.int64).max
    key = np.sqrt(d.min(axis=1).astype(float)) - np.sqrt(own.astype(float)) + drift[near]
    return near, np.floor(np.minimum(key, LARGEST * 64.0) * KEY_STEPS).astype(np.int64) - 1


def _pack_moves(x: np.ndarray, left: np.ndarray | None, near: np.ndarray, n_entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes of the sums and counts of entries where rows of x went from left to near."""
    sums, counts = np.zeros((n_entries, x.shape[1]), np.int64), np.zeros(n_entries, np.int64)
    np.add.at(sums, near, x)
    np.add.at(counts, near, 1)
    if left is not None:
        np.subtract.at(sums, left, x)
        np.subtract.at(counts, left, 1)
    return sums, counts


def _record(ids: list, labels: list, values: np.ndarray, near: np.ndarray, heaps: list[list[list[int]]], sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    flat = np.array([item for part in heaps for heap in part for item in heap], np.int64)
    sizes = np.array([len(heap) for part in heaps for heap in part], np.int32)
    row = [ids, labels, values.astype(np.int32).tobytes(), near.astype(np.uint8).tobytes(), flat.tobytes(), sizes.tobytes(), sums.tobytes(), counts.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])


_TYPES = [pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 6]


def _first_round(codebooks: np.ndarray):
    """Blocks of vectors with their nearest entries and heaps."""
    parts, n_entries, width = codebooks.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        still = np.zeros(n_entries)
        for batch in batches:
            for at in range(0, len(batch), 1 << BLOCK_BITS):
                part_of = batch.slice(at, 1 << BLOCK_BITS)
                flat = part_of.column("x").flatten().to_numpy(zero_copy_only=False)
                if len(flat) and max(-int(flat.min()), int(flat.max())) > LARGEST:
                    raise ValueError(f"components beyond {LARGEST // SCALE} do not fit 64-bit distances")
                x = _parted(flat.reshape(len(part_of), -1), parts)
                near, heaps, moves = np.empty((parts, len(part_of)), np.int64), [], []
                for p in range(parts):
                    near[p], keys = _pushed(x[p], codebooks[p], still)
                    items = keys << BLOCK_BITS | np.arange(len(keys))
                    own = [items[near[p] == e].tolist() for e in range(n_entries)]
                    for heap in own:
                        heapq.heapify(heap)
                    heaps.append(own)
                    moves.append(_pack_moves(x[p], None, near[p], n_entries))
                yield _record(part_of.column("id").to_pylist(), part_of.column("label").to_pylist(), x, near, heaps, *map(np.array, zip(*moves, strict=True)))

    return assign


def _restored(batch: pa.RecordBatch, shape: tuple[int, int, int]) -> Iterator[tuple[list, list, np.ndarray, np.ndarray, list[list[list[int]]]]]:
    parts, n_entries, width = shape
    for row in batch.to_pylist():
        n = len(row["ids"])
        x = np.frombuffer(row["values"], np.int32).astype(np.int64).reshape(parts, n, width)
        near = np.frombuffer(row["nearest"], np.uint8).astype(np.int64).reshape(parts, n)
        cuts = np.cumsum(np.frombuffer(row["sizes"], np.int32))[:-1]
        heaps = [heap.tolist() for heap in np.split(np.frombuffer(row["heaps"], np.int64), cuts)]
        yield row["ids"], row["labels"], x, near, [heaps[p * n_entries : (p + 1) * n_entries] for p in range(parts)]


def _settle(x: np.ndarray, near: np.ndarray, heaps: list[list[int]], entries: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One part's vectors whose bounds the drift has used up go to their nearest entries, in near and heaps; (which, where they were)."""
    limits = np.ceil((drift + SLACK) * KEY_STEPS).astype(np.int64)
    popped: list[int] = []
    for heap, limit in zip(heaps, limits.tolist(), strict=True):
        end = limit + 1 << BLOCK_BITS
        while heap and heap[0] < end:
            popped.append(heapq.heappop(heap) & (1 << BLOCK_BITS) - 1)
    rows = np.array(popped, np.int64)
    before = near[rows]
    near[rows], keys = _pushed(x[rows], entries, drift)
    for row, entry, key in zip(popped, near[rows].tolist(), keys.tolist(), strict=True):
        heapq.heappush(heaps[entry], key << BLOCK_BITS | row)
    return rows, before


def _next_round(codebooks: np.ndarray, drift: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, x, near, heaps in _restored(batch, codebooks.shape):
                moves = []
                for p, entries in enumerate(codebooks):
                    rows, before = _settle(x[p], near[p], heaps[p], entries, drift[p])
                    moves.append(_pack_moves(x[p][rows], before, near[p][rows], len(entries)))
                yield _record(ids, labels, x, near, heaps, *map(np.array, zip(*moves, strict=True)))

    return assign


def _coded(codebooks: np.ndarray, drift: np.ndarray):
    """id, label, code and error of each vector by the last codebooks."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, x, near, heaps in _restored(batch, codebooks.shape):
                error = np.zeros(len(ids), np.int64)
                for p, entries in enumerate(codebooks):
                    _settle(x[p], near[p], heaps[p], entries, drift[p])
                    d = x[p] - entries[near[p]]
                    error += (d * d).sum(axis=1)
                codes = [row.tobytes().hex() for row in np.ascontiguousarray(near.T.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(codes), pa.array(error)], names=["id", "label", "code", "error"])

    return code


def _added(blocks: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Changes of the sums and counts of all entries, over all blocks; as many numbers as codebooks have."""
    parts, n_entries, width = shape

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros(shape, np.int64), np.zeros((parts, n_entries), np.int64)
        for frame in frames:
            for moved, n in zip(frame["moved"], frame["counts"], strict=True):
                sums += np.frombuffer(moved, np.int64).reshape(shape)
                counts += np.frombuffer(n, np.int64).reshape(parts, n_entries)
        at = np.flatnonzero(sums.reshape(-1, width).any(axis=1) | (counts.ravel() != 0))
        yield pd.DataFrame({"entry": at, "n": counts.ravel()[at], "total": pd.Series(sums.reshape(-1, width)[at].tolist(), dtype=object)})

    changes = blocks.select("moved", "counts").mapInPandas(add, "entry long, n long, total array<long>")
    totals = [F.sum(F.get("total", F.lit(k))).alias(f"s{k}") for k in range(width)]
    sums, counts = np.zeros((parts * n_entries, width), np.int64), np.zeros(parts * n_entries, np.int64)
    for r in changes.groupBy("entry").agg(F.sum("n").alias("n"), *totals).collect():  # one row an entry at most
        counts[r["entry"]], sums[r["entry"]] = r["n"], r[2:]
    return sums.reshape(shape), counts.reshape(parts, n_entries)


def _drifted(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each part and entry, its own move and the largest of the others'."""
    move = np.sqrt(((new - old).astype(float) ** 2).sum(axis=2))
    others = np.stack([np.delete(move, e, axis=1).max(axis=1, initial=0.0) for e in range(move.shape[1])], axis=1)
    return move + others


def encode_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(id_col, label_col as text, code, error of each kept vector; the codebooks, parts x entries x components).

    Vectors that are null, or hold null or non-finite components, are dropped; so are empty ones and those of
    another length than the vector of the smallest kept id, which nothing could be compared with. A component x
    counts as floor(256 * x); beyond 131072 in size it is an error. A length that parts does not divide is an
    error too. Codebooks start from the vectors of the smallest ids, each id once (of several rows with an id, by
    their smallest vector; a null id comes last); with fewer ids than entries, codebooks are that small. Repeated rows
    are coded alike and count each. Without kept vectors the result is empty, and codebooks have no entries.
    """
    kept = _kept(vectors, id_col, vector_col, label_col)
    first = kept.filter(F.size("x") > 0).orderBy(F.col("id").asc_nulls_last(), "x").limit(1).collect()
    names = [F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"]
    if not first:
        return vectors.sparkSession.createDataFrame([], "id long, label string, code string, error long").select(*names), np.zeros((parts, 0, 0), np.int64)
    length = len(first[0]["x"])
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    kept = kept.filter(F.size("x") == length)
    ids = kept.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries)
    start = kept.join(F.broadcast(ids.withColumnRenamed("id", "start")), F.col("id").eqNullSafe(F.col("start"))).groupBy("id").agg(F.min("x").alias("x"))
    rows = start.orderBy(F.col("id").asc_nulls_last()).collect()  # as many as a codebook has entries
    codebooks = _parted(np.array([r["x"] for r in rows], np.int64), parts)
    drift, sums, counts = np.zeros(codebooks.shape[:2]), np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)

    blocks = kept.mapInArrow(_first_round(codebooks), _BLOCK)
    for _ in range(rounds):
        blocks = materialize(blocks, "vector-blocks")
        more, n = _added(blocks, codebooks.shape)
        sums, counts = sums + more, counts + n
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], codebooks)
        drift, codebooks = drift + _drifted(codebooks, new), new
        last, blocks = blocks, blocks.mapInArrow(_next_round(codebooks, drift), _BLOCK)
    if not rounds:
        last = materialize(blocks, "vector-blocks")
    return last.mapInArrow(_coded(codebooks, drift), "id long, label string, code string, error long").select(*names), codebooks


def decode_codes(codes: DataFrame, codebooks: np.ndarray, code_col: str = "code") -> DataFrame:
    """codes with the vector that each code stands for, as array<double>, in the column decoded; a null code gives null."""
    books = codebooks / SCALE

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(decoded=[None if c is None else np.concatenate([books[p][e] for p, e in enumerate(bytes.fromhex(c))]) for c in frame[code_col]])

    codes = codes.drop("decoded")
    return codes.mapInPandas(decode, T.StructType([*codes.schema.fields, T.StructField("decoded", T.ArrayType(T.DoubleType()))]))


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of embeddings in 16 parts of 64 entries after two rounds; see encode_vectors."""
    codes, codebooks = encode_vectors(read_table(spark, sf_dir, "embeddings"))
    codes = materialize(codes, "vector-codes")
    by_label = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    by_label = F.broadcast(by_label) if by_label.count() <= BROADCAST_LABELS else by_label
    out = codes.join(by_label, codes["label"].eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds written out in DuckDB SQL."""
    steps, book = [], "b0"
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (SELECT x.r, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN {book} b USING (p, j) GROUP BY x.r, x.p, b.e),
a{k} AS (SELECT r, p, m % {entries} AS e, m // {entries} AS d FROM (SELECT r, p, min(d * {entries} + e) AS m FROM d{k} GROUP BY r, p))""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT x.p, a.e, x.j, sum(x.c) AS s, count(*) AS n FROM x JOIN a{k} a USING (r, p) GROUP BY x.p, a.e, x.j),
b{k + 1} AS (SELECT b.p, b.e, b.j, CASE WHEN n IS NULL THEN b.c ELSE (s - ((s % n) + n) % n) // n END AS c FROM {book} b LEFT JOIN m{k} m USING (p, e, j))""")
            book = f"b{k + 1}"
    return f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(embedding) > 0),
x AS (SELECT r, vec_id, (i - 1) // (n // {parts}) AS p, (i - 1) % (n // {parts}) AS j, CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT) AS c
  FROM (SELECT r, vec_id, len(embedding) AS n, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM kept)),
b0 AS (SELECT p, e, j, c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM kept ORDER BY vec_id LIMIT {entries})) USING (vec_id)),{",".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) FROM {book}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


OP12_SQL = _sql()

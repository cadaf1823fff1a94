"""Embedding of chunks in batches, behind a small protocol."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

BATCH = 50
DIMENSIONS = 768
#: Vectors of texts, in their order.
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(texts: list[str]) -> np.ndarray:
    """Deterministic stand-in: signed counts of hashed words."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, t in zip(out, texts, strict=True):
        for w in t.split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            row[h % DIMENSIONS] += 1.0 if h >> 63 else -1.0
    return out


def embed(rows: DataFrame, embedder: Embedder = hashing_embedder, text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """rows with embedding, a unit vector of each text; calls of at most batch texts, and a failed call fails the job."""
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType(), False))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].copy()
                found = embedder(part[text_col].fillna("").tolist())
                length = np.linalg.norm(found, axis=1, keepdims=True)
                part["embedding"] = list(np.divide(found, length, out=found.copy(), where=length > 0).astype(np.float32))
                yield part

    return rows.mapInPandas(run, schema)


def embed_query(query: str, embedder: Embedder = hashing_embedder) -> list[float]:
    """The unit vector of one query text."""
    found = np.asarray(embedder([query])[0], float)
    length = float(np.linalg.norm(found))
    return (found / length if length else found).tolist()


def batch_numbers(rows: DataFrame, order: str, batch: int = BATCH) -> DataFrame:
    """batch_no, size and last_id of batches in the order of a key.

    Keys are dealt by range and kept with their partition's number, since a second run of the deal could
    draw other borders; then only a count for each partition meets in one window.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.select(F.col(order).alias("key")).repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "batch-keys")
    within = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    numbered = ranged.withColumn("within", within).join(F.broadcast(starts), "part")  # a row a partition
    place = F.floor((F.col("start") + F.col("within") - 1) / batch)
    return numbered.groupBy(place.cast("long").alias("batch_no")).agg(F.count("*").alias("size"), F.max("key").alias("last_id"))

"""Quality classifier by compression.

Two zstandard dictionaries are built, from labelled good and bad texts. A text is compressed in blocks
with either; the difference of the two sizes, normalised by their sum and by the size of the text, is
calibrated to a probability on labelled texts that the dictionaries have not seen. Blocks keep the
dictionary in play to the end of a long text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize, read_table

#: Bounds of the labelled sample: rows of each class, and blocks of their texts that its dictionary is built from.
SAMPLE_ROWS, SAMPLE_BLOCKS = 1_500, 6_000
DICTIONARY_BYTES = 384 << 10
BLOCK_BYTES = 2048
LEVEL = 3
FOLDS = 5
THRESHOLD = 0.3


@dataclass
class CompressionModel:
    """Two dictionaries of at most DICTIONARY_BYTES and the calibration of their difference."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...] = ()

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def score(self, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sizes @ self.weights[:-1] + self.weights[-1], -30, 30)))


def blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


def features(text: str, compressors: list[zstandard.ZstdCompressor]) -> tuple[float, float]:
    """(bad - good) / (bad + good) and (bad - good) / bytes of the compressed sizes. An empty text gives zeros."""
    parts = blocks(text)
    if not parts:
        return 0.0, 0.0
    good, bad = (sum(len(c.compress(b)) for b in parts) for c in compressors)
    n = sum(map(len, parts))
    return (bad - good) / (bad + good), (bad - good) / n


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a light ridge, by Newton's method; the intercept comes last."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    design, ridge = np.column_stack([(x - mean) / scale, np.ones(len(x))]), np.array([0.1] * x.shape[1] + [1e-6])
    beta = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    slopes = beta[:-1] / scale
    return *map(float, slopes), float(beta[-1] - slopes @ mean)


def own_lines(blocks_of: dict[int, list[tuple[int, bytes]]]) -> dict[int, list[bytes]]:
    """Each class's blocks (id, bytes) without the lines that blocks of several ids share, which would pass for a mark of the class."""
    ids: dict[bytes, set[int]] = defaultdict(set)
    for i, block in chain.from_iterable(blocks_of.values()):
        for line in block.split(b"\n"):
            ids[line].add(i)
    left = {y: [b"\n".join(line for line in block.split(b"\n") if len(ids[line]) < 2) for _, block in some] for y, some in blocks_of.items()}
    return {y: [block for block in some if len(block) >= 8] for y, some in left.items()}


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to choose from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples) or b"\n" * 8


def _blocks_of(texts: DataFrame) -> DataFrame:
    """id, y, at, block: all blocks of each text."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, y, k, block) for i, y, text in zip(frame["id"], frame["y"], frame["text"], strict=True) for k, block in enumerate(blocks(text))]
            yield pd.DataFrame(rows, columns=["id", "y", "at", "block"])

    return texts.select("id", "y", "text").mapInPandas(cut, "id long, y int, at long, block binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_blocks: int = SAMPLE_BLOCKS) -> CompressionModel | None:
    """Fits the model on a bounded sample of labelled rows, of whatever length.

    Takes up to sample_rows ids of each class, in the order of a hash. Two thirds go to the dictionaries,
    with up to sample_blocks of the blocks of their texts a class, again in the order of a hash, without
    lines that texts share; one third goes to calibration, each text whole, weighted by the classes'
    shares among all labels. Null ids, labels and texts and empty texts are left out; an id labelled
    twice counts by its lower label, and one with several texts by the least of them. None if a class
    has fewer than three texts.
    """
    spark = docs.sparkSession
    labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    labels = labels.groupBy("id").agg(F.min("y").alias("y"))
    share = {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}
    picked = [labels.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for y in (0, 1)]
    picked_rows = [(r["id"], r["y"]) for part in picked for r in part.collect()]
    if not picked_rows:
        return None
    ids = F.broadcast(spark.createDataFrame(picked_rows, labels.schema))  # at most 2 * sample_rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id")
    texts = texts.filter(F.octet_length("text") > 0).groupBy("id", "y").agg(F.min("text").alias("text"))
    texts = materialize(texts, "labelled")
    of: dict[int, list[int]] = {0: [], 1: []}
    for r in texts.select("id", "y").orderBy("id").collect():  # at most 2 * sample_rows
        of[r["y"]].append(r["id"])
    if min(map(len, of.values())) < 3:
        return None
    parts = [(i, k % 3 == 0) for y in (0, 1) for k, i in enumerate(of[y])]
    texts = texts.join(F.broadcast(spark.createDataFrame(parts, "id long, calibrates boolean")), "id")
    every = _blocks_of(texts.filter("not calibrates"))
    some = {y: every.filter(F.col("y") == y).orderBy(F.xxhash64("id", "at"), "id", "at").limit(sample_blocks).collect() for y in (0, 1)}
    own = own_lines({y: sorted((r["id"], bytes(r["block"])) for r in rows) for y, rows in some.items()})
    model = CompressionModel(dictionary(own[1]), dictionary(own[0]))

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressors = model.compressors()
        for frame in frames:
            found = np.array([features(t, compressors) for t in frame["text"]], float).reshape(-1, 2)
            yield pd.DataFrame({"id": frame["id"], "y": frame["y"], "by_sum": found[:, 0], "by_size": found[:, 1]})

    rest = texts.filter("calibrates").select("id", "y", "text").mapInPandas(measured, "id long, y int, by_sum double, by_size double").orderBy("id").collect()
    y, weight = np.array([r["y"] for r in rest]), np.array([share[r["y"]] / len(of[r["y"]]) for r in rest])
    model.weights = _calibrate(np.array([(r["by_sum"], r["by_size"]) for r in rest]), y.astype(float), weight / weight.mean())
    return model


def score(docs: DataFrame, model: CompressionModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column quality_score from 0 to 1 appended; texts are scored whole.

    Null and empty texts get the calibrated score of zeros. Without a model every score is 0.5.
    A column of that name in docs is replaced.
    """
    docs = docs.drop("quality_score")
    if model is None:
        return docs.withColumn("quality_score", F.lit(0.5))

    @F.pandas_udf("double")
    def scored(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = model.compressors()
        for texts in frames:
            yield pd.Series(model.score(np.array([features(t or "", compressors) for t in texts], dtype=float).reshape(-1, 2)))

    return docs.withColumn("quality_score", scored(F.col(text_col).cast("string")))


def keep_good(docs: DataFrame, model: CompressionModel | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least threshold, with the columns of docs."""
    return score(docs, model, id_col, text_col).filter(F.col("quality_score") >= threshold).select(*docs.columns)


def trained(spark: SparkSession, sf_dir: str) -> CompressionModel | None:
    """The model of the labels outside the held-out fold."""
    labels = read_table(spark, sf_dir, "labels").filter(crc_mod("doc_id", FOLDS) != 0)
    return fit(read_table(spark, sf_dir, "documents"), labels)


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents. A null id is in the held-out fold; null and empty texts are scored as zeros are; see fit and score."""
    out = score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), trained(spark, sf_dir))
    return out.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))

"""Exact top-k by cosine over pages of vectors that bounds allow to skip.

Vectors lie in pages: rows of one cluster whose angles from the cluster's centre are close, in the order of these
angles. A query at angle a from a centre is at least a - high and low - a from all of a page whose angles lie
between low and high (the triangle inequality on the sphere), so once k rows are known, pages farther than the k-th
are not read. Each query first reads the nearest pages that hold k rows together, then whatever these leave open.

Queries go to pages, not rows to queries: a page is read once for all of its queries, and a page with very many is
sent out several times. The catalogue of pages is what is broadcast; pages grow with the table, so that
there are MAX_PAGES at most, about 50 bytes each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .retrieval import TOP_K, rounded, usable_vectors

#: Rows of a page at least, and pages at most.
PAGE_ROWS, MAX_PAGES = 256, 400_000
#: Clusters at most, and rows for each that centres are fitted on.
MAX_CLUSTERS, SAMPLE_ROWS = 1_024, 32
#: Queries that one copy of a page is sent.
PAGE_QUERIES = 4_096
#: Visits that are sent on at once, and distances that a task holds at once.
SENT_VISITS, HELD_DISTANCES = 1 << 14, 1 << 20
#: Angles are known up to this; the arc cosine of nearly equal vectors loses half the digits.
SLACK = 1e-6
#: Distances are told apart up to so many digits, then ids.
DIGITS = 12

_PAGE = "page long, cluster int, low double, high double, ids array<long>, vectors binary"


@dataclass
class PagedVectors:
    """pages (page, cluster, low, high, ids, vectors), the centres of clusters, and the number of rows."""

    pages: DataFrame
    centres: np.ndarray
    n_rows: int

    @property
    def dimensions(self) -> int:
        return self.centres.shape[1]


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centres(sample: np.ndarray, n: int, turns: int = 4) -> np.ndarray:
    """Directions of n clusters of a sample of unit vectors: rows far apart to begin with, then their neighbourhoods' means."""
    picked, far = [0], sample @ sample[0]
    while len(picked) < min(n, len(sample)):
        picked.append(int(far.argmin()))
        far = np.maximum(far, sample @ sample[picked[-1]])
    centres = sample[picked]
    for _ in range(turns):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        fresh = _unit(sums)
        centres = np.where((fresh != 0).any(axis=1, keepdims=True), fresh, centres)
    return centres


def _placed(centres: np.ndarray):
    """Each vector's cluster and its angle from the centre; vectors of length zero have cluster -1."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column("e")))
            cosines = unit @ centres.T
            cluster = cosines.argmax(axis=1).astype(np.int32)
            angle = np.arccos(np.clip(cosines[np.arange(len(unit)), cluster], -1, 1))
            zero = ~unit.any(axis=1)
            cluster[zero], angle[zero] = -1, math.pi / 2
            packed = pa.array([v.tobytes() for v in unit], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster), pa.array(angle), packed], names=["id", "cluster", "angle", "unit"])

    return place


def _paged(page_rows: int):
    """Pages of rows that come in the order of cluster and angle."""

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            cluster, angle = batch.column("cluster").to_numpy(), batch.column("angle").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(cluster)) + 1, [len(cluster)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for at in range(a, b, page_rows):
                    own = slice(at, min(at + page_rows, b))
                    row = [(part << 32) + n, int(cluster[at]), float(angle[own].min()), float(angle[own].max()), batch.column("id")[own].to_pylist(), b"".join(batch.column("unit")[own].to_pylist())]
                    types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["page", "cluster", "low", "high", "ids", "vectors"])
                    n += 1

    return page


def page_vectors(rows: DataFrame, id_col: str, embedding_col: str = "embedding", page_rows: int = PAGE_ROWS, clusters: int | None = None) -> PagedVectors:
    """rows laid out for search_pages. Rows without an id, a vector or finite components take no part, nor do those of
    another length than the smallest id's. Centres are fitted on SAMPLE_ROWS rows a cluster, those with the
    smallest hashes of their ids; all rows are laid out.
    """
    rows = usable_vectors(rows, id_col, embedding_col)
    first = rows.orderBy("id", "e").select(F.size("e").alias("n")).first()
    if first is None:
        return PagedVectors(rows.sparkSession.createDataFrame([], _PAGE), np.zeros((0, 0)), 0)
    rows = materialize(rows.filter(F.size("e") == first["n"]), "vectors")
    n_rows = rows.count()
    clusters = clusters or min(MAX_CLUSTERS, max(1, int(n_rows**0.5 / 2)))
    held = rows.orderBy(F.xxhash64("id"), "id").limit(clusters * SAMPLE_ROWS).select("e").collect()
    sample = _unit(np.array([r["e"] for r in held], float))
    sample = sample[sample.any(axis=1)] if sample.any() else np.eye(1, first["n"])
    centres = _centres(sample, clusters)
    placed = rows.mapInArrow(_placed(centres), "id long, cluster int, angle double, unit binary")
    ordered = placed.repartitionByRange("cluster", "angle", "id").sortWithinPartitions("cluster", "angle", "id")
    pages = ordered.mapInArrow(_paged(max(page_rows, -(-n_rows // MAX_PAGES))), _PAGE)
    return PagedVectors(materialize(pages, "pages"), centres, n_rows)


@dataclass
class _Catalogue:
    """The pages' numbers, clusters, angles and sizes, and the clusters' centres."""

    page: np.ndarray
    cluster: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    centres: np.ndarray

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The least angle that each page's rows can have from a query."""
        angle = np.append(np.arccos(np.clip(self.centres @ query, -1, 1)), math.pi / 2)[self.cluster]  # the last for cluster -1
        own = np.maximum(np.maximum(angle - self.high, self.low - angle), 0.0)
        own[self.cluster < 0] = math.pi / 2
        return own - SLACK


def _to_pages(catalogue: _Catalogue, k: int, first: bool):
    """(page, query, e) for the pages that each query is to read: first the nearest that hold k rows, then all others as near as worst."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pages, owners, held = [], [], 0

            def visits(frame: pd.DataFrame, pages: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pd.DataFrame]:
                page, at = np.concatenate(pages), np.concatenate(owners)
                for a in range(0, len(at), SENT_VISITS):  # a query alone may have as many as there are pages
                    own = slice(a, a + SENT_VISITS)
                    yield pd.DataFrame({"page": page[own], "query": frame["query"].to_numpy()[at[own]], "e": frame["e"].to_numpy()[at[own]]})

            for at, (e, worst) in enumerate(zip(frame["e"], frame["worst"], strict=True)):
                bounds = catalogue.bounds(np.frombuffer(e))
                order = np.argsort(bounds, kind="stable")
                home = int(np.searchsorted(np.cumsum(catalogue.n[order]), k)) + 1
                wanted = order[:home] if first else order[home:][bounds[order[home:]] <= worst]
                pages.append(catalogue.page[wanted])
                owners.append(np.full(len(wanted), at))
                held += len(wanted)
                if held >= SENT_VISITS:
                    yield from visits(frame, pages, owners)
                    pages, owners, held = [], [], 0
            if pages:
                yield from visits(frame, pages, owners)

    return send


def _read_pages(k: int):
    """The k nearest rows of a page to each of its queries, and how many rows were read for it."""
    columns = ["query", "ids", "distances", "n_read"]

    def read(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(pages) or not len(queries):
            return pd.DataFrame({c: [] for c in columns}).astype({"query": "int64", "n_read": "int64"})
        ids = np.asarray(pages["ids"].iloc[0], np.int64)
        x = np.frombuffer(pages["vectors"].iloc[0]).reshape(len(ids), -1)
        asked, rows, step = np.stack([np.frombuffer(e) for e in queries["e"]]), [], max(1, HELD_DISTANCES // len(ids))
        for at in range(0, len(asked), step):
            for query, own in zip(queries["query"].iloc[at : at + step].tolist(), 1.0 - asked[at : at + step] @ x.T, strict=True):
                best = np.lexsort((ids, np.round(own, DIGITS)))[:k]
                rows.append((query, ids[best], own[best], len(ids)))
        return pd.DataFrame(rows, columns=columns)

    return read


def _visited(paged: PagedVectors, sent: DataFrame, k: int) -> DataFrame:
    """query, ids, distances, n_read for each page that each query was sent to. A page goes out once for each PAGE_QUERIES of its queries."""
    sent = materialize(sent, "visits")
    copies = sent.groupBy("page").count().select("page", F.ceil(F.col("count") / PAGE_QUERIES).cast("int").alias("copies"))
    share = F.pmod(F.xxhash64("query"), F.col("copies")).cast("int")
    queries = sent.join(copies, "page").select("page", share.alias("copy"), "query", "e")
    pages = paged.pages.select("page", "ids", "vectors").join(copies, "page")
    pages = pages.select("page", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "ids", "vectors")
    out = pages.groupBy("page", "copy").cogroup(queries.groupBy("page", "copy")).applyInPandas(_read_pages(k), "query long, ids array<long>, distances array<double>, n_read long")
    return materialize(out, "nearest")


def _ranked(visited: DataFrame, k: int) -> DataFrame:
    """query, rank, id, distance of the k nearest over all pages."""
    spread = visited.select("query", F.explode(F.arrays_zip("ids", "distances")).alias("x")).select("query", F.col("x.ids").alias("id"), F.col("x.distances").alias("distance"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", DIGITS), "id"))
    return spread.withColumn("rank", place).filter(F.col("rank") <= k)


def search_pages(paged: PagedVectors, queries: DataFrame, query_col: str, k: int = TOP_K, embedding_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(query_col, rank, id, distance) of the k nearest rows to each query (query_col, embedding_col), ties by id; and
    (query_col, n_read): how many rows were read for each.

    Queries without an id, a vector or finite components find nothing, nor do those of another length than the
    rows; a query id is asked once, by its smallest vector. A query of length zero is at distance 1 from everything,
    and finds the smallest ids without reading.
    """
    spark = queries.sparkSession
    asked = usable_vectors(queries, query_col, embedding_col).filter(F.size("e") == paged.dimensions).groupBy("id").agg(F.min("e").alias("e")) if paged.n_rows else None
    if asked is None:
        none = spark.createDataFrame([], "query long, rank int, id long, distance double, n_read long").withColumnRenamed("query", query_col)
        return none.drop("n_read"), none.select(query_col, "n_read")
    held = paged.pages.select("page", "cluster", "low", "high", F.size("ids").alias("n")).orderBy("page").toPandas()  # MAX_PAGES rows at most, and one for each cluster and partition
    catalogue = _Catalogue(held["page"].to_numpy(), held["cluster"].to_numpy(), held["low"].to_numpy(), held["high"].to_numpy(), held["n"].to_numpy(), paged.centres)

    def unit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                e = _unit(np.stack(frame["e"].to_list()).astype(float))
                yield pd.DataFrame({"query": frame["id"], "e": [v.tobytes() for v in e], "zero": ~e.any(axis=1)})

    numbered = materialize(asked.mapInPandas(unit, "query long, e binary, zero boolean"), "queries")
    ready = numbered.filter("not zero").select("query", "e")
    sent = ready.withColumn("worst", F.lit(0.0)).mapInPandas(_to_pages(catalogue, k, True), "page long, query long, e binary")
    home = _visited(paged, sent, k)
    worst = _ranked(home, k).groupBy("query").agg(F.max("distance").alias("d"), F.count("*").alias("n"))
    # The angle of the k-th; without k rows at all everything is to be read.
    angle = F.when(F.col("n") >= k, F.acos(F.greatest(F.least(F.lit(1.0) - F.col("d"), F.lit(1.0)), F.lit(-1.0)))).otherwise(F.lit(math.pi))
    open_ = ready.join(worst.select("query", angle.alias("worst")), "query")
    rest = _visited(paged, open_.mapInPandas(_to_pages(catalogue, k, False), "page long, query long, e binary"), k)
    visited = home.unionByName(rest)
    found = _ranked(visited, k)
    zero = numbered.filter("zero").select("query")
    if not zero.isEmpty():
        first_ids = [r["id"] for r in paged.pages.select(F.explode("ids").alias("id")).orderBy("id").limit(k).collect()]
        ranks = zero.select("query", F.posexplode(F.lit(first_ids)).alias("rank", "id"))
        found = found.unionByName(ranks.select("query", "id", F.lit(1.0).alias("distance"), (F.col("rank") + 1).alias("rank")))
    read = numbered.select("query").join(visited.groupBy("query").agg(F.sum("n_read").alias("n_read")), "query", "left")
    return (
        found.select(F.col("query").alias(query_col), "rank", "id", rounded(F.col("distance")).alias("distance")),
        read.select(F.col("query").alias(query_col), F.coalesce("n_read", F.lit(0)).alias("n_read")),
    )

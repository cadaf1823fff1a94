"""Exact vector search and the rendering of what it finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import materialize
from .embedding import Embedder, embed, embed_query

TOP_K = 4
#: Queries that go to all rows at once.
QUERY_BLOCK = 1_024


def rounded(distance: Column) -> Column:
    """To four places; no negative zero."""
    return F.round(distance, 4) + F.lit(0.0)


def with_distance(rows: DataFrame, query: Column, embedding_col: str = "embedding") -> DataFrame:
    """rows with the cosine distance of their vectors from query, in double precision."""
    return rows.withColumn("distance", vectors.cosine_distance(vectors.as_double(F.col(embedding_col)), query))


def top_k(rows: DataFrame, query: list[float], id_col: str, k: int = TOP_K, embedding_col: str = "embedding") -> DataFrame:
    """The k nearest rows, ties by id: every partition brings its k, one merge picks among them."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    nearest = with_distance(rows, literal, embedding_col).orderBy("distance", id_col).limit(k)
    return nearest.withColumn("distance", rounded(F.col("distance")))


def top_k_per_key(rows: DataFrame, queries: DataFrame, key: str, id_col: str, k: int = TOP_K, embedding_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each key to that key's query vector (key, query)."""
    near = with_distance(rows.join(queries, key), vectors.as_double(F.col("query")), embedding_col)
    place = F.row_number().over(Window.partitionBy(key).orderBy("distance", id_col))  # limited in each partition before the shuffle
    return near.withColumn("rank", place).filter(F.col("rank") <= k).withColumn("distance", rounded(F.col("distance"))).drop("query")


def usable_vectors(rows: DataFrame, id_col: str, embedding_col: str) -> DataFrame:
    """id and e (in double precision) of rows with an id and a vector of finite components."""
    found = rows.select(F.col(id_col).cast("long").alias("id"), vectors.as_double(F.col(embedding_col)).alias("e"))
    finite = F.forall("e", lambda x: F.coalesce((x < float("inf")) & (x > float("-inf")), F.lit(False)))
    return found.filter(F.col("id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & finite)


def search_many(rows: DataFrame, queries: DataFrame, id_col: str, query_col: str, k: int = TOP_K, embedding_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_col, rank, id_col, distance: the k nearest rows to each of queries (query_col, embedding_col), ties by id.

    Queries go to all rows in blocks of a fixed size, which bounds what is sent. A partition brings the
    k best for each query of a block, and what the partitions bring is ranked by query. Queries and rows without
    an id, a vector or finite components take no part, nor do rows of another length than a query.
    """
    found: DataFrame | None = None
    asked = usable_vectors(queries, query_col, embedding_col)
    numbered = asked.select(F.col("id").alias("query"), "e", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // block)))).alias("block"), F.size("e").alias("length"))
    numbered = materialize(numbered, "queries")
    usable = usable_vectors(rows, id_col, embedding_col)
    for number, length in sorted((r["block"], r["length"]) for r in numbered.select("block", "length").distinct().collect()):
        held = numbered.filter((F.col("block") == number) & (F.col("length") == length)).orderBy("query").collect()  # about block rows
        source = usable.filter(F.size("e") == length)
        ids, matrix = np.array([r["query"] for r in held], np.int64), _unit(np.array([r["e"] for r in held], float))

        def nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                at = batch.column("id").to_numpy()
                e = np.array(batch.column("e").flatten()).reshape(len(batch), -1)
                for a in range(0, len(at), 1024):
                    near, own = 1.0 - _unit(e[a : a + 1024]) @ matrix.T, at[a : a + 1024]
                    d = np.concatenate([best_d, near.T], axis=1)
                    i = np.concatenate([best_i, np.broadcast_to(own, near.T.shape)], axis=1)
                    order = np.lexsort((i, np.round(d, 12)))[:, :k]
                    best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            there = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], there.shape)[there]), pa.array(best_i[there]), pa.array(best_d[there])], names=["query", "id", "distance"])

        part = source.mapInArrow(nearest, "query long, id long, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query long, id long, distance double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 12), "id"))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_col), "rank", F.col("id").alias(id_col), rounded(F.col("distance")).alias("distance"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays, and is at distance 1 from everything."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=x.copy(), where=length > 0)


def retrieve(chunks: DataFrame, project: int, query: str, embedder: Embedder, k: int = TOP_K) -> DataFrame:
    """The k chunks of a project (project_id, chunk_key, filepath, start_line, end_line, symbol_type, text, embedding) nearest to a query text.

    A project without chunks gives no rows, and its query is not embedded.
    """
    own = chunks.filter(F.col("project_id") == project)
    columns = ("filepath", "start_line", "end_line", "symbol_type", F.col("text").alias("code"), "chunk_key")
    if own.isEmpty():
        return own.limit(0).select(*columns, F.lit(0.0).alias("distance"))
    return top_k(own, embed_query(query, embedder), "chunk_key", k).select(*columns, "distance")


def retrieve_text(chunks: DataFrame, project: int, query: str, embedder: Embedder, k: int = TOP_K) -> str:
    """What retrieve finds, as one text; '' for nothing."""
    found = retrieve(chunks, project, query, embedder, k)
    made = found.withColumn("snippet", snippet(F.col("filepath"), F.col("start_line"), F.col("end_line"), F.col("code")))
    return render_context(made).first()["context"]


def retrieve_many(chunks: DataFrame, requests: DataFrame, embedder: Embedder, k: int = TOP_K) -> DataFrame:
    """request_id and context, the text that retrieve_text gives, for each of requests (request_id, project_id, query).

    Requests are embedded in batches and meet the chunks of their project; k chunks a request are kept
    in each partition before they are ranked. Requests of projects without chunks get '' and are not embedded. A null
    project has no chunks, and a null query counts as empty.
    """
    indexed = requests.join(chunks.select("project_id").distinct(), "project_id", "left_semi")
    asked = embed(indexed.select("request_id", F.col("project_id").alias("of"), F.coalesce("query", F.lit("")).alias("text")), embedder)
    asked = materialize(asked.select("request_id", "of", F.col("embedding").alias("query")), "requests")
    own = chunks.join(asked, chunks["project_id"] == asked["of"])
    near = with_distance(own, vectors.as_double(F.col("query")))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("distance", "chunk_key"))
    found = near.withColumn("rank", place).filter(F.col("rank") <= k)
    found = found.select("request_id", "rank", snippet(F.col("filepath"), F.col("start_line"), F.col("end_line"), F.col("text")).alias("snippet"))
    parts = F.sort_array(F.collect_list(F.struct("rank", "snippet")))  # at most k rows
    contexts = found.groupBy(F.col("request_id").alias("found_id")).agg(F.array_join(parts["snippet"], "\n\n").alias("context"))
    joined = requests.join(contexts, requests["request_id"].eqNullSafe(F.col("found_id")), "left")
    return joined.select("request_id", F.coalesce("context", F.lit("")).alias("context"))


def snippet(filepath: Column, start: Column, end: Column, code: Column) -> Column:
    """One retrieved chunk as text; lines only where both are known."""
    lines = F.when((start != 0) & (end != 0), F.concat(F.lit(" (Lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("--- Code Snippet from "), filepath, lines, F.lit(" ---\n"), code, F.lit("\n"))


def render_context(found: DataFrame, snippet_col: str = "snippet", order: tuple[str, ...] = ("distance", "chunk_key")) -> DataFrame:
    """One row: the snippets found, nearest first."""
    parts = F.sort_array(F.collect_list(F.struct(*order, snippet_col)))  # at most k rows
    return found.agg(F.array_join(F.transform(parts, lambda p: p[snippet_col]), "\n\n").alias("context"))

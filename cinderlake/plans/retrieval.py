"""Vector search over embeddings, and the batches that embed texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import embedding, pruned_search, retrieval
from ..sources.tables import table


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the smallest id, as the query a caller would bring."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.top_k(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), "vec_id")
    return found.select("vec_id", "label", "distance")


def vector_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    firsts = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query"))
    return retrieval.top_k_per_key(rows, firsts, "label", "vec_id").select("label", "rank", "vec_id", "distance")


def vector_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 50, each against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.search_many(rows, queries, "vec_id", "query_id")


def vector_search_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as vector_search_many, over pages that are skipped by their bounds."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found, _ = pruned_search.search_pages(pruned_search.page_vectors(rows, "vec_id"), queries, "query_id")
    return found.withColumnRenamed("id", "vec_id")


def vector_search_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows vector_search_pruned reads for each query, of how many."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    paged = pruned_search.page_vectors(rows, "vec_id")
    return pruned_search.search_pages(paged, queries, "query_id")[1].withColumn("n_rows", F.lit(paged.n_rows).cast("long"))


def _fixed_embedder(vector: list[float]) -> embedding.Embedder:
    return lambda texts: np.tile(np.array(vector, np.float64), (len(texts), 1))


def retrieve_in_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for projects: the context of each label, and of one that has no chunks."""
    rows = table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    chunks = rows.select(
        F.col("label").alias("project_id"), F.col("vec_id").alias("chunk_key"), path.alias("filepath"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"),
        F.lit("").alias("symbol_type"), F.col("label").cast("string").alias("text"), "embedding",
    )
    asked = rows.select("label").distinct().unionByName(spark.createDataFrame([(-1,)], "label int"))
    requests = asked.select(F.col("label").alias("request_id"), F.col("label").alias("project_id"), F.lit("any").alias("query"))
    out = retrieval.retrieve_many(chunks, requests, _fixed_embedder(_query(spark, sf_dir)))
    return out.withColumnRenamed("request_id", "label")


def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vectors.normalize(vectors.as_double(F.col("embedding")))
    rows = table(spark, sf_dir, "embeddings").withColumn("unit", unit)
    return rows.select("vec_id", F.round(vectors.norm(F.col("unit")), 4).alias("unit_norm"), (F.round(F.get("unit", F.lit(0)), 4) + F.lit(0.0)).alias("first"))


def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.top_k(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), "vec_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # At most k rows are found, so they are the side to send out.
    joined = docs.join(F.broadcast(found), F.col("doc_id") == F.col("vec_id"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    lines = F.when(F.col("doc_id") % 2 == 0, F.lit(0)).otherwise(F.lit(1))
    made = joined.select("distance", F.col("doc_id").alias("chunk_key"), retrieval.snippet(path, lines, F.lit(9), F.col("text")).alias("snippet"))
    return retrieval.render_context(made)


def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.batch_numbers(table(spark, sf_dir, "documents"), "doc_id")


def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document embedded by the offline stand-in, with what can be said of a vector in short."""
    rows = embedding.embed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    v = vectors.as_double(F.col("embedding"))
    return rows.select("doc_id", F.size("embedding").alias("dimensions"), F.round(vectors.norm(v), 4).alias("length"), F.xxhash64("embedding").alias("embedding_hash"))


_DISTANCE = "CASE WHEN list_dot_product(e, e) = 0 OR list_dot_product(q, q) = 0 THEN 1.0 ELSE 1.0 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) END"
_TOP_K = f"""
  SELECT vec_id, label, round(d, 4) + 0.0::DOUBLE AS distance FROM (
    SELECT vec_id, label, {_DISTANCE} AS d
    FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, (SELECT arg_min(embedding, vec_id)::DOUBLE[] FROM embeddings) AS q FROM embeddings))
  ORDER BY d, vec_id LIMIT 4"""
_SEARCH = f"""
SELECT query_id, "rank", vec_id, round(d, 4) + 0.0::DOUBLE AS distance FROM (
  SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 12), vec_id)::INT AS "rank"
  FROM (SELECT query_id, vec_id, {_DISTANCE} AS d
        FROM (SELECT f.vec_id AS query_id, x.vec_id, x.embedding::DOUBLE[] AS e, f.embedding::DOUBLE[] AS q FROM embeddings x, embeddings f WHERE f.vec_id % 50 = 0)))
WHERE "rank" <= 4"""

QUERIES = {
    "vector_topk_cosine": (vector_topk_cosine, _TOP_K),
    "vector_topk_per_label": (
        vector_topk_per_label,
        f"""
SELECT label, "rank", vec_id, round(d, 4) + 0.0::DOUBLE AS distance FROM (
  SELECT label, vec_id, d, row_number() OVER (PARTITION BY label ORDER BY d, vec_id)::INT AS "rank"
  FROM (SELECT label, vec_id, {_DISTANCE} AS d
        FROM (SELECT x.label, x.vec_id, x.embedding::DOUBLE[] AS e, f.q FROM embeddings x
              JOIN (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY label) f ON x.label = f.label)))
WHERE "rank" <= 4""",
    ),
    "vector_search_many": (vector_search_many, _SEARCH),
    "vector_search_pruned": (vector_search_pruned, _SEARCH),
    "vector_search_reads": (vector_search_reads, None),
    "retrieve_in_project": (
        retrieve_in_project,
        f"""
WITH near AS (
  SELECT label, vec_id, d, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS k
  FROM (SELECT vec_id, label, {_DISTANCE} AS d FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, (SELECT arg_min(embedding, vec_id)::DOUBLE[] FROM embeddings) AS q FROM embeddings)))
SELECT l.label, coalesce(string_agg('--- Code Snippet from v' || vec_id || ' (Lines 1-2) ---' || chr(10) || near.label || chr(10), chr(10) || chr(10) ORDER BY k), '') AS context
FROM (SELECT DISTINCT label FROM embeddings UNION SELECT -1) AS l(label) LEFT JOIN near ON near.label = l.label AND k <= 4 GROUP BY l.label""",
    ),
    "vector_normalize": (
        vector_normalize,
        """
SELECT vec_id, round(sqrt(list_dot_product(u, u)), 4) AS unit_norm, round(u[1], 4) + 0.0::DOUBLE AS first
FROM (SELECT vec_id, CASE WHEN n = 0 THEN e ELSE list_transform(e, lambda x: x / n) END AS u
      FROM (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))""",
    ),
    "retrieve_context": (
        retrieve_context,
        f"""
SELECT coalesce(string_agg('--- Code Snippet from ' || source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' (Lines 1-9)' END
                  || ' ---' || chr(10) || text || chr(10), chr(10) || chr(10) ORDER BY distance, doc_id), '') AS context
FROM documents JOIN ({_TOP_K}) ON doc_id = vec_id""",
    ),
    "embed_batches": (
        embed_batches,
        """
SELECT batch_no::BIGINT AS batch_no, count(*) AS size, max(doc_id) AS last_id
FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch_no FROM documents) GROUP BY batch_no""",
    ),
    "embed_documents": (embed_documents, None),
}

"""Incremental index runs: two versions of documents as stored and incoming chunks.

Every document is in both versions. Those of every third id are stored under project 2, those of every
eighth under project 3, the rest under project 1. Of the incoming ones a seventh has another path, every
eleventh a changed text, and every fifth has moved by ten lines; what was in project 3 comes to project 1,
so nothing comes to project 3. A null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import index
from ..session import materialize, shared_path
from ..sources.tables import table
from ..streaming import index as stream_index
from .chunks import sql_hash


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored and incoming chunks without their texts, from one pass over the documents."""
    k, body = F.col("doc_id"), F.coalesce("text", F.lit(""))
    project = F.when(k % 8 == 0, F.lit(3)).when(k % 3 == 0, F.lit(2)).otherwise(F.lit(1)).cast("long")
    docs = table(spark, sf_dir, "documents").select(k.alias("id"), project.alias("project_id"), F.col("source").alias("filepath"), body.alias("text"), F.size(text.split_lines(body)).alias("n_lines"))
    k, moved = F.col("id"), F.when(F.col("id") % 5 == 0, F.lit(10)).otherwise(F.lit(0))
    path = F.when(k % 7 == 0, F.concat("filepath", F.lit("/moved"))).otherwise(F.col("filepath"))
    changed = F.when(k % 11 == 0, F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text"))
    now_in = F.when(F.col("project_id") == 3, F.lit(1)).otherwise(F.col("project_id")).cast("long")
    both = docs.select("id", "project_id", "n_lines", moved.alias("moved"), now_in.alias("now_in"), text.content_hash(F.col("filepath"), F.col("text")).alias("was"), text.content_hash(path, changed).alias("now"))
    both = materialize(both, "versions")
    row = lambda n, where, digest, by: both.select(F.col("id").alias(n), F.col(where).alias("project_id"), text.chunk_id(F.col(where), F.col(digest)).alias("chunk_id"), (F.lit(1) + by).alias("start_line"), (F.col("n_lines") + by).alias("end_line"))
    return row("id", "project_id", "was", F.lit(0)), row("pos", "now_in", "now", F.col("moved"))


def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = index.diff(*_versions(spark, sf_dir)).stats()
    return stats.withColumn("summary", text.diff_summary(F.col("cached"), F.col("new"), F.col("deleted")))


def diff_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after the run: what is kept, with new lines, and what is inserted."""
    found = index.diff(*_versions(spark, sf_dir))
    kept = found.stored.select(F.lit("kept").alias("origin"), "id", "chunk_id", "start_line", "end_line")
    new = found.new.select(F.lit("new").alias("origin"), F.col("pos").alias("id"), "chunk_id", "start_line", "end_line")
    return kept.unionByName(new)


def diff_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that diff_upsert leaves, from a stream: the stored version is a first run, the incoming one a second, of which a third comes twice."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stored, incoming = _versions(spark, sf_dir)
    source, checkpoint, changes = (shared_path(spark, n) for n in ("chunk-runs", "stream", "changes"))

    def run(number: int, rows: DataFrame, place: str) -> DataFrame:
        announced = rows.select("project_id").distinct().select("project_id", *(F.lit(None).cast(t).alias(c) for c, t in (("pos", "long"), ("chunk_id", "string"), ("start_line", "int"), ("end_line", "int"))))
        chunks = rows.select("project_id", F.col(place).cast("long").alias("pos"), "chunk_id", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))
        return chunks.unionByName(announced).select("*", F.lit(number).cast("long").alias("run"), F.timestamp_seconds(F.lit(86_400 * (number + 1))).alias("event_time"))

    again = incoming.filter(F.col("pos") % 3 == 0)
    later = spark.createDataFrame([(-1,)], "project_id long").select("project_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(9).cast("long").alias("run"), F.timestamp_seconds(F.lit(86_400 * 9)).alias("event_time"))
    for number, rows in enumerate((run(0, stored, "id"), run(1, incoming, "pos").unionByName(run(1, again, "pos")), later)):
        rows.write.parquet(f"{source}/{number}")
        stream = stream_index.index_changes(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{source}/*"), buckets=8)
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(stream_index.write_changes(changes)).trigger(availableNow=True).start().awaitTermination()
    return stream_index.indexed(spark, checkpoint).select("id", "chunk_id", "start_line", "end_line")


def diff_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.diff(*_versions(spark, sf_dir)).pruned.select("project_id", "id", "chunk_id")


def diff_nothing_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run without chunks leaves the table alone."""
    stored, now = _versions(spark, sf_dir)
    found = index.diff(stored, now.limit(0))
    left = found.stored.groupBy("project_id").agg(F.count("*").alias("stored"), F.sum("id").alias("ids"))
    return found.stats().join(left, "project_id")


def index_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages of a run as it parses and embeds, one row for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    total = F.lit(docs.count())
    return docs.select("doc_id", text.percent_band(15, 30, F.col("doc_id"), total).alias("parsing"), text.percent_band(50, 40, F.col("doc_id") + 1, total).alias("embedding"), text.collection_name(F.col("doc_id")).alias("collection"))


_N_LINES = r"CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')) END"
_VERSIONS = rf"""docs AS (SELECT id, project, filepath, text, {_N_LINES} AS n FROM (SELECT doc_id AS id, CASE WHEN doc_id % 8 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS project, source AS filepath, coalesce(text, '') AS text FROM documents)),
stored AS (SELECT id, project, 'chunk_' || project || '_' || {sql_hash("filepath", "text")} AS chunk_id, 1 AS s, n AS e FROM docs),
changed AS (SELECT id, CASE WHEN project = 3 THEN 1 ELSE project END AS project, CASE WHEN id % 7 = 0 THEN filepath || '/moved' ELSE filepath END AS filepath,
                   CASE WHEN id % 11 = 0 THEN text || chr(10) || 'changed' ELSE text END AS text, n, CASE WHEN id % 5 = 0 THEN 10 ELSE 0 END AS m FROM docs),
incoming AS (SELECT id AS pos, project, 'chunk_' || project || '_' || {sql_hash("filepath", "text")} AS chunk_id, 1 + m AS s, n + m AS e FROM changed),
latest AS (SELECT chunk_id, max(id) AS id, arg_max(s, id) AS s, arg_max(e, id) AS e FROM stored GROUP BY chunk_id),
matched AS (
  SELECT i.*, l.id AS hit, coalesce(lag(i.s) OVER w, l.s) AS bs, coalesce(lag(i.e) OVER w, l.e) AS be
  FROM incoming i LEFT JOIN latest l ON i.chunk_id = l.chunk_id WINDOW w AS (PARTITION BY i.chunk_id ORDER BY i.pos)),
pruned AS (SELECT * FROM stored WHERE chunk_id NOT IN (SELECT chunk_id FROM incoming) AND project IN (SELECT project FROM incoming))"""

_UPSERT = f"""WITH {_VERSIONS}, last AS (SELECT hit, arg_max(s, pos) AS s, arg_max(e, pos) AS e FROM matched WHERE hit IS NOT NULL GROUP BY hit)
SELECT 'kept' AS origin, id, chunk_id, coalesce(l.s, k.s)::INT AS start_line, coalesce(l.e, k.e)::INT AS end_line
FROM (SELECT * FROM stored WHERE id NOT IN (SELECT id FROM pruned)) k LEFT JOIN last l ON l.hit = k.id
UNION ALL SELECT 'new', pos, chunk_id, s::INT, e::INT FROM matched WHERE hit IS NULL"""

QUERIES = {
    "diff_stats": (
        diff_stats,
        f"""WITH {_VERSIONS}, x AS (
SELECT p.project::BIGINT AS project_id, (SELECT count(*) FROM matched m WHERE m.project = p.project AND hit IS NOT NULL) AS cached, (SELECT count(*) FROM matched m WHERE m.project = p.project AND hit IS NULL) AS new,
       (SELECT count(*) FROM pruned m WHERE m.project = p.project) AS deleted, (SELECT count(*) FROM matched m WHERE m.project = p.project AND hit IS NOT NULL AND (s <> bs OR e <> be)) AS updated_lines,
       (SELECT count(DISTINCT chunk_id) FROM matched m WHERE m.project = p.project) AS active
FROM (SELECT DISTINCT project FROM stored) p)
SELECT *, cached || ' cached, ' || new || ' embedded, ' || deleted || ' pruned' AS summary FROM x""",
    ),
    "diff_upsert": (diff_upsert, _UPSERT),
    "diff_stream": (diff_stream, f"SELECT id, chunk_id, start_line, end_line FROM ({_UPSERT})"),
    "diff_prune": (diff_prune, f"WITH {_VERSIONS} SELECT project::BIGINT AS project_id, id, chunk_id FROM pruned"),
    "diff_nothing_incoming": (
        diff_nothing_incoming,
        f"WITH {_VERSIONS} SELECT project::BIGINT AS project_id, 0::BIGINT AS cached, 0::BIGINT AS new, 0::BIGINT AS deleted, 0::BIGINT AS updated_lines, 0::BIGINT AS active, count(*) AS stored, sum(id)::BIGINT AS ids FROM stored GROUP BY project",
    ),
    "index_progress": (
        index_progress,
        """SELECT doc_id, (15 + trunc(doc_id::DOUBLE / n * 30))::INT AS parsing, (50 + trunc((doc_id + 1)::DOUBLE / n * 40))::INT AS embedding, 'project_' || doc_id AS collection
FROM documents, (SELECT count(*) AS n FROM documents)""",
    ),
}

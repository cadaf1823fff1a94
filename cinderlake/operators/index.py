"""Incremental index of chunks by project: compare by content hash, keep what is stored, prune what is gone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def fingerprinted(chunks: DataFrame, project: str = "project_id") -> DataFrame:
    """chunks (project, filepath, text) with content_hash and chunk_id."""
    hashed = chunks.withColumn("content_hash", text.content_hash(F.col("filepath"), F.col("text")))
    return hashed.withColumn("chunk_id", text.chunk_id(F.col(project), F.col("content_hash")))


@dataclass
class IndexDiff:
    """Lazy parts of one incremental run over one or more projects.

    hits: incoming rows with the stored row they equal, and whether their lines moved. new: rows to embed and insert.
    pruned: stored rows whose id no longer comes. stored: what the table holds after the run, without new.
    """

    hits: DataFrame
    new: DataFrame
    pruned: DataFrame
    stored: DataFrame
    project: str
    before: DataFrame

    def stats(self) -> DataFrame:
        """For each stored or incoming project: cached, new, deleted (rows), updated_lines and active (distinct ids)."""
        part = lambda rows, kind, moved, chunk: rows.select(self.project, F.lit(kind).alias("kind"), moved.alias("moved"), chunk.alias("chunk_id"))
        no, none = F.lit(False), F.lit(None).cast("string")
        rows = part(self.hits, "cached", F.col("moved"), F.col("chunk_id")).union(part(self.new, "new", no, F.col("chunk_id")))
        rows = rows.union(part(self.pruned, "deleted", no, none)).union(part(self.before.select(self.project).distinct(), "project", no, none))
        count = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
        return rows.groupBy(self.project).agg(count("cached"), count("new"), count("deleted"), F.count_if("moved").alias("updated_lines"), F.count_distinct("chunk_id").alias("active"))


def diff(stored: DataFrame, incoming: DataFrame, project: str = "project_id") -> IndexDiff:
    """Compares stored chunks (project, id, chunk_id, start_line, end_line, ...) with incoming ones (project, pos, chunk_id, start_line, end_line, ...).

    Rows meet within their project. Of stored duplicates the largest id counts. Incoming rows with one id
    are taken in the order of pos: each is compared with the lines that the one before left, in one pass
    over that id's rows. New duplicates each count as new. A project without incoming rows is left alone.
    Both sides are read several times, so they are best narrow and written before (session.materialize).
    """
    key = [project, "chunk_id"]
    latest = stored.groupBy(*key).agg(F.max_by(F.struct("id", "start_line", "end_line"), "id").alias("hit"))
    matched = incoming.join(latest, key, "left")
    in_order = Window.partitionBy(*key).orderBy("pos")
    before = lambda c: F.coalesce(F.lag(c).over(in_order), F.col("hit")[c])
    hits = matched.filter("hit is not null").withColumns({"before_start": before("start_line"), "before_end": before("end_line")})
    moved = (F.col("start_line") != F.col("before_start")) | (F.col("end_line") != F.col("before_end"))
    hits = hits.withColumn("moved", moved)
    new = matched.filter("hit is null").drop("hit")
    ids = incoming.groupBy(*key).agg(F.max_by(F.struct("start_line", "end_line"), "pos").alias("now"))
    projects = incoming.select(F.col(project).alias("__project")).distinct()
    seen = stored.join(projects, stored[project] == F.col("__project"), "left").join(ids, key, "left")
    gone = F.col("__project").isNotNull() & F.col("now").isNull()
    pruned = seen.filter(gone).select(*stored.columns)
    left = seen.filter(~gone).join(latest.select(*key, F.col("hit.id").alias("__latest")), key, "left")
    now = lambda c: F.when(F.col("id") == F.col("__latest"), F.col("now")[c])
    kept = left.withColumns({c: F.coalesce(now(c), F.col(c)) for c in ("start_line", "end_line")})
    return IndexDiff(hits, new, pruned, kept.select(*stored.columns), project, stored)

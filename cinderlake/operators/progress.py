"""Progress of indexing runs, as a batch over all updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_LINES = 50


def status_of(stage: Column) -> Column:
    return F.when(stage == "completed", F.lit("completed")).when(stage == "failed", F.lit("failed")).otherwise(F.lit("indexing"))


def latest_state(updates: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The state of each key after all updates (progress, stage, current_step, model, chunk_count): the last row wins, an empty model or a zero count never does."""
    at = F.struct(*order)
    return updates.groupBy(key).agg(
        F.max_by("progress", at).alias("progress"),
        F.max_by("stage", at).alias("stage"),
        F.max_by("current_step", at).alias("current_step"),
        F.max_by("model", F.when(F.nullif(F.col("model"), F.lit("")).isNotNull(), at)).alias("model"),
        F.coalesce(F.max_by("chunk_count", F.when(F.col("chunk_count") != 0, at)), F.lit(0)).alias("chunk_count"),
        F.max(order[0]).alias("last_updated"),
        F.count("*").alias("n_updates"),
    ).withColumn("status", status_of(F.col("stage")))


def log_tail(lines: DataFrame, key: str, order: str, keep: int = LOG_LINES) -> DataFrame:
    """The last lines of each key; groups are limited in each partition before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return lines.withColumn("__place", place).filter(F.col("__place") <= keep).drop("__place")


def with_defaults(projects: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """projects (key, is_indexed, embedding_model) with the live state, or what follows from is_indexed where there is none.

    The model is that of the live state; a project that is indexed falls back to the one it was indexed with.
    """
    live = states.select(F.col(key).alias("__key"), "status", "progress", "stage", "current_step", F.nullif("model", F.lit("")).alias("model"))
    joined = projects.join(live, F.col(key) == F.col("__key"), "left")
    done = F.col("is_indexed")
    pick = lambda yes, no: F.when(done, F.lit(yes)).otherwise(F.lit(no))
    defaults = {"status": pick("completed", "idle"), "progress": pick(100, 0), "stage": pick("completed", "idle"), "current_step": pick("Ready", "Not indexed yet"), "model": F.when(done, F.col("embedding_model"))}
    return joined.withColumns({c: F.coalesce(c, d) for c, d in defaults.items()}).drop("__key")


#: The step that a run ends at when there is nothing to go on with.
NO_PROJECT, NO_REPOSITORY, NO_FILES, NO_BLOCKS, NO_CHUNKS = "Project not found", "No GitHub repo configured", "No code files found", "No AST blocks found", "No valid chunks remaining"


def run_outcome(found: Column, repository: Column, n_files: Column, n_blocks: Column, n_chunks: Column, summary: Column) -> Column:
    """How a run ends: progress, stage and current_step; the first thing that is missing fails it."""
    failed = F.when(~F.coalesce(found, F.lit(False)), NO_PROJECT).when(F.coalesce(repository, F.lit("")) == "", NO_REPOSITORY)
    failed = failed.when(n_files == 0, NO_FILES).when(n_blocks == 0, NO_BLOCKS).when(n_chunks == 0, NO_CHUNKS)
    done = failed.isNull()
    step = F.coalesce(failed, F.concat(F.lit("Indexing complete! ("), summary, F.lit(")")))
    return F.struct(F.when(done, 100).otherwise(0).alias("progress"), F.when(done, "completed").otherwise("failed").alias("stage"), step.alias("current_step"))

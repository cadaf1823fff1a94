"""Small helpers the training-data operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_path

__all__ = ["BLANKS", "WORD", "ascii_lower", "bound_batches", "crc_mod", "materialize", "read_table", "shared_path", "shuffle_partitions"]

#: Word separators of every operator here: space and the controls tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: str | Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id gives 0."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bound of the Arrow batches that go to Python. Texts differ too much in length for a bound on rows alone, and workers keep what their largest batch took.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """From here on the session bounds its Arrow batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

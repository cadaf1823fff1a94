"""Table reads, appends, and import and export as text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, partitions: int) -> DataFrame:
    """A database table, read in ranges of a key."""
    options = {"url": url, "dbtable": name, "partitionColumn": key, "lowerBound": lower, "upperBound": upper, "numPartitions": partitions}
    return spark.read.format("jdbc").options(**options).load()


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_rows(rows: DataFrame, path: str, kind: str) -> None:
    """Writes csv (with a header) or json. Null and empty text stay apart in csv."""
    writer = rows.write.mode("errorifexists")
    if kind == "csv":
        writer.option("nullValue", "\\N").option("emptyValue", "").option("escape", '"').csv(path, header=True)
    else:
        writer.json(path)


def import_rows(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """Reads what export_rows has written, by its schema."""
    if kind == "csv":
        return spark.read.schema(schema).option("nullValue", "\\N").option("emptyValue", "").option("escape", '"').option("multiLine", True).csv(path, header=True)
    return spark.read.schema(schema).json(path)

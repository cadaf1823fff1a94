"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset, a local session gets a temporary folder;
    any other master is an error, since its executors could not see such a folder.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    sc = spark.sparkContext
    if base := sc.getCheckpointDir():
        return base
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def run_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one; it is deleted when the application's JVM ends."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{sc.applicationId}")
    if sc.applicationId not in _MADE:
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MADE.add(sc.applicationId)
    return path.toString()


#: Applications whose folder has been made.
_MADE: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage.

    Unlike a local checkpoint, the files outlive the executor that wrote them. They go with the application.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """df, for a join that sends neither side whole to the driver and all executors.

    Planning goes by the bytes of files, and those of materialize can be a fiftieth of their rows' in memory or less, so
    a join of tables that grow with the input would be a broadcast long after its rows fit the driver.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *columns: str, parts: int = 0) -> DataFrame:
    """df in the session's number of partitions or parts, if these are more, by columns or evenly; adaptive execution puts none together.

    For steps that cost far more than their rows' bytes tell.
    """
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *columns)

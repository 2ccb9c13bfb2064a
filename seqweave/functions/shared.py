"""Tables and folders that the driver and every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """This application's folder under the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset and everything runs on this machine
    (tests, a laptop) is a temporary folder made and set as checkpoint folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if base:
        if not context.getCheckpointDir():
            context.setCheckpointDir(base)
    else:
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{context.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path that the driver and every executor can reach. What is put there stays until clear_shared()."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Delete every table that this application has put in the shared folder: for its end, when no result is still to be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_base(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends at files that survive lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of df (small iterative tables)."""
    shared_folder(df.sparkSession, "unused")
    return df.checkpoint(eager=True)

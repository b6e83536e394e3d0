"""Where tables between jobs go, and how small ones are dealt out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. A local session without one gets a temporary
    folder; on a cluster, where executors could not read it, that is an error."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if base is None:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="docprep-")
    return f"{base.rstrip('/')}/docprep-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in a new shared folder, for what must not be computed twice, such as model calls."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt_out(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, such as one small file, is dealt to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def session_files(spark: SparkSession, folder: str):
    """The session's file system for a folder, and what makes a path of a name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path

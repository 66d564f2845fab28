"""Input tables and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's own reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set and the master is local."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that cuts lineage."""
    return f"{shared_root(spark)}/textloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_scratch(spark: SparkSession, df: DataFrame, name: str) -> str:
    """Write df in the shared folder and return its path."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return path


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, written in the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    path = write_scratch(spark, df, name)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once the results that were read from them are stored."""
    drop_scratch(spark, f"{shared_root(spark)}/textloom/{spark.sparkContext.applicationId}")


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete tables that scratch_path named once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

"""Tables in the folder that driver and executors share: computed once, read as often as needed, without their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and all runs on one machine, as in tests.
LOCAL = "file:///tmp/checkpoints/scriptorium"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL).rstrip("/")


def sorted_side(df: DataFrame) -> DataFrame:
    """df as a side of a join by shuffle and sort, never broadcast.

    What is made of documents is many times the files that Spark estimates it by, so an estimate would send whole tables through the driver.
    """
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """df through a table in the shared folder, removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Intermediate tables in the folder of spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session may go without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return spark.sparkContext.getCheckpointDir()


def spread(df: DataFrame, rows: int = 4000) -> DataFrame:
    """df in as many tasks as there are cores, and in more where one would get more than so many rows: a small file of many rows is read by one or two tasks, whatever each row costs after that."""
    n = -(-df.count() // rows)  # of a Parquet file this reads the footers
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism))


def cut(df: DataFrame) -> DataFrame:
    """df as a written table: no lineage, exact sizes for the planner, and nothing that a lost executor could take along."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Loading the tables of a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task sorts or counts, about.
TASK_ROWS = 1 << 19


def tasks(*tables: DataFrame) -> int:
    """So many tasks that none gets more rows as tables grow. Rows of Parquet are counted from its footers."""
    return -(-sum(t.count() for t in tables) // TASK_ROWS)


def spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df dealt by keys to n tasks, where the session's own number of shuffle partitions is less; else as it is."""
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir, else the one set with setCheckpointDir)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

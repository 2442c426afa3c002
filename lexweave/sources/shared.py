"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a written table that a join sends to all tasks.
SMALL = 100_000


def shared_dir(spark: SparkSession) -> str:
    """As the session names it in ``spark.checkpoint.dir``; where that is unset, a folder of the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lexweave-shared").rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lexweave-{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def kept(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Rows as written, and how many there are."""
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    return rows, rows.count()


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Counted rows for a join: sent to all tasks where they are few. The size of a file says little of what its rows take in memory."""
    return F.broadcast(df) if rows <= SMALL else df.hint("merge")

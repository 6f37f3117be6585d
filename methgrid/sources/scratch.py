"""The folder that driver and executors share, for tables and files that are written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A temporary folder is taken only on a local master, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for what is read more than once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes up to which adaptive execution brings partitions together. Sorted rows take up to thirty times as much memory.
JOINED = 8 << 20


def roomy(spark: SparkSession, rows: int, most: int) -> None:
    """Raise the session's number of shuffle partitions, if it is too low, until one has about ``most`` of ``rows``.

    So a task's memory doesn't grow with the tables. Adaptive execution brings small partitions together again, but
    to no more than JOINED; by its own size (64 MB) it would undo the larger number.
    """
    wanted = -(-rows // most)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", JOINED)
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < wanted:
        spark.conf.set("spark.sql.shuffle.partitions", wanted)

"""Helpers that several operators share: tables, shared folders, bounded broadcasts, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of two or three numbers that may be broadcast: some tens of MB at most.
BROADCAST_ROWS = 500_000

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


#: Rows and bytes of the Arrow batches that Python workers get; texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches were bounded for it."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only on a local master, as in tests, where it is unset, a new temporary folder is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for ``df`` if it was counted and has at most ``rows`` rows.

    A larger ``df`` is returned as it is, so that Spark joins by shuffling and splits skewed keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words_of(text) -> F.Column:
    """Array of the words of ``text``; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def ordered(df: DataFrame, cols: list, name: str) -> DataFrame:
    """``df`` with a gapless ``name`` from 0 in the order of ``cols``, without one task that holds all rows.

    Rows are dealt out by range, numbered in each range and shifted by the sizes of the ranges before.
    """
    dealt = written(df.repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()), "ordered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*cols)) - 1
    return dealt.withColumn(name, place).join(F.broadcast(shift), "_range").withColumn(name, F.col(name) + F.col("_shift")).drop("_range", "_shift")

"""Text files as ordered lines: (file, block, id, value).

``block`` is where a file split starts and ``id`` ascends inside it, so (file, block, id) is the
order of the file however Spark packs splits into tasks. A compressed file is one split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from methgrid.operators.scan import small


#: Files that Spark decompresses as it reads, whose size isn't that of their lines.
COMPRESSED = r"(?i)\.(gz|bz2|zst|deflate|lz4|snappy)$"


def read_lines(spark: SparkSession, paths: str | list[str], drop_unterminated: bool = False) -> DataFrame:
    """Lines of text files, without a carriage return at their ends.

    drop_unterminated: leave a file's last line out if no line feed ends it, as readers do that take lines by
    their ends. A file is one byte short of its lines, each counted with a line feed, if the last one has none;
    its size comes from the listing. Of a compressed file that isn't known, and its last line stays.
    """
    value = F.regexp_replace("value", "\r$", "").alias("value")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    if not drop_unterminated:
        return spark.read.text(paths).select(*place, value)
    lines = spark.read.option("lineSep", "\n").text(paths).select(*place, "value", F.col("_metadata.file_size").alias("size"))
    files = lines.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"), F.max(F.struct("block", "id")).alias("last"))
    open_ended = files.where((F.col("bytes") > F.col("size")) & ~F.col("file").rlike(COMPRESSED)).select("file", "last.block", "last.id")
    return lines.join(small(open_ended), ["file", "block", "id"], "left_anti").select("file", "block", "id", value)


def last_seen(lines: DataFrame, what: Column, name: str) -> DataFrame:
    """``lines`` with the latest non-null value of ``what`` at or before each line of its file.

    It is looked for inside the block, then among the last values of the blocks before.
    """
    inside = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("_what", what)
    carried = rows.groupBy("file", "block").agg(F.max_by("_what", F.when(F.col("_what").isNotNull(), F.col("id"))).alias("_last")).select("file", "block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    seen = rows.withColumn("_seen", F.last("_what", ignorenulls=True).over(inside)).join(carried, ["file", "block"])
    return seen.withColumn(name, F.coalesce("_seen", "_carried")).drop("_what", "_seen", "_carried")


def previous(lines: DataFrame, what: Column, name: str) -> DataFrame:
    """``lines`` with the value of ``what`` in the line before, null in a file's first."""
    inside = Window.partitionBy("file", "block").orderBy("id")
    rows = lines.withColumn("_what", what)
    before = Window.partitionBy("file").orderBy("block")
    carried = rows.groupBy("file", "block").agg(F.max_by("_what", "id").alias("_last")).select("file", "block", F.lag("_last").over(before).alias("_carried"))
    lagged = rows.withColumns({name: F.lag("_what").over(inside), "_nth": F.row_number().over(inside)}).join(carried, ["file", "block"])
    return lagged.withColumn(name, F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col(name))).drop("_what", "_nth", "_carried")

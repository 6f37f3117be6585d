"""Incremental ingest: new count files become methylome rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from methgrid.functions.columns import name_from_path
from methgrid.operators.scan import small
from methgrid.sources.counts import align, detect, parse_counts, parse_xcounts
from methgrid.sources.scratch import stored


def parsed_by_format(lines: DataFrame) -> DataFrame:
    """(file, chrom, pos, n_meth, n_unmeth, error) of files of counts and of delta-coded counts; each file's format is found by its first line."""
    formats = small(detect(lines))
    own = lines.join(formats, "file")
    rows = parse_counts(own.where("format = 'counts'")).unionByName(parse_xcounts(own.where("format = 'xcounts'")))
    odd = formats.where("format = 'unknown'").select("file", F.lit(None).cast("string").alias("chrom"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("int").alias("n_meth"), F.lit(None).cast("int").alias("n_unmeth"), F.lit("unknown format").alias("error"))
    return rows.unionByName(odd)


def watch_counts(spark: SparkSession, folder: str, sites: DataFrame, genome: str, out: str, state: str, **trigger) -> StreamingQuery:
    """A query that reads count files put into ``folder``, plain or delta-coded, aligns them with ``sites`` and appends to ``out``.

    Each file is one sample, named by the file, and arrives as a whole in one batch. Its lines are ordered by
    the split they come from and their place in it, so delta-coded positions add up however Spark deals out
    splits. Rejected records go to ``out``_rejects. A batch that is run again after a failure overwrites
    its own folder, so rows are written once. trigger: as for ``DataStreamWriter.trigger``.
    """
    raw = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("value"))

    def put(batch: DataFrame, number: int) -> None:
        lines = stored(batch.withColumn("id", F.monotonically_increasing_id()), "lines")
        rows = parsed_by_format(lines).select(F.lit(genome).alias("genome"), name_from_path(F.col("file")).alias("sample"), "chrom", "pos", "n_meth", "n_unmeth", "error")
        kept, rejects = align(rows, sites, mode="permissive")
        kept.write.mode("overwrite").parquet(f"{out}/batch={number}")
        rejects.write.mode("overwrite").parquet(f"{out}_rejects/batch={number}")

    writer = raw.writeStream.foreachBatch(put).option("checkpointLocation", state)
    return (writer.trigger(**trigger) if trigger else writer).start()

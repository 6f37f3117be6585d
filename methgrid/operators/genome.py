"""Genome tables: sites and chromosomes, derived ranges, hashes.

sites: (genome, chrom, chrom_ord, pos, site_idx); chroms: (genome, chrom, chrom_ord, chrom_size,
chrom_offset, n_sites). Chromosomes are in the order of their names; ``site_idx`` is the rank of
a site in the genome from 0. ``chroms`` has one row for a chromosome and stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methgrid.operators.scan import running, small

#: Positions of a block in which sites are ranked.
BLOCK = 1 << 20


def build(positions: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sites, chroms) of distinct (genome, chrom, pos) and (genome, chrom, chrom_size)."""
    per = sizes.join(positions.groupBy("genome", "chrom").agg(F.count(F.lit(1)).alias("n_sites")), ["genome", "chrom"], "left").fillna(0, ["n_sites"])
    by_name = Window.partitionBy("genome").orderBy("chrom")
    chroms = per.select(
        "genome",
        "chrom",
        (F.row_number().over(by_name) - 1).alias("chrom_ord"),
        F.col("chrom_size").cast("long").alias("chrom_size"),
        (F.sum("n_sites").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_sites")).alias("chrom_offset"),
        "n_sites",
    )
    ranked = running(positions.withColumn("block", F.expr(f"pos div {BLOCK}")), ["genome", "chrom"], "block", ["pos"], {"rank": F.lit(1)})
    sites = ranked.join(small(chroms.select("genome", "chrom", "chrom_ord", "chrom_offset")), ["genome", "chrom"])
    return sites.select("genome", "chrom", "chrom_ord", F.col("pos").cast("long").alias("pos"), (F.col("chrom_offset") + F.col("rank") - 1).alias("site_idx")), chroms


def n_bins(chroms: DataFrame, size: int) -> DataFrame:
    """(genome, n_bins): bins never span chromosomes and the last one is short."""
    return chroms.groupBy("genome").agg(F.sum(F.ceil(F.col("chrom_size") / size)).alias("n_bins"))


def n_windows(chroms: DataFrame, step: int) -> DataFrame:
    """(genome, n_windows), whatever the windows' size."""
    return n_bins(chroms, step).withColumnRenamed("n_bins", "n_windows")


def windows(chroms: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """(genome, chrom, chrom_ord, start, stop): windows at 0, step, 2 step, ... clipped to the chromosome.

    Starts are made in blocks of 65536, so no row holds a chromosome's starts. The step is half
    the size unless given.
    """
    step = size // 2 if step is None else step
    if size < 1 or step < 1:
        raise ValueError("size and step must be 1 or more")
    n = F.expr(f"(chrom_size + {step - 1}) div {step}")
    blocks = chroms.where("chrom_size > 0").withColumn("n", n).withColumn("b", F.explode(F.expr("sequence(0, (n - 1) div 65536)")))
    starts = blocks.withColumn("k", F.explode(F.expr("sequence(b * 65536, least(n, (b + 1) * 65536) - 1)")))
    return starts.select("genome", "chrom", "chrom_ord", (F.col("k") * step).alias("start"), F.least(F.col("k") * step + size, F.col("chrom_size")).alias("stop"))


def bins(chroms: DataFrame, size: int) -> DataFrame:
    """(genome, chrom, chrom_ord, start, stop): consecutive bins, the last one short."""
    return windows(chroms, size, size)


def site_counts(chroms: DataFrame) -> DataFrame:
    """(genome, chrom, n_sites) for each chromosome."""
    return chroms.select("genome", "chrom", "n_sites")


def genome_totals(chroms: DataFrame) -> DataFrame:
    """(genome, n_chroms, genome_size, n_sites)."""
    return chroms.groupBy("genome").agg(F.count(F.lit(1)).alias("n_chroms"), F.sum("chrom_size").alias("genome_size"), F.sum("n_sites").alias("n_sites"))

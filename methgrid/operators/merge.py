"""Merging methylomes and widening results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methgrid.functions.columns import fit_u16
from methgrid.operators.scan import small


def merge_by(methylomes: DataFrame, groups: DataFrame, overflow: str = "exact") -> DataFrame:
    """Site-wise sums of samples by group: (genome, sample = group, site_idx, n_meth, n_unmeth).

    groups: (sample, group), a short list. Sums are exact; ``overflow="rescale"`` fits them
    into 16 bits with their ratio kept.
    """
    summed = methylomes.join(small(groups), "sample").groupBy("genome", F.col("group").alias("sample"), "site_idx").agg(F.sum(F.col("n_meth").cast("long")).alias("n_meth"), F.sum(F.col("n_unmeth").cast("long")).alias("n_unmeth"))
    if overflow == "exact":
        return summed
    if overflow != "rescale":
        raise ValueError(f"unknown overflow: {overflow}")
    m, u = F.col("n_meth"), F.col("n_unmeth")
    return summed.withColumns({"n_meth": fit_u16(m, u), "n_unmeth": fit_u16(u, m)})


def merge(methylomes: DataFrame, samples: list[str], name: str, overflow: str = "exact") -> DataFrame:
    """One merged methylome of the named samples."""
    spark = methylomes.sparkSession
    return merge_by(methylomes, spark.createDataFrame([(s, name) for s in samples], "sample string, group string"), overflow)


def add_column(levels: DataFrame, more: DataFrame, checked: bool = False) -> DataFrame:
    """A long result with the rows of another added; both must have the same ranges.

    checked: both were asked of one prepared table of ranges, so they have the same. Otherwise ranges are compared in
    one pass over both results.
    """
    if not checked:
        sides = levels.select("interval_id", F.lit(1).alias("side")).unionByName(more.select("interval_id", F.lit(2).alias("side")))
        if sides.groupBy("interval_id").agg(F.bit_or("side").alias("sides")).where("sides != 3").limit(1).count():
            raise ValueError("results of different ranges")
    return levels.unionByName(more)

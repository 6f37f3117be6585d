"""A pyramid of bins: stored sums of each methylome at several resolutions.

Every level is summed from the coarsest finer level that divides it, the finest from the sites. Bins and windows of any
size start from the coarsest level that divides them, so their cost falls with their size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.operators.scan import named

#: Bin sizes of the levels unless others are given.
UNITS = [100, 500, 1000, 10_000, 100_000]
#: Positions of a file, so that a level of a sample isn't one task.
SPAN = 1 << 26
NAMES = ["n_meth", "n_unmeth", "n_covered"]


@dataclass
class Pyramid:
    """levels: (unit, genome, sample, chrom, bin, n_meth, n_unmeth, n_covered), bins with reads only."""

    levels: DataFrame
    units: list[int]

    def unit(self, size: int) -> int | None:
        """The coarsest level that divides ``size``."""
        return coarsest(self.units, size)

    def rows(self, unit: int, samples: DataFrame) -> DataFrame:
        """(genome, sample, chrom, pos, sums) of one level; only the folders of the level and the samples are read."""
        return named(self.levels.where(F.col("unit") == unit), samples, ["genome", "sample"]).select("genome", "sample", "chrom", (F.col("bin") * unit).alias("pos"), *NAMES)


def coarsest(units: list[int], size: int) -> int | None:
    return max((u for u in units if size % u == 0), default=None)


def coarsest_of(units: list[int], size: Column) -> Column:
    """The coarsest of ``units`` that divides a column, null if none does."""
    found = F.lit(None).cast("int")
    for u in sorted(units):
        found = F.when(size % u == 0, F.lit(u)).otherwise(found)
    return found


def write_pyramid(methylomes: DataFrame, sites: DataFrame, path: str, units: list[int] = UNITS) -> None:
    """One folder for a level, genome and sample; a level is made of the stored one below it."""
    spark = methylomes.sparkSession
    made: list[int] = []
    for unit in sorted(set(units)):
        below = coarsest(made, unit)
        if below is None:
            rows = methylomes.join(sites.select("genome", "site_idx", "chrom", "pos"), ["genome", "site_idx"]).withColumn("n_covered", (F.col("n_meth") + F.col("n_unmeth") > 0).cast("long"))
        else:
            rows = read_pyramid(spark, path, made).levels.where(F.col("unit") == below).withColumn("pos", F.col("bin") * below)
        summed = rows.groupBy("genome", "sample", "chrom", F.expr(f"pos div {unit}").cast("long").alias("bin")).agg(*[F.sum(F.col(n).cast("long")).alias(n) for n in NAMES])
        dealt = summed.repartition("genome", "sample", "chrom", F.expr(f"bin div {-(-SPAN // unit)}")).sortWithinPartitions("genome", "sample", "chrom", "bin")
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("genome", "sample").parquet(f"{path}/unit={unit}")
        made.append(unit)


def read_pyramid(spark: SparkSession, path: str, units: list[int] = UNITS) -> Pyramid:
    """What ``write_pyramid`` wrote."""
    return Pyramid(spark.read.schema("chrom string, bin long, n_meth long, n_unmeth long, n_covered long, unit int, genome string, sample string").parquet(path), sorted(set(units)))

"""Intervals and their site ranks.

intervals: (interval_id, genome, chrom, start, stop), zero-based and half-open. A site belongs to
an interval if start <= pos < stop. ``interval_id`` keeps duplicates and input order apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methgrid.operators.scan import last_before, only_blocks, small
from methgrid.sources.scratch import stored

#: Positions of a block in which bounds and sites meet.
BLOCK = 1 << 14


def site_marks(sites: DataFrame, chroms: DataFrame) -> DataFrame:
    """(genome, chrom, block, pos, rank, before) for ``site_ranks``: sites in blocks, each with the number of sites up to it.

    Every block of a chromosome is opened by a seed with the number of sites before the block.
    It depends on the genome only, so it is made once, at ingest.
    """
    block = F.expr(f"pos div {BLOCK}")
    counts = sites.groupBy("genome", "chrom", block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    axis = chroms.select("genome", "chrom", "chrom_offset", F.explode(F.expr(f"sequence(0, chrom_size div {BLOCK})")).alias("block"))
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("genome", "chrom").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    seeds = axis.join(counts, ["genome", "chrom", "block"], "left").select("genome", "chrom", "block", (F.col("block") * BLOCK).alias("pos"), F.lit(-1).alias("rank"), (F.col("chrom_offset") + F.coalesce(before, F.lit(0))).alias("before"))
    return seeds.unionByName(sites.select("genome", "chrom", block.alias("block"), "pos", F.lit(1).alias("rank"), (F.col("site_idx") + 1).alias("before")))


def site_ranks(intervals: DataFrame, sites: DataFrame, chroms: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """``intervals`` with lo and hi: the interval holds the sites of ranks lo to hi - 1.

    Every bound looks for the last site before it in its block of the chromosome. Intervals of
    chromosomes that the genome doesn't have are left out. marks: what ``site_marks`` has stored; only
    the blocks that hold bounds are read.
    """
    known = intervals.join(small(chroms.select("genome", "chrom", "chrom_size")), ["genome", "chrom"])
    ends = F.explode(F.array(F.struct(F.lit(False).alias("is_stop"), F.col("start").alias("at")), F.struct(F.lit(True).alias("is_stop"), F.col("stop").alias("at"))))
    events = known.withColumn("end", ends).withColumn("pos", F.greatest(F.lit(0), F.least("end.at", "chrom_size"))).withColumn("block", F.expr(f"pos div {BLOCK}"))
    columns = intervals.columns
    others = [c for c in columns if c not in ("genome", "chrom")]
    marks, hot = (site_marks(sites, chroms), []) if marks is None else only_blocks(marks, events, ["genome", "chrom"])
    found = last_before(events.select("genome", "chrom", *others, F.col("end.is_stop").alias("is_stop"), "pos", "block"), marks, ["genome", "chrom"], "pos", ["before"], hot)
    return found.groupBy(*columns).agg(F.max(F.when(~F.col("is_stop"), F.col("before"))).alias("lo"), F.max(F.when(F.col("is_stop"), F.col("before"))).alias("hi"))


def prepare(intervals: DataFrame, sites: DataFrame, chroms: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """``site_ranks`` of intervals as a stored table: a prepared query, to be asked of any methylomes of the genome.

    ``levels.interval_levels(prepared=True)`` reads it as it is, and neither intervals nor marks again.
    """
    return stored(site_ranks(intervals, sites, chroms, marks), "query")


def n_cpgs(ranked: DataFrame) -> DataFrame:
    """(interval_id, n_cpgs) of intervals with ranks."""
    return ranked.select("interval_id", (F.col("hi") - F.col("lo")).alias("n_cpgs"))


def is_valid() -> Column:
    return F.col("start") <= F.col("stop")


def are_valid(intervals: DataFrame) -> DataFrame:
    """One row: whether start <= stop holds everywhere."""
    return intervals.agg(F.coalesce(F.bool_and(is_valid()), F.lit(True)).alias("valid"))


def are_sorted(intervals: DataFrame) -> DataFrame:
    """One row: whether chromosomes are contiguous and starts ascend, in the order of interval_id.

    Neighbours are compared in blocks of ids and across the blocks' ends; a chromosome is
    contiguous if it begins once.
    """
    cut = intervals.select("interval_id", "chrom", "start", F.expr("interval_id div 65536").alias("block"))
    order = Window.partitionBy("block").orderBy("interval_id")
    inner = cut.withColumns({"p_chrom": F.lag("chrom").over(order), "p_start": F.lag("start").over(order)})
    ends = cut.groupBy("block").agg(F.min_by(F.struct("chrom", "start"), "interval_id").alias("first"), F.max_by(F.struct("chrom", "start"), "interval_id").alias("last"))
    across = ends.withColumn("prev", F.lag("last").over(Window.orderBy("block"))).select(F.col("first.chrom").alias("chrom"), F.col("first.start").alias("start"), F.col("prev.chrom").alias("p_chrom"), F.col("prev.start").alias("p_start"))
    pairs = inner.where("p_chrom is not null").select("chrom", "start", "p_chrom", "p_start").unionByName(across)
    begins = pairs.where("p_chrom is null or p_chrom != chrom").groupBy("chrom").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    falls = pairs.agg(F.coalesce(F.bool_or((F.col("p_chrom") == F.col("chrom")) & (F.col("start") < F.col("p_start"))), F.lit(False)).alias("falls"))
    return falls.join(begins, F.lit(True)).select((~F.col("falls") & (F.col("most") <= 1)).alias("sorted"))


def as_text(sep: str = "\t") -> Column:
    return F.concat_ws(sep, "chrom", F.col("start").cast("string"), F.col("stop").cast("string"))


def compared(a: str, b: str) -> Column:
    """-1, 0 or 1 as interval struct ``a`` comes before, equals or comes after ``b``: by chromosome in the genome's order, start, stop.

    Both have chrom_ord, start and stop.
    """
    x, y = (F.struct(f"{c}.chrom_ord", f"{c}.start", f"{c}.stop") for c in (a, b))
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)

"""Levels: counts summed over ranges, for one or many methylomes.

methylomes: (genome, sample, site_idx, n_meth, n_unmeth), covered sites only. Results are long:
one row for a range and a sample, ranges without reads included.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methgrid.operators import genome as g
from methgrid.operators.intervals import site_ranks
from methgrid.operators.pyramid import Pyramid
from methgrid.operators.scan import last_before, named, only_blocks, small
from methgrid.sources.scratch import stored

#: Site ranks of a block of prefix sums.
BLOCK = 1024
#: Samples whose sums at a bound are looked up together and kept in one row.
TOGETHER = 8
#: Windows of more bins than this are answered by prefix sums.
FRAME = 64


def _sums(covered: bool) -> dict:
    sums = {"n_meth": F.col("n_meth").cast("long"), "n_unmeth": F.col("n_unmeth").cast("long")}
    if covered:
        sums["n_covered"] = (F.col("n_meth") + F.col("n_unmeth") > 0).cast("long")
    return sums


def requested(methylomes: DataFrame, samples: list[str]) -> DataFrame:
    """(sample, col_ord, ...) rows of the requested samples in the order of the request; repeats stay.

    The list is the user's and short, so it is broadcast and prunes the partitions that are read.
    """
    spark = methylomes.sparkSession
    asked = spark.createDataFrame([(s, i) for i, s in enumerate(samples)], "sample string, col_ord int")
    return methylomes.join(small(asked), "sample")


def by_index(meta: DataFrame, samples: list[str]) -> DataFrame:
    """(index_hash, samples) of the requested samples; they can be asked together if there is one row."""
    return meta.where(F.col("sample").isin(samples)).groupBy("index_hash").agg(F.sort_array(F.collect_set("sample")).alias("samples"))


def check_one_genome(meta: DataFrame, samples: list[str]) -> None:
    """Refuse samples that belong to different indexes; meta: (sample, index_hash), one row each."""
    groups = by_index(meta, samples).limit(2).collect()
    if len(groups) > 1:
        raise ValueError(f"samples of different genomes: {groups[0].samples[:5]} and {groups[1].samples[:5]}")


def prefix_sums(methylomes: DataFrame, chroms: DataFrame) -> DataFrame:
    """(genome, sample, block, at, rank, n_meth, n_unmeth, n_covered): each site's sums up to it in its sample, for ``interval_levels``.

    Sites are summed in blocks of ranks, and every block of a sample is opened by a seed with the
    sums before the block. It depends on the methylomes only, so it is made once, at ingest.
    """
    sums = _sums(True)
    block = F.expr(f"site_idx div {BLOCK}")
    rows = methylomes.select("genome", "sample", block.alias("block"), F.col("site_idx").alias("at"), *[c.alias(n) for n, c in sums.items()])
    totals = rows.groupBy("genome", "sample", "block").agg(*[F.sum(n).alias(n) for n in sums])
    last = chroms.groupBy("genome").agg(F.expr(f"sum(n_sites) div {BLOCK}").alias("last"))
    axis = methylomes.select("genome", "sample").distinct().join(small(last), "genome").select("genome", "sample", F.explode(F.expr("sequence(0, last)")).alias("block"))
    earlier = Window.partitionBy("genome", "sample").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    seeds = axis.join(totals, ["genome", "sample", "block"], "left").select("genome", "sample", "block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])
    inside = Window.partitionBy("genome", "sample", "block").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    opened = seeds.select("genome", "sample", "block", (F.col("block") * BLOCK).alias("at"), F.lit(-1).alias("rank"), *sums)
    both = opened.unionByName(rows.select("genome", "sample", "block", "at", F.lit(1).alias("rank"), *sums))
    return both.withColumns({n: F.sum(n).over(inside) for n in sums})


def pair_levels(pairs: DataFrame, prefix: DataFrame, covered: bool = False, hot: list[tuple] = ()) -> DataFrame:
    """``pairs`` (genome, sample, lo, hi, ...) with the sums of the sample's sites of ranks lo to hi - 1.

    Every bound looks for the last site before it among the sample's prefix sums; the sum at hi less that at lo is
    the pair's, so the cost doesn't depend on the width or the overlap of intervals. Other columns tell pairs apart.
    hot: blocks that ``touched_sums`` found to hold very many bounds.
    """
    names = list(_sums(covered))
    keys = [c for c in pairs.columns if c not in ("genome", "sample")]
    bound = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("lo").alias("at")), F.struct(F.lit(1).alias("sign"), F.col("hi").alias("at"))))
    ends = pairs.withColumn("_end", bound)
    events = ends.select("genome", "sample", *keys, "_end.sign", "_end.at").withColumn("block", F.expr(f"at div {BLOCK}"))
    found = last_before(events, prefix.select("genome", "sample", "block", "at", "rank", *names), ["genome", "sample"], "at", names, hot, ["genome"])
    return found.groupBy("genome", "sample", *keys).agg(*[F.coalesce(F.sum(F.col("sign") * F.col(n)), F.lit(0)).alias(n) for n in names])


def ranged_cells(ranked: DataFrame, samples: DataFrame, prefix: DataFrame, covered: bool = False, hot: list[tuple] = ()) -> DataFrame:
    """``ranked`` (genome, lo, hi, ...) with ``cells``, a map from samples of its genome to their sums for the sites of ranks lo to hi - 1.

    A row has a lot of up to ``TOGETHER`` samples, so an interval has a row for each lot. Each distinct bound is looked up
    once for a lot, whatever the number of ranges that have it and of the lot's samples. So ranges are shuffled twice,
    for their two bounds, and neither bounds nor ranges for each sample.
    """
    names = list(_sums(covered))
    nth = F.row_number().over(Window.partitionBy("genome").orderBy("sample")) - 1
    # One row for a sample, read three times.
    dealt = stored(samples.select("genome", "sample", nth.alias("_nth")).select("genome", "sample", F.expr(f"cast(_nth div {TOGETHER} as int)").alias("_lot"), F.expr(f"_nth % {TOGETHER}").alias("_nth")), "samples")
    lots = small(dealt.groupBy("genome", "_lot").agg(F.array_sort(F.collect_list(F.struct("_nth", "sample")))["sample"].alias("_samples")))
    width = min(TOGETHER, max(1, dealt.count()))
    ends = ranked.select("genome", F.explode(F.array("lo", "hi")).alias("at")).distinct()
    events = ends.join(lots.drop("_samples"), "genome").select("genome", "_lot", "at", F.expr(f"at div {BLOCK}").alias("block"))
    places = [f"_s{i}" for i in range(width)]
    own = prefix.join(small(dealt), ["genome", "sample"]).select("genome", "_lot", "block", "at", "rank", *[F.when(F.col("_nth") == i, F.struct(*names)).alias(p) for i, p in enumerate(places)])
    # Read for both bounds, so it is stored.
    sums = stored(last_before(events, own, ["genome", "_lot"], "at", places, hot, ["genome"]), "bounds")
    low = ranked.join(sums.select("genome", F.col("at").alias("lo"), "_lot", *[F.col(p).alias(f"{p}_low") for p in places]), ["genome", "lo"])
    both = low.join(sums.withColumnRenamed("at", "hi"), ["genome", "hi", "_lot"]).join(lots, ["genome", "_lot"])
    cells = F.array(*[F.struct(*[(F.coalesce(F.col(f"{p}.{n}"), F.lit(0)) - F.coalesce(F.col(f"{p}_low.{n}"), F.lit(0))).alias(n) for n in names]) for p in places])
    return both.select(*ranked.columns, F.map_from_arrays("_samples", F.slice(cells, 1, F.size("_samples"))).alias("cells"))


def ranged_levels(ranked: DataFrame, samples: DataFrame, prefix: DataFrame, covered: bool = False, hot: list[tuple] = ()) -> DataFrame:
    """``ranked`` (genome, lo, hi, ...) with the sums of every sample of its genome for the sites of ranks lo to hi - 1.

    Each distinct bound is looked up once for a sample, whatever the number of ranges that have it, and the samples' sums
    at a bound are kept side by side, ``TOGETHER`` of them in a row. So ranges are shuffled twice, for their two bounds, and
    not for each sample.
    """
    names = list(_sums(covered))
    dealt = samples.select("genome", "sample", F.pmod(F.hash("sample"), F.lit(max(1, -(-samples.count() // TOGETHER)))).alias("_lot"))
    ends = ranked.select("genome", F.explode(F.array("lo", "hi")).alias("at")).distinct()
    events = ends.join(small(dealt), "genome").select("genome", "sample", "_lot", "at", F.expr(f"at div {BLOCK}").alias("block"))
    found = last_before(events, prefix.select("genome", "sample", "block", "at", "rank", *names), ["genome", "sample"], "at", names, hot, ["genome"])
    # Read for both bounds, so it is stored.
    sums = stored(found.groupBy("genome", "at", "_lot").agg(F.map_from_entries(F.collect_list(F.struct("sample", F.struct(*names)))).alias("sums")), "bounds")
    low = ranked.join(sums.select("genome", F.col("at").alias("lo"), "_lot", F.col("sums").alias("_low")), ["genome", "lo"])
    both = low.join(sums.select("genome", F.col("at").alias("hi"), "_lot", F.col("sums").alias("_high")), ["genome", "hi", "_lot"])
    each = both.select(*ranked.columns, "_low", F.explode("_high").alias("sample", "_sum"))
    return each.select(*ranked.columns, "sample", *[(F.coalesce(F.col(f"_sum.{n}"), F.lit(0)) - F.coalesce(F.col("_low")[F.col("sample")][n], F.lit(0))).alias(n) for n in names])


def bounds_of(ranked: DataFrame) -> DataFrame:
    """(genome, block) of the blocks of prefix sums that hold bounds of ``ranked``."""
    return ranked.select("genome", F.explode(F.array(F.expr(f"lo div {BLOCK}"), F.expr(f"hi div {BLOCK}"))).alias("block"))


def touched_sums(prefix: DataFrame, ranked: DataFrame, samples: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """What a question reads of a stored table of prefix sums: its samples' folders, and in them the blocks with its bounds; and blocks with very many."""
    return only_blocks(named(prefix, samples, ["genome", "sample"]), bounds_of(ranked), ["genome"])


def _met(make, ranked: DataFrame, methylomes: DataFrame | None, samples: DataFrame, covered: bool, chroms: DataFrame | None, prefix: DataFrame | None, keys: list[str], prepared: bool) -> DataFrame:
    if prefix is None:
        ends = chroms if chroms is not None else methylomes.groupBy("genome").agg((F.max("site_idx") + 1).alias("n_sites")).unionByName(ranked.groupBy("genome").agg(F.max("hi").alias("n_sites"))).groupBy("genome").agg(F.max("n_sites").alias("n_sites"))
        prefix, hot = prefix_sums(methylomes, ends), []
        prefix = prefix.join(small(samples.select("genome", "sample").distinct()), ["genome", "sample"], "left_semi")
    else:
        ranked = ranked if prepared else stored(ranked, "ranked")
        prefix, hot = touched_sums(prefix, ranked, samples)
    own = ranked.select(*dict.fromkeys(["genome", *keys, "lo", "hi"]))
    return make(own, samples.select("genome", "sample").distinct(), prefix, covered, hot)


def interval_levels(ranked: DataFrame, methylomes: DataFrame | None, samples: DataFrame, covered: bool = False, chroms: DataFrame | None = None, prefix: DataFrame | None = None, keys: list[str] | None = None, prepared: bool = False) -> DataFrame:
    """(interval_id, sample, n_meth, n_unmeth[, n_covered]) of intervals with site ranks.

    samples: (genome, sample), one row each. prefix: what ``prefix_sums`` has stored, of which only the blocks
    with bounds of the samples are read; ``ranked`` is then stored, as it is read twice, unless it is a
    table that ``intervals.prepare`` has stored (``prepared``). Without prefix, it is made of ``methylomes``. keys: the columns of an interval, interval_id if not given.
    """
    keys = keys or ["interval_id"]
    return _met(ranged_levels, ranked, methylomes, samples, covered, chroms, prefix, keys, prepared).select(*keys, "sample", *_sums(covered))


def interval_cells(ranked: DataFrame, methylomes: DataFrame | None, samples: DataFrame, covered: bool = False, chroms: DataFrame | None = None, prefix: DataFrame | None = None, keys: list[str] | None = None, prepared: bool = False) -> DataFrame:
    """What ``interval_levels`` gives, with one row for an interval: (interval_id, cells), a map from samples to their sums.

    Tables and lines are made of it without bringing an interval's rows together again; only of more samples than
    ``TOGETHER`` are the lots brought together.
    """
    keys = keys or ["interval_id"]
    found = _met(ranged_cells, ranked, methylomes, samples, covered, chroms, prefix, keys, prepared).select(*keys, "cells")
    if samples.select("genome", "sample").distinct().count() <= TOGETHER:
        return found
    entries = F.flatten(F.collect_list(F.map_entries("cells")))
    return found.groupBy(*keys).agg(F.map_from_entries(entries).alias("cells"))


def _placed(methylomes: DataFrame, sites: DataFrame) -> DataFrame:
    return methylomes.join(sites.select("genome", "site_idx", "chrom", "pos"), ["genome", "site_idx"])


def _rows(sites: DataFrame, methylomes: DataFrame, samples: DataFrame, unit: int, covered: bool, pyramid: Pyramid | None) -> tuple[DataFrame, dict]:
    """(rows with chrom and pos of the samples, sums of their counts) for ranges that are multiples of ``unit``: of a stored level if one divides it, else of the sites."""
    level = pyramid.unit(unit) if pyramid else None
    if level is None:
        return _placed(named(methylomes, samples, ["genome", "sample"]), sites), _sums(covered)
    return pyramid.rows(level, samples), {n: F.col(n) for n in _sums(covered)}


def bin_levels(chroms: DataFrame, sites: DataFrame, methylomes: DataFrame, samples: DataFrame, size: int, covered: bool = False, keep_empty: bool = True, pyramid: Pyramid | None = None) -> DataFrame:
    """(genome, sample, chrom, start, stop, sums) of bins; empty bins too unless they are not wanted.

    pyramid: stored sums of bins, of which the coarsest level that divides the size is read.
    """
    rows, sums = _rows(sites, methylomes, samples, size, covered, pyramid)
    summed = rows.groupBy("genome", "sample", "chrom", F.expr(f"pos div {size} * {size}").alias("start")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    if not keep_empty:
        sizes = small(chroms.select("genome", "chrom", "chrom_size"))
        return summed.join(sizes, ["genome", "chrom"]).select("genome", "sample", "chrom", "start", F.least(F.col("start") + size, F.col("chrom_size")).alias("stop"), *sums)
    axis = g.bins(chroms, size).join(small(samples), "genome")
    return axis.join(summed, ["genome", "sample", "chrom", "start"], "left").fillna(0, list(sums)).select("genome", "sample", "chrom", "start", "stop", *sums)


def _window_frames(chroms: DataFrame, rows: DataFrame, keys: list[str], sums: dict, size: int, step: int) -> tuple[DataFrame, DataFrame, int]:
    """(bins, window starts, bins of a window) of rows (keys, chrom, pos, ...): bins of gcd(size, step), framed in blocks of chromosomes.

    A block also gets the bins that its last windows reach into, so frames never leave it.
    """
    unit = math.gcd(size, step)
    reach, jump = size // unit, step // unit
    span = max(1024, reach) * jump
    summed = rows.groupBy(*keys, "chrom", F.expr(f"pos div {unit}").alias("bin")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # Bin b counts in windows that start at bins b - reach + 1 to b.
    sent = summed.withColumn("block", F.explode(F.expr(f"sequence(greatest(0, bin - {reach - 1}) div {span}, bin div {span})")))
    starts = g.windows(chroms, size, step).withColumn("bin", F.expr(f"start div {unit}")).withColumn("block", F.expr(f"bin div {span}"))
    return sent, starts, reach


def window_levels(chroms: DataFrame, sites: DataFrame, methylomes: DataFrame, samples: DataFrame, size: int, step: int | None = None, covered: bool = False, marks: DataFrame | None = None, prefix: DataFrame | None = None, pyramid: Pyramid | None = None) -> DataFrame:
    """(genome, sample, chrom, start, stop, sums) of sliding windows, empty ones too.

    Sites are summed to bins of gcd(size, step). Short windows sum a range frame over bins and
    window starts; long ones are intervals answered by prefix sums. Steps beyond the size leave
    sites between windows out. pyramid: as for ``bin_levels``, for bins of gcd(size, step).
    """
    step = size // 2 if step is None else step
    if size < 1 or step < 1:
        raise ValueError("size and step must be 1 or more")
    unit = math.gcd(size, step)
    if size // unit > FRAME:
        ranked = site_ranks(g.windows(chroms, size, step), sites, chroms, marks)
        got = interval_levels(ranked, methylomes, samples, covered, chroms, prefix, keys=["genome", "chrom", "start", "stop"])
        return got.select("genome", "sample", "chrom", "start", "stop", *_sums(covered))
    rows, sums = _rows(sites, methylomes, samples, unit, covered, pyramid)
    sent, opens, reach = _window_frames(chroms, rows, ["genome", "sample"], sums, size, step)
    axis = opens.join(small(samples), "genome")
    return _framed(sent, axis, ["genome", "sample"], list(sums), reach)


def _framed(sent: DataFrame, axis: DataFrame, keys: list[str], names: list[str], reach: int) -> DataFrame:
    rows = sent.select(*keys, "chrom", "block", "bin", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"), *names)
    marks = axis.select(*keys, "chrom", "block", "bin", "start", "stop", *[F.lit(0).cast("long").alias(n) for n in names])
    frame = Window.partitionBy(*keys, "chrom", "block").orderBy("bin").rangeBetween(0, reach - 1)
    both = rows.unionByName(marks).withColumns({f"sum_{n}": F.sum(n).over(frame) for n in names})
    return both.where("start is not null").select(*keys, "chrom", "start", "stop", *[F.col(f"sum_{n}").alias(n) for n in names])


def global_levels(methylomes: DataFrame, samples: DataFrame, covered: bool = False) -> DataFrame:
    """(genome, sample, sums) over all sites."""
    sums = _sums(covered)
    summed = methylomes.groupBy("genome", "sample").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return samples.join(summed, ["genome", "sample"], "left").fillna(0, list(sums))


def bin_cpgs(chroms: DataFrame, sites: DataFrame, size: int) -> DataFrame:
    """(genome, chrom, start, stop, n_cpgs) of bins."""
    counted = sites.groupBy("genome", "chrom", F.expr(f"pos div {size} * {size}").alias("start")).agg(F.count(F.lit(1)).alias("n_cpgs"))
    return g.bins(chroms, size).join(counted, ["genome", "chrom", "start"], "left").fillna(0, ["n_cpgs"]).select("genome", "chrom", "start", "stop", "n_cpgs")


def window_cpgs(chroms: DataFrame, sites: DataFrame, size: int, step: int | None = None, marks: DataFrame | None = None) -> DataFrame:
    """(genome, chrom, start, stop, n_cpgs) of sliding windows; long ones by site ranks, for which ``marks`` may be stored."""
    step = size // 2 if step is None else step
    if size // math.gcd(size, step) > FRAME:
        return site_ranks(g.windows(chroms, size, step), sites, chroms, marks).select("genome", "chrom", "start", "stop", (F.col("hi") - F.col("lo")).alias("n_cpgs"))
    sent, opens, reach = _window_frames(chroms, sites, ["genome"], {"n_cpgs": F.lit(1).cast("long")}, size, step)
    return _framed(sent, opens, ["genome"], ["n_cpgs"], reach)


def levels(kind: str, *, chroms: DataFrame, sites: DataFrame, methylomes: DataFrame, samples: DataFrame, intervals: DataFrame | None = None, ranked: DataFrame | None = None, size: int | None = None, step: int | None = None, covered: bool = False, marks: DataFrame | None = None, prefix: DataFrame | None = None, pyramid: Pyramid | None = None) -> DataFrame:
    """One entry for the kinds of ranges: ``query`` (ranks), ``intervals``, ``bins`` and ``windows``.

    marks, prefix, pyramid: the stored tables of ``site_marks``, ``prefix_sums`` and ``write_pyramid``, if there are any.
    """
    if kind == "query":
        return interval_levels(ranked, methylomes, samples, covered, chroms, prefix)
    if kind == "intervals":
        return interval_levels(site_ranks(intervals, sites, chroms, marks), methylomes, samples, covered, chroms, prefix)
    if kind == "bins":
        return bin_levels(chroms, sites, methylomes, samples, size, covered, pyramid=pyramid)
    if kind == "windows":
        return window_levels(chroms, sites, methylomes, samples, size, step, covered, marks, prefix, pyramid)
    raise ValueError(f"unknown kind of ranges: {kind}")

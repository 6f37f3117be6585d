"""Prefix sums and ranks in two levels: inside blocks, then over the blocks' totals.

No window spans a whole chromosome, sample or table: rows are summed inside blocks, and only blocks'
totals, one row for a block, are ordered over a group. So parallelism is the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methgrid.sources.scratch import stored


def block_offsets(rows: DataFrame, group: list[str], block: str, sums: dict) -> DataFrame:
    """(group, block, <name>_before): what the blocks before hold; blocks without rows need none."""
    totals = rows.groupBy(*group, block).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, block, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums])


def running(rows: DataFrame, group: list[str], block: str, order: list, sums: dict) -> DataFrame:
    """``rows`` with, for each of ``sums``, the sum over the group's rows before and including each row."""
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    offsets = block_offsets(rows, group, block, sums)
    summed = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    joined = summed.join(offsets, [*group, block])
    return joined.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in sums}).drop(*[f"{n}_before" for n in sums])


#: Narrow rows that may be broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for ``df`` if it was counted and has at most ``rows`` rows; else it is joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name`` from 1 in ``order`` in each group, without a task that holds a whole group.

    Rows are dealt out by ranges of (group, order), whose cuts Spark samples, so a hot group gets many ranges;
    they are numbered inside ranges and shifted by the counts of the group's ranges before. The ranges are stored,
    so that they stay the same when a task is run again.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n")).select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    return dealt.withColumn(name, place).join(small(shift), [*group, "_range"]).withColumn(name, F.col(name) + F.col("_shift")).drop("_range", "_shift")


#: Blocks that a question may touch and still be read block by block, and ranges of blocks in one filter.
TOUCHED, RANGES = 65_536, 128


def block_ranges(blocks: list[tuple], most: int = RANGES) -> list[tuple]:
    """(key, first, last) of runs of neighbouring blocks among (key, block); the smallest gaps are closed until ``most`` are left.

    Blocks of different keys stay apart, so there may be more ranges than ``most`` if there are more keys.
    """
    runs: list[list] = []
    for key, block in sorted(blocks):
        if runs and runs[-1][0] == key and block <= runs[-1][2] + 1:
            runs[-1][2] = block
        else:
            runs.append([key, block, block])
    gaps = sorted(b[1] - a[2] for a, b in zip(runs, runs[1:]) if a[0] == b[0])
    spare = len(runs) - most
    widest = gaps[min(spare, len(gaps)) - 1] if spare > 0 and gaps else 0
    joined: list[list] = []
    for run in runs:
        if joined and joined[-1][0] == run[0] and run[1] - joined[-1][2] <= widest:
            joined[-1][2] = run[2]
        else:
            joined.append(run)
    return [tuple(r) for r in joined]


#: Events of one block that one task takes.
HOT = 100_000


def only_blocks(stored: DataFrame, bounds: DataFrame, keys: list[str]) -> tuple[DataFrame, list[tuple]]:
    """Rows of ``stored`` in the (keys, block) that occur in ``bounds``, and (keys, block, parts) of the blocks with more than HOT bounds.

    A table sorted by keys and block is read in these places only. The blocks are counted first. Up to TOUCHED of
    them become ranges of literals, which the scan compares with the statistics of pages and row groups, and a
    broadcast semi-join leaves exactly those blocks; the stored table isn't shuffled. A question that touches
    more needs most of the table and gets it whole.
    """
    counts = bounds.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"))
    found = counts.limit(TOUCHED + 1).collect()
    if len(found) > TOUCHED:
        found = counts.where(F.col("n") > HOT).collect()  # fewer than bounds / HOT
        return stored, [(*r[:-1], -(-r.n // HOT)) for r in found]
    hot = [(*r[:-1], -(-r.n // HOT)) for r in found if r.n > HOT]
    if not found:
        return stored.where(F.lit(False)), hot
    blocks = [(tuple(r[:-2]), r.block) for r in found]
    ranges = block_ranges(blocks)
    if len(ranges) <= 2 * RANGES:
        wanted = F.lit(False)
        for key, first, last in ranges:
            place = F.col("block").between(first, last)
            for name, value in zip(keys, key, strict=True):
                place = place & (F.col(name) == value)
            wanted = wanted | place
        stored = stored.where(wanted)
    exact = stored.sparkSession.createDataFrame([(*key, block) for key, block in blocks], stored.select(*keys, "block").schema)
    return stored.join(F.broadcast(exact), [*keys, "block"], "left_semi"), hot  # at most TOUCHED rows


def named(df: DataFrame, rows: DataFrame, columns: list[str], most: int = 1000) -> DataFrame:
    """``df`` where its ``columns`` occur in ``rows``: by literals, which prune partitions, if these are ``most`` or fewer."""
    keys = rows.select(*columns).distinct()
    found = keys.limit(most + 1).collect()
    if len(found) > most:
        return df.join(keys, columns, "left_semi")
    by_last: dict[tuple, list] = {}
    for r in found:
        by_last.setdefault(tuple(r[:-1]), []).append(r[-1])
    wanted = F.lit(False)
    for first, values in by_last.items():
        place = F.col(columns[-1]).isin(values)
        for name, value in zip(columns, first, strict=False):
            place = place & (F.col(name) == value)
        wanted = wanted | place
    return df.where(wanted)


def last_before(events: DataFrame, marks: DataFrame, group: list[str], place: str, values: list[str], hot: list[tuple] = (), on: list[str] | None = None) -> DataFrame:
    """``events`` with the ``values`` of the last of ``marks`` before each, one exchange for all.

    Both have the group's columns, ``block`` and ``place``. Marks have ``rank``: -1 for the seed that
    opens every block with what the blocks before it hold, 1 for others, which come after events
    at the same place. hot: (values of ``on``, block, parts) of blocks with so many events that they are dealt to
    several tasks, each of which gets the block's marks.
    """
    names = [c for c in events.columns if c not in (*group, "block", place)]
    keys = [*group, "block"]
    if hot:
        kinds = events.select(*(on or group), "block").schema
        parts = F.broadcast(events.sparkSession.createDataFrame(list(hot), kinds.add("_parts", "integer")))  # no more than events / HOT
        count = F.coalesce("_parts", F.lit(1))
        events = events.join(parts, [*(on or group), "block"], "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), count).cast("int")).drop("_parts")
        marks = marks.join(parts, [*(on or group), "block"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), count - 1))).drop("_parts")
        keys.append("_part")
    both = events.select(*keys, place, F.lit(0).alias("rank"), *([F.struct(*names).alias("own")] if names else []), *[F.lit(None).cast(marks.schema[v].dataType).alias(v) for v in values])
    both = both.unionByName(marks.select(*keys, place, "rank", *values), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(place, "rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({v: F.last(v, ignorenulls=True).over(order) for v in values})
    return seen.where("rank = 0").select(*group, place, *(["own.*"] if names else []), *values)

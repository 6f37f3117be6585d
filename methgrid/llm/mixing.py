"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the base rate tilted exponentially: rate = exp(sum of the tilts of
its groups). The tilts solve the convex dual of "stay as close to rate 1 as possible while the
words of every group meet its target". Spark sums words into cells of the group columns once;
every round then sums gradient and curvature of the dual over the cells, group by group, and
takes damped Newton steps. Rates are rounded to copies so that every group meets its target
within about its smallest documents: whole copies for all, and one more for the documents
first in an order by hash, whose cut is found by two levels of histograms.

Nulls: a null source is a group of its own, last in order; a null text has no words; a null
``doc_id`` is ordered by its text. Empty tables and tables without words give targets of 0.
Repeated rows are told apart by their place in the stored table, so that a cut takes part of them. Other columns are ignored; ``mix_stage`` returns those of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, WORD, ordered, read_table, small, written

#: The weights of the groups in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target is at most so many times what its group has.
CEILING = 3.0
BITS, LEVEL = 30, 10


def group_key(col) -> F.Column:
    """A key that is never null: nulls are a group of their own."""
    return F.coalesce(F.concat(F.lit("g"), col), F.lit("n"))


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_size (words), mix_key, mix_order, a hash of the row, and mix_row, its place among equal rows.

    Only rows of one id and text have one order; which of these comes first doesn't change the result.
    """
    return docs.withColumns({
        "mix_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "mix_key": group_key(F.col("source")),
        "mix_order": F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << BITS)),
        "mix_row": F.monotonically_increasing_id(),
    })


def water_fill(groups: DataFrame, ceiling: float = CEILING) -> DataFrame:
    """``groups`` (mix_key, words, weight) with ``target``: all words shared by weight, none above ceiling x words.

    What a full group can't take is shared among the others by weight, again and again; each
    round brings two sums to the driver.
    """
    full = F.lit(False)
    level = 0.0
    total = groups.agg(F.sum("words")).first()[0] or 0
    while True:
        held, weight, n = groups.agg(F.sum(F.when(full, ceiling * F.col("words"))), F.sum(F.when(~full, F.col("weight"))), F.sum(full.cast("int"))).first()
        if not weight:
            break
        level = (total - (held or 0.0)) / weight
        over = F.col("words") * ceiling <= F.lit(level) * F.col("weight")
        if groups.agg(F.sum(over.cast("int"))).first()[0] == (n or 0):
            break
        full = over
    return groups.withColumn("target", F.least(F.col("words") * ceiling, F.lit(level) * F.col("weight")))


def balance(cells: DataFrame, margins: dict[str, DataFrame], ceiling: float = CEILING, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """``cells`` (key columns, words) with ``rate``: the exponential tilt whose words meet all targets.

    margins: for each key column a frame (key column, target). Rounds go over the key columns:
    gradient (words at the present rates less target) and curvature (these words) are summed by
    Spark, then a damped Newton iteration moves each group's tilt. One key column needs one round;
    several need as many as make all of them agree.
    """
    state = cells.withColumn("tilt", F.lit(0.0))
    for _ in range(rounds):
        for column, targets in margins.items():
            mass = state.groupBy(column).agg(F.sum(F.col("words") * F.least(F.exp("tilt"), F.lit(ceiling))).alias("mass")).join(targets, column)

            def newton(x, _):
                words = F.col("mass") * F.exp(x)
                return x + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - words) / words))

            step = F.when((F.col("mass") > 0) & (F.col("target") > 0), F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(0.0), newton)).otherwise(F.lit(-700.0))
            state = state.join(small(written(mass.select(column, step.alias("step")), "mix_step")), column).withColumn("tilt", F.col("tilt") + F.col("step")).drop("step")
            state = written(state, "mix_state")
        if len(margins) == 1:
            break
        off = 0.0
        for column, targets in margins.items():
            mass = state.groupBy(column).agg(F.sum(F.col("words") * F.least(F.exp("tilt"), F.lit(ceiling))).alias("mass")).join(targets, column)
            off = max(off, mass.agg(F.max(F.abs(F.col("mass") - F.col("target")) / F.greatest(F.lit(1.0), F.col("target")))).first()[0] or 0.0)
        if off <= tolerance:
            break
    return state.withColumn("rate", F.least(F.exp("tilt"), F.lit(ceiling))).drop("tilt")


def _cut(rows: DataFrame, groups: DataFrame, rest: str, shift: int, width: int) -> DataFrame:
    """(mix_key, at, left): the slice of each group's order where its words pass ``rest``, and what is left there."""
    part = F.shiftright(F.col("mix_order"), shift).bitwiseAND(width - 1)
    bins = rows.groupBy("mix_key", part.alias("at")).agg(F.sum("mix_size").alias("words"))
    run = Window.partitionBy("mix_key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.join(small(groups.select("mix_key", F.col(rest).alias("rest"))), "mix_key").withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    last = before.where(F.col("before") < F.col("rest")).groupBy("mix_key").agg(F.max_by(F.struct("at", (F.col("rest") - F.col("before")).alias("left")), "at").alias("x"))
    return last.select("mix_key", F.col("x.at").alias("at"), F.col("x.left").alias("left"))


#: What rows are taken in the order of, and the bits of mix_row that count rows of one task's part of the table.
WHO, PART = ["mix_order", "mix_id", "mix_row"], 33


def copies(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` with what turns a row into copies: ``base``, ``cut`` and ``extra``.

    A row gets ``base`` copies, one more if its (mix_order, mix_id, mix_row) is at most ``cut`` or in
    ``extra``: a few rows, largest first, that fill what is left before the cut.

    The slice of the order in which the cut lies is summed by id and part of the table before it is run through, so
    that equal rows, however many, are a few sums; only the rows of one such sum are then run through themselves.
    """
    who = F.struct(*WHO)
    groups = groups.withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("words")))
    groups = groups.withColumn("rest", F.when(F.col("base") >= CEILING, F.lit(0.0)).otherwise(F.col("rest")))
    rows = rows.where(F.col("mix_size") > 0)
    one = written(_cut(rows, groups, "rest", BITS - LEVEL, 1 << LEVEL), "mix_cut")
    in_one = rows.join(small(one.withColumnRenamed("at", "first")), "mix_key").where(F.shiftright("mix_order", BITS - LEVEL) == F.col("first")).drop("first", "left")
    two = written(_cut(in_one, one, "left", BITS - 2 * LEVEL, 1 << LEVEL), "mix_cut")
    in_two = in_one.join(small(two.withColumnRenamed("at", "second")), "mix_key").where(F.shiftright("mix_order", BITS - 2 * LEVEL).bitwiseAND((1 << LEVEL) - 1) == F.col("second"))
    in_two = in_two.withColumn("part", F.shiftright("mix_row", PART))
    unit = ["mix_order", "mix_id", "part"]
    units = in_two.groupBy("mix_key", "left", *unit).agg(F.sum("mix_size").alias("words"))
    run = units.withColumn("run", F.sum("words").over(Window.partitionBy("mix_key").orderBy(*unit).rowsBetween(Window.unboundedPreceding, 0)))
    run = written(run, "mix_units")
    last_of_part = F.struct("mix_order", "mix_id", F.expr(f"shiftleft(part + 1, {PART}) - 1").alias("mix_row"))
    whole = run.where(F.col("run") <= F.col("left")).groupBy("mix_key").agg(F.max(F.struct(last_of_part.alias("who"), "run")).alias("whole"))
    broken = run.where(F.col("run") > F.col("left")).groupBy("mix_key").agg(F.min(F.struct(*unit, (F.col("run") - F.col("words")).alias("before"))).alias("unit"))
    broken = small(written(broken.select("mix_key", *[F.col(f"unit.{c}").alias(c) for c in unit], "unit.before"), "mix_broken"))
    inside = in_two.join(broken, ["mix_key", *unit])
    inside = inside.withColumn("run", F.col("before") + F.sum("mix_size").over(Window.partitionBy("mix_key").orderBy("mix_row").rowsBetween(Window.unboundedPreceding, 0)))
    broke = inside.where(F.col("run") <= F.col("left")).groupBy("mix_key").agg(F.max(F.struct(who.alias("who"), "run")).alias("broke"))
    last = whole.join(broke, "mix_key", "full").select("mix_key", F.coalesce("broke", "whole").alias("x"))
    floor_ = F.struct(
        ((F.col("one") * (1 << LEVEL) + F.col("two")) * (1 << (BITS - 2 * LEVEL)) - 1).cast("long").alias("mix_order"),
        F.lit(2**62).alias("mix_id"),
        F.lit(2**62).alias("mix_row"),
    )
    cuts = (
        one.withColumnRenamed("at", "one").drop("left")
        .join(two.withColumnRenamed("at", "two"), "mix_key")
        .join(last, "mix_key", "left")
        .select("mix_key", F.coalesce("x.who", floor_).alias("cut"), (F.col("left") - F.coalesce("x.run", F.lit(0))).alias("gap"))
    )
    groups = written(groups.join(cuts, "mix_key", "left"), "mix_groups")
    # One row of each group and size class that could still fit; the classes are few.
    beyond = rows.join(small(groups.select("mix_key", "cut", "gap")), "mix_key").where((who > F.col("cut")) & (F.col("mix_size") <= F.col("gap")))
    fit = beyond.groupBy("mix_key", F.floor(F.log2("mix_size") * 8).alias("class"), "gap").agg(F.min(F.struct(who.alias("who"), "mix_size")).alias("x"))

    def take(acc, x):
        fits = x["mix_size"] <= acc["gap"]
        return F.struct(
            F.when(fits, acc["gap"] - x["mix_size"]).otherwise(acc["gap"]).alias("gap"),
            F.when(fits, F.concat(acc["out"], F.array(x["who"]))).otherwise(acc["out"]).alias("out"),
        )

    none = F.array().cast("array<struct<mix_order:bigint,mix_id:bigint,mix_row:bigint>>")
    lists = fit.groupBy("mix_key", "gap").agg(F.sort_array(F.collect_list(F.struct(F.col("x.mix_size").alias("mix_size"), F.col("x.who").alias("who"))), asc=False).alias("xs"))
    extra = lists.select("mix_key", F.aggregate("xs", F.struct(F.col("gap").alias("gap"), none.alias("out")), take, lambda acc: acc["out"]).alias("extra"))
    return groups.join(extra, "mix_key", "left")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, ceiling: float = CEILING, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with mix_size, mix_source_size, mix_target, mix_rate and mix_copies.

    These are stored once, so that all steps tell equal rows apart in the same way.
    """
    own = ["mix_size", "mix_key", "mix_order", "mix_row"]
    kept = docs.columns if keep is None else keep
    with_id = sized(docs).withColumn("mix_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")))
    rows = written(with_id.select(*dict.fromkeys([*kept, "source"]), *own, "mix_id"), "mix_rows")
    flat = rows.select("mix_id", "source", *own)
    sources = flat.groupBy("mix_key", "source").agg(F.sum("mix_size").alias("words"))
    placed = ordered(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.array(*[F.lit(w) for w in weights])[F.col("place") % len(weights)]
    groups = written(water_fill(written(placed.select("mix_key", "words", weight.alias("weight")), "mix_sources"), ceiling), "mix_targets")
    rates = balance(groups.select("mix_key", "words"), {"mix_key": groups.select("mix_key", "target")}, ceiling)
    groups = copies(flat.drop("source"), groups.join(rates.select("mix_key", "rate"), "mix_key"))
    plan = small(written(groups.select("mix_key", F.col("words").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate"), "base", "cut", "extra"), "mix_plan"))
    who = F.struct(*WHO)
    more = (F.col("mix_size") > 0) & (F.coalesce(who <= F.col("cut"), F.lit(False)) | F.coalesce(F.array_contains("extra", who), F.lit(False)))
    return rows.join(plan, "mix_key").select(*kept, "mix_size", "mix_source_size", "mix_target", "mix_rate", (F.col("base").cast("long") + more.cast("long")).alias("mix_copies"))


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that a mix of all sources takes of each."""
    got = mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return got.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
        F.col("mix_copies").alias("copies"),
        F.col("mix_rate").alias("rate"),
    )


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; rows without words stay once, as they cost none."""
    got = mix(docs.select(*DOC_COLUMNS))
    times = F.when(F.col("mix_size") == 0, F.lit(1)).otherwise(F.col("mix_copies"))
    return got.where(times > 0).withColumn("_nth", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*DOC_COLUMNS)

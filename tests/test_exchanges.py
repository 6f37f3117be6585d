"""What intervals and requests exchange: bounds for a lot of samples, lists of names, lines made once; and the same results."""

import random

import pytest
from pyspark.sql import functions as F

from methgrid.operators import genome, intervals, levels, merge, requests
from methgrid.sources import output, scratch
from methgrid.sources import tables as src


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many(spark):
    """Twenty samples, three lots, of 300 sites."""
    rng = random.Random(3)
    pos = sorted(rng.sample(range(5000), 300))
    sites, chroms = genome.build(spark.createDataFrame([("g", "c", p) for p in pos], "genome string, chrom string, pos long"), spark.createDataFrame([("g", "c", 5000)], "genome string, chrom string, chrom_size long"))
    names = [f"s{i:02}" for i in range(20)]
    counts = {(s, i): (rng.randrange(9), rng.randrange(9)) for s in names for i in range(300) if rng.random() < 0.6}
    meth = spark.createDataFrame([("g", s, i, m, u) for (s, i), (m, u) in counts.items()], "genome string, sample string, site_idx long, n_meth int, n_unmeth int")
    rows = [(j, "g", "c", a := rng.randrange(5000), rng.randrange(a, 5001)) for j in range(40)]
    ranked = intervals.site_ranks(spark.createDataFrame(rows, "interval_id long, genome string, chrom string, start long, stop long"), sites, chroms)

    def brute(sample, start, stop):
        own = [counts.get((sample, i), (0, 0)) for i, p in enumerate(pos) if start <= p < stop]
        return sum(m for m, _ in own), sum(u for _, u in own), sum(m + u > 0 for m, u in own)

    return names, meth, rows, ranked, brute


def test_cells_of_several_lots(spark, many):
    names, meth, rows, ranked, brute = many
    samples = spark.createDataFrame([("g", s) for s in [*names, "unknown"]], "genome string, sample string")
    keys = ["interval_id", "chrom", "start", "stop"]
    long = levels.interval_levels(ranked, meth, samples, covered=True, keys=keys)
    want = {(j, s): brute(s, a, b) for j, _, _, a, b in rows for s in names} | {(j, "unknown"): (0, 0, 0) for j, *_ in rows}
    got = long.collect()
    assert len(got) == len(want) and {(r.interval_id, r["sample"]): (r.n_meth, r.n_unmeth, r.n_covered) for r in got} == want
    cells = levels.interval_cells(ranked, meth, samples, covered=True, keys=keys)
    assert {(r.interval_id, s): tuple(x) for r in cells.collect() for s, x in r.cells.items()} == want
    asked = ["s19", "s00", "s19", "s08"]
    for make in (lambda x: output.to_wide(x, ["chrom", "start", "stop"], asked, covered=True, names=list("wxyz")), lambda x: output.to_wide(x, ["chrom", "start", "stop"], asked, "classic", names=list("wxyz")), lambda x: output.to_lines(x, ["chrom", "start", "stop"], asked, covered=True), lambda x: output.to_lines(x, ["chrom", "start", "stop"], asked, "scores", min_reads=30)):
        assert sorted(map(tuple, make(cells).collect())) == sorted(map(tuple, make(long).collect()))


def test_tables_of_cells_need_no_exchange(spark):
    cells = scratch.stored(spark.range(10).select(F.col("id").alias("interval_id"), F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 5).alias("stop"), F.create_map(F.lit("a"), F.struct(F.col("id").alias("n_meth"), F.lit(3).cast("long").alias("n_unmeth"))).alias("cells")), "cells")
    for made in (output.to_wide(cells, ["chrom", "start", "stop"], ["a"]), output.to_lines(cells, ["chrom", "start", "stop"], ["a"], "scores")):
        assert made.count() == 10 and "Exchange" not in plan(made)


def test_bounds_are_not_exchanged_for_each_sample(spark, many, monkeypatch):
    names, meth, rows, ranked, brute = many
    samples = spark.createDataFrame([("g", s) for s in names], "genome string, sample string")
    seen = []
    real = levels.last_before

    def watched(events, *rest):
        seen.append(events.count())
        return real(events, *rest)

    monkeypatch.setattr(levels, "last_before", watched)
    levels.interval_cells(ranked, meth, samples).collect()
    distinct = ranked.select(F.explode(F.array("lo", "hi"))).distinct().count()
    assert seen == [3 * distinct]


def test_requests_are_judged_by_their_lists(spark):
    rows = [(i, "bins", 100, 50, h, names) for i, (h, names) in enumerate([(1, ["a"]), (1, ["a", "no"]), (1, ["a-b"]), (2, ["a"]), (None, ["a"]), (1, None), (1, []), (1, ["b", "a", "b"])] * 500)]
    asked = spark.createDataFrame(rows, "request_id long, kind string, aux long, step long, index_hash long, samples array<string>")
    genomes, meta = spark.createDataFrame([("g", 1)], "genome string, index_hash long"), spark.createDataFrame([("a", "g", 1), ("b", "g", 1)], "sample string, genome string, index_hash long")
    got = requests.statuses(asked, genomes, meta)
    want = ["ok", "methylome_not_found", "invalid_name", "invalid_index_hash", "invalid_index_hash", "invalid_sample_count", "invalid_sample_count", "ok"]
    assert [r.status for r in got.orderBy("request_id").collect()] == want * 500
    assert "Exchange hashpartitioning" not in plan(got)
    chroms = spark.createDataFrame([("g", "x", 1001), ("g", "y", 10)], "genome string, chrom string, chrom_size long")
    shaped = requests.shapes(requests.judged(asked, genomes, meta).where("status = 'ok'").drop("status"), genomes, chroms)
    assert {tuple(r)[1:] for r in shaped.collect()} == {(12, 1), (12, 3)} and shaped.count() == 1000
    assert "Exchange hashpartitioning" not in plan(shaped)


def test_lines_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    lines = spark.range(5000).select(F.lit("f").alias("file"), F.expr("id div 700").alias("block"), "id", F.concat_ws("\t", F.lit("c"), F.col("id").cast("string"), (F.col("id") + 3).cast("string")).alias("value")).mapInPandas(run, "file string, block long, id long, value string")
    got = src.parse_bed(lines, spark.createDataFrame([("c", 9000)], "chrom string, chrom_size long"))
    assert [(r.interval_id, r.start, r.error) for r in got.orderBy("interval_id").collect()] == [(i, i, None) for i in range(5000)]
    assert made.value == 5000


def test_columns_of_different_ranges_are_refused(spark):
    one = spark.range(5).select(F.col("id").alias("interval_id"), F.lit("a").alias("sample"))
    assert merge.add_column(one, one).count() == 10
    for more in (one.where("interval_id < 4"), one.unionByName(one.select(F.lit(9).cast("long").alias("interval_id"), "sample"))):
        for pair in ((one, more), (more, one)):
            with pytest.raises(ValueError):
                merge.add_column(*pair)


def test_partitions_follow_the_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        scratch.roomy(spark, 10, 250_000)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        scratch.roomy(spark, 10_000_001, 250_000)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "41"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_answers_are_given_to_lists_of_requests(spark, monkeypatch):
    answers = spark.range(30).select(F.lit("g").alias("genome"), (F.col("id") % 3).alias("aux"), F.lit("s").alias("sample"), F.col("id").alias("n_meth"))
    asked = spark.range(500).select(F.col("id").alias("request_id"), F.lit("g").alias("genome"), (F.col("id") % 4).alias("aux"), F.lit("s").alias("sample"), F.explode(F.array(F.lit(0), F.lit(1))).alias("col_ord"))
    want = sorted((i, c, n) for n in range(30) for i in range(500) for c in (0, 1) if i % 4 == n % 3)
    for rows, length in ((500_000, 10_000), (500_000, 7), (10, 7)):
        monkeypatch.setattr(requests, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(requests, "LIST", length)
        got = requests._given(answers, asked, ["genome", "aux", "sample"])
        assert sorted(map(tuple, got.select("request_id", "col_ord", "n_meth").collect())) == want
        assert ("Generate inline" in plan(got)) == (rows > 10)


def test_partitions_are_not_brought_together_again(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n, None) for n in names]
    try:
        spark.conf.unset(names[1])
        scratch.roomy(spark, 10_000_000, 250_000)
        # 96 MB that can't be compressed, for four cores.
        rows = spark.range(6_000_000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", "id").alias("b")).repartition("a")
        sizes = [r["count"] * 16 for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 96_000_000 and max(sizes) <= 12 << 20
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)

"""Range sums, windows and ranks against plain Python on small random tables."""

import random

import pytest
from pyspark.sql import functions as F

from methgrid.operators import check, genome, intervals, levels, merge


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    sizes = {"chr1": 400, "chr10": 37, "chr2": 150, "chr3": 10}
    pos = {c: sorted(rng.sample(range(n), n // 6)) if c != "chr3" else [] for c, n in sizes.items()}
    sites, chroms = genome.build(
        spark.createDataFrame([("g", c, p) for c, ps in pos.items() for p in ps], "genome string, chrom string, pos long"),
        spark.createDataFrame([("g", c, n) for c, n in sizes.items()], "genome string, chrom string, chrom_size long"),
    )
    flat = [(c, p) for c in sorted(pos) for p in pos[c]]
    counts = {(s, i): (rng.randrange(9), rng.randrange(9)) for s in ("a", "b") for i in range(len(flat)) if rng.random() < 0.7}
    meth = spark.createDataFrame([("g", s, i, m, u) for (s, i), (m, u) in counts.items()], "genome string, sample string, site_idx long, n_meth int, n_unmeth int")
    samples = spark.createDataFrame([("g", "a"), ("g", "b")], "genome string, sample string")

    def brute(chrom, start, stop, sample):
        got = [counts.get((sample, i), (0, 0)) for i, (c, p) in enumerate(flat) if c == chrom and start <= p < stop]
        return sum(m for m, _ in got), sum(u for _, u in got), sum(m + u > 0 for m, u in got)

    return sizes, flat, sites, chroms, meth, samples, brute


def test_sites_are_ranked_in_chromosome_order(small):
    sizes, flat, sites, chroms, *_ = small
    assert [(r.chrom, r.pos) for r in sites.orderBy("site_idx").collect()] == flat
    assert [r.chrom for r in chroms.orderBy("chrom_ord").collect()] == sorted(sizes)


def test_intervals_overlapping_empty_and_repeated(spark, small):
    sizes, flat, sites, chroms, meth, samples, brute = small
    rng = random.Random(1)
    rows = []
    for i in range(60):
        c = rng.choice(sorted(sizes))
        a = rng.randrange(sizes[c] + 1)
        rows.append((i, "g", c, a, rng.randrange(a, sizes[c] + 1)))
    rows += [(60, "g", "chr1", 5, 5), (61, "g", "chr1", 0, 400), (62, "g", "chr1", 0, 400), (63, "g", "chr3", 0, 10), (64, "g", "chr2", 150, 150)]
    iv = spark.createDataFrame(rows, "interval_id long, genome string, chrom string, start long, stop long")
    ranked = intervals.site_ranks(iv, sites, chroms)
    got = {(r.interval_id, r["sample"]): (r.n_meth, r.n_unmeth, r.n_covered) for r in levels.interval_levels(ranked, meth, samples, covered=True).collect()}
    assert got == {(i, s): brute(c, a, b, s) for i, _, c, a, b in rows for s in "ab"}
    cpgs = {r.interval_id: r.n_cpgs for r in intervals.n_cpgs(ranked).collect()}
    assert cpgs == {i: sum(c == x and a <= p < b for x, p in flat) for i, _, c, a, b in rows}


@pytest.mark.parametrize("size,step", [(30, 10), (25, 10), (10, 30), (7, 3), (10, 10), (200, 1), (1, 1)])
def test_windows(small, size, step):
    sizes, flat, sites, chroms, meth, samples, brute = small
    ranges = [(c, a, min(a + size, n)) for c, n in sizes.items() for a in range(0, n, step)]
    got = {(r.chrom, r.start, r.stop, r["sample"]): (r.n_meth, r.n_unmeth, r.n_covered) for r in levels.window_levels(chroms, sites, meth, samples, size, step, covered=True).collect()}
    assert got == {(c, a, b, s): brute(c, a, b, s) for c, a, b in ranges for s in "ab"}
    cpgs = {(r.chrom, r.start): r.n_cpgs for r in levels.window_cpgs(chroms, sites, size, step).collect()}
    assert cpgs == {(c, a): sum(c == x and a <= p < b for x, p in flat) for c, a, b in ranges}
    assert genome.n_windows(chroms, step).first().n_windows == len(ranges)


def test_bins_and_default_step(small):
    sizes, _, sites, chroms, meth, samples, brute = small
    got = {(r.chrom, r.start, r.stop, r["sample"]): (r.n_meth, r.n_unmeth) for r in levels.bin_levels(chroms, sites, meth, samples, 60).collect()}
    assert got == {(c, a, min(a + 60, n), s): brute(c, a, min(a + 60, n), s)[:2] for c, n in sizes.items() for a in range(0, n, 60) for s in "ab"}
    some = levels.bin_levels(chroms, sites, meth, samples, 60, keep_empty=False)
    assert all(r.n_meth + r.n_unmeth >= 0 for r in some.collect()) and some.count() <= len(got)
    with pytest.raises(ValueError):
        genome.windows(chroms, 1)


def test_requested_samples_keep_order_and_repeats(small):
    *_, meth, samples, _ = small
    got = levels.requested(meth, ["b", "a", "b"]).groupBy("sample", "col_ord").count().collect()
    assert {(r["sample"], r.col_ord) for r in got} == {("b", 0), ("a", 1), ("b", 2)}


def test_one_genome_guard(spark):
    meta = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "sample string, index_hash long")
    levels.check_one_genome(meta, ["a", "b"])
    with pytest.raises(ValueError):
        levels.check_one_genome(meta, ["a", "c"])


def test_merge_exact_and_rescaled(spark):
    meth = spark.createDataFrame([("g", "a", 0, 60000, 100), ("g", "b", 0, 60000, 100), ("g", "b", 4, 1, 2)], "genome string, sample string, site_idx long, n_meth int, n_unmeth int")
    got = {r.site_idx: (r.n_meth, r.n_unmeth) for r in merge.merge(meth, ["a", "b"], "ab").collect()}
    assert got == {0: (120000, 200), 4: (1, 2)}
    assert {r.site_idx: (r.n_meth, r.n_unmeth) for r in merge.merge(meth, ["a", "b"], "ab", "rescale").collect()} == {0: (65535, 109), 4: (1, 2)}


def test_add_column_needs_the_same_ranges(spark):
    a = spark.createDataFrame([(1, "a", 2)], "interval_id long, sample string, n_meth long")
    b = spark.createDataFrame([(1, "b", 3)], "interval_id long, sample string, n_meth long")
    assert merge.add_column(a, b).count() == 2
    with pytest.raises(ValueError):
        merge.add_column(a, b.withColumn("interval_id", F.lit(2).cast("long")))


def _adler(data: bytes, a: int = 0) -> int:
    b = 0
    for x in data:
        a = (a + x) % 65521
        b = (b + a) % 65521
    return b << 16 | a


def test_hashes(spark):
    pos = {"chr1": [10, 20], "chr10": [3, 17], "chr2": [5, 15]}
    sites, chroms = genome.build(
        spark.createDataFrame([("g", c, p) for c, ps in pos.items() for p in ps], "genome string, chrom string, pos long"),
        spark.createDataFrame([("g", "chr1", 22), ("g", "chr10", 19), ("g", "chr2", 17)], "genome string, chrom string, chrom_size long"),
    )
    assert check.index_hash(sites, chroms).first().index_hash == 63438916
    rng = random.Random(3)
    pairs = [(rng.randrange(65536), rng.randrange(65536)) if i % 3 else (0, 0) for i in range(500)]
    meth = spark.createDataFrame([("g", "s", i, m, u) for i, (m, u) in enumerate(pairs) if m + u], "genome string, sample string, site_idx long, n_meth int, n_unmeth int")
    n = spark.createDataFrame([("g", 500)], "genome string, n_sites long")
    data = b"".join(m.to_bytes(2, "little") + u.to_bytes(2, "little") for m, u in pairs)
    assert check.methylome_hash(meth, n).first().methylome_hash == _adler(data)


def test_check_report(spark, small):
    _, _, sites, chroms, meth, *_ = small
    index = check.index_hash(sites, chroms).first().index_hash
    n = chroms.groupBy("genome").agg(F.sum("n_sites").alias("n_sites"))
    hashes = {r["sample"]: r.methylome_hash for r in check.methylome_hash(meth, n).collect()}
    genomes = spark.createDataFrame([("g", "1", index, n.first().n_sites)], "genome string, version string, index_hash long, n_cpgs long")
    k = n.first().n_sites
    meta = spark.createDataFrame([("a", "g", "1", hashes["a"], index, k), ("b", "g", "1", hashes["b"] + 1, index, k), ("c", "h", "1", 0, 5, 3)], "sample string, genome string, version string, methylome_hash long, index_hash long, n_cpgs long")
    report = {r.name: (r.hash_ok, r.index_found, r.ok) for r in check.check_all(sites, chroms, genomes, meth, meta).collect()}
    assert report == {"g": (True, True, True), "a": (True, True, True), "b": (False, True, False), "c": (True, False, False)}
    assert not check.verdict(check.check_all(sites, chroms, genomes, meth, meta)).first().ok
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    assert {r.b: r.consistent for r in check.consistent_pairs(meta, pairs).collect()} == {"b": True, "c": False}
    assert [r[0] for r in meta.select(check.metadata_valid(["sample", "genome"])).collect()] == [True] * 3


def test_sorted_and_valid(spark):
    def frame(rows):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "interval_id long, chrom string, start long, stop long")

    good = frame([("chr2", 1, 5), ("chr2", 3, 4), ("chr1", 0, 9)])
    assert intervals.are_sorted(good).first().sorted and intervals.are_valid(good).first().valid
    assert not intervals.are_sorted(frame([("chr2", 3, 5), ("chr2", 1, 4)])).first().sorted
    assert not intervals.are_sorted(frame([("chr1", 1, 5), ("chr2", 1, 4), ("chr1", 7, 8)])).first().sorted
    assert not intervals.are_valid(frame([("chr1", 5, 1)])).first().valid
    assert intervals.are_sorted(frame([("chr1", 5, 1)]).limit(0)).first().sorted


def test_ranges_are_shuffled_for_their_bounds_not_for_samples(spark, small):
    """Equal bounds are looked up once for a sample: many equal intervals make no more lookups than one."""
    _, _, sites, chroms, meth, samples, _ = small
    one = spark.createDataFrame([("g", "chr1", 0, 100)], "genome string, chrom string, start long, stop long")
    many = one.crossJoin(spark.range(500).withColumnRenamed("id", "interval_id"))
    seen = []
    real = levels.last_before

    def counted(events, *rest):
        seen.append(events.count())
        return real(events, *rest)

    levels.last_before = counted
    try:
        got = levels.interval_levels(intervals.site_ranks(many, sites, chroms), meth, samples, True, chroms)
        assert got.count() == 500 * samples.count()
    finally:
        levels.last_before = real
    assert got.drop("interval_id").distinct().count() == samples.count()
    assert seen == [2 * samples.count()]

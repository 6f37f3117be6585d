"""Stored tables read by block, shared requests, ordered merges, byte ranges, sums of blocks and streams: what they read and what they answer."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from methgrid.functions import columns as fn
from methgrid.operators import catalog, check, genome, intervals, levels, pyramid, requests, scan
from methgrid.sources import counts, fasta, lines, output
from methgrid.sources import tables as src
from methgrid.streaming import ingest


def rows_read(spark, action):
    """What ``action`` returns, and the rows that its scans read, after pages were skipped."""
    jsc = spark.sparkContext._jsc.sc()
    gateway = spark.sparkContext._gateway

    def total():
        jsc.listenerBus().waitUntilEmpty()
        stages = jsc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).inputRecords() for i in range(stages.size()))

    before = total()
    got = action()
    return got, total() - before


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """A million sites on two chromosomes, two samples; stored marks, prefix sums and pyramid."""
    n, half = 1_000_000, 500_000
    folder = str(tmp_path_factory.mktemp("big"))
    i = F.col("id")
    sites = spark.range(n).select(F.lit("g").alias("genome"), F.when(i < half, "chr1").otherwise("chr2").alias("chrom"), (i >= half).cast("int").alias("chrom_ord"), (i % half * 10 + i % 7).alias("pos"), i.alias("site_idx"))
    chroms = spark.createDataFrame([("g", "chr1", 0, half * 10 + 7, 0, half), ("g", "chr2", 1, half * 10 + 7, half, half)], "genome string, chrom string, chrom_ord int, chrom_size long, chrom_offset long, n_sites long")
    m = spark.range(n).crossJoin(F.broadcast(spark.createDataFrame([("a", 3), ("b", 5)], "sample string, k int")))
    meth = m.where("id % k != 1").select(F.lit("g").alias("genome"), "sample", i.alias("site_idx"), (i % 11 + F.col("k")).cast("int").alias("n_meth"), (i % 13).cast("int").alias("n_unmeth"))
    output.write_marks(intervals.site_marks(sites, chroms), f"{folder}/marks")
    output.write_prefix(levels.prefix_sums(meth, chroms), f"{folder}/prefix")
    pyramid.write_pyramid(meth, sites, f"{folder}/pyramid", [50, 1000, 7000])
    return sites, chroms, meth, folder


def brute(chrom, start, stop, sample):
    half, k = 500_000, {"a": 3, "b": 5}[sample]
    i = np.arange(half) + (half if chrom == "chr2" else 0)
    pos = i % half * 10 + i % 7
    own = i[(pos >= start) & (pos < stop) & (i % k != 1)]
    return int((own % 11 + k).sum()), int((own % 13).sum()), len(own)


def test_forty_intervals_read_few_rows(spark, big):
    sites, chroms, meth, folder = big
    rng = random.Random(4)
    rows = [(j, "g", rng.choice(["chr1", "chr2"]), s := rng.randrange(4_990_000), s + rng.randrange(10_000)) for j in range(40)]
    asked = spark.createDataFrame(rows, "interval_id long, genome string, chrom string, start long, stop long")
    marks, prefix = output.read_marks(spark, f"{folder}/marks"), output.read_prefix(spark, f"{folder}/prefix")
    one = spark.createDataFrame([("g", "b")], "genome string, sample string")

    def answer():
        return levels.levels("intervals", chroms=chroms, sites=sites, methylomes=meth, samples=one, intervals=asked, marks=marks, prefix=prefix, covered=True).collect()

    got, read = rows_read(spark, answer)
    assert {r.interval_id: (r.n_meth, r.n_unmeth, r.n_covered) for r in got} == {j: brute(c, a, b, "b") for j, _, c, a, b in rows}
    stored = 1_000_000 + 1_000_000 * (2 / 3 + 4 / 5)
    # Bounds lie in up to 80 blocks of each table; chromosome 2's two clusters below touch two.
    assert read < 0.16 * stored
    near = spark.createDataFrame([(j, "g", "chr2", 3_000_000 + 50 * j, 3_000_900 + 60 * j) for j in range(40)], asked.schema)
    got, read = rows_read(spark, lambda: levels.levels("intervals", chroms=chroms, sites=sites, methylomes=meth, samples=one, intervals=near, marks=marks, prefix=prefix, covered=True).collect())
    assert {r.interval_id: (r.n_meth, r.n_unmeth, r.n_covered) for r in got} == {j: brute("chr2", 3_000_000 + 50 * j, 3_000_900 + 60 * j, "b") for j in range(40)}
    assert read < 0.01 * stored


def test_prepared_query_reads_its_ranks_alone(spark, big):
    sites, chroms, meth, folder = big
    asked = spark.createDataFrame([(j, "g", "chr2", 3_000_000 + 50 * j, 3_000_900 + 60 * j) for j in range(40)], "interval_id long, genome string, chrom string, start long, stop long")
    ranked = intervals.prepare(asked, sites, chroms, output.read_marks(spark, f"{folder}/marks"))
    for name in "ab":
        one = spark.createDataFrame([("g", name)], "genome string, sample string")
        got, read = rows_read(spark, lambda one=one: levels.interval_levels(ranked, meth, one, True, chroms, output.read_prefix(spark, f"{folder}/prefix"), prepared=True).collect())
        assert {r.interval_id: (r.n_meth, r.n_unmeth, r.n_covered) for r in got} == {j: brute("chr2", 3_000_000 + 50 * j, 3_000_900 + 60 * j, name) for j in range(40)}
        # The ranks twice, and a few blocks.
        assert read <= 2 * 40 + 3 * 1025


def test_stored_marks_aren_t_shuffled_whole(spark, big):
    sites, chroms, _, folder = big
    marks = output.read_marks(spark, f"{folder}/marks")
    bounds = spark.createDataFrame([("g", "chr1", 3), ("g", "chr1", 200), ("g", "chr2", 7)], "genome string, chrom string, block long")
    got, hot = scan.only_blocks(marks, bounds, ["genome", "chrom"])
    assert hot == []
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.chrom, r.block) for r in got.select("chrom", "block").distinct().collect()} == {("chr1", 3), ("chr1", 200), ("chr2", 7)}
    assert scan.only_blocks(marks, bounds.limit(0), ["genome", "chrom"])[0].count() == 0


def test_many_bounds_in_one_block(spark, big, monkeypatch):
    sites, chroms, meth, folder = big
    marks, prefix = output.read_marks(spark, f"{folder}/marks"), output.read_prefix(spark, f"{folder}/prefix")
    asked = spark.range(3000).select(F.col("id").alias("interval_id"), F.lit("g").alias("genome"), F.lit("chr1").alias("chrom"), (F.col("id") % 50 + 700_000).alias("start"), (F.col("id") % 70 * 3 + 700_100).alias("stop"))
    one = spark.createDataFrame([("g", "a"), ("g", "b")], "genome string, sample string")

    def answer():
        got = levels.levels("intervals", chroms=chroms, sites=sites, methylomes=meth, samples=one, intervals=asked, marks=marks, prefix=prefix, covered=True)
        return sorted(map(tuple, got.collect()))

    even = answer()
    monkeypatch.setattr(scan, "HOT", 500)
    _, hot = scan.only_blocks(prefix, levels.bounds_of(intervals.site_ranks(asked, sites, chroms, marks)), ["genome"])
    assert hot and all(parts > 1 for *_, parts in hot)
    assert answer() == even and len(even) == 6000
    assert even[0][2:] == brute("chr1", 700_000, 700_100, "a") and {r[2:] for r in even if r[0] == 7 and r[1] == "b"} == {brute("chr1", 700_007, 700_121, "b")}


def test_block_ranges():
    assert scan.block_ranges([(("g",), b) for b in (1, 2, 3, 9, 20, 21)]) == [(("g",), 1, 3), (("g",), 9, 9), (("g",), 20, 21)]
    assert scan.block_ranges([(("g",), b) for b in (1, 2, 3, 9, 20, 21)], 2) == [(("g",), 1, 9), (("g",), 20, 21)]
    many = [(("g", c), b) for c in "ab" for b in range(0, 3000, 3)]
    ranges = scan.block_ranges(many, 10)
    assert all(any(k == key and first <= b <= last for k, first, last in ranges) for key, b in many)


@pytest.mark.parametrize("size,step,unit", [(7000, 7000, 7000), (2000, 2000, 1000), (150, 150, 50), (9000, 3000, 1000), (333, 333, None)])
def test_pyramid(spark, big, size, step, unit):
    sites, chroms, meth, folder = big
    stack = pyramid.read_pyramid(spark, f"{folder}/pyramid", [50, 1000, 7000])
    samples = spark.createDataFrame([("g", "a")], "genome string, sample string")
    assert stack.unit(size if size == step else 3000) == unit
    if size == step:
        got, read = rows_read(spark, lambda: levels.bin_levels(chroms, sites, meth, samples, size, covered=True, pyramid=stack).collect())
        want = levels.bin_levels(chroms, sites, meth, samples, size, covered=True)
    else:
        got, read = rows_read(spark, lambda: levels.window_levels(chroms, sites, meth, samples, size, step, covered=True, pyramid=stack).collect())
        want = levels.window_levels(chroms, sites, meth, samples, size, step, covered=True)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    assert unit is None or read <= 2 * 5_000_007 / unit + 2


def test_shared_requests(spark, big):
    sites, chroms, meth, folder = big
    marks, prefix = output.read_marks(spark, f"{folder}/marks"), output.read_prefix(spark, f"{folder}/prefix")
    asked = spark.range(1000).select(F.col("id").alias("request_id"), F.lit("intervals").alias("kind"), F.lit(2).cast("long").alias("aux"), F.lit(None).cast("long").alias("step"), F.lit("g").alias("genome"), F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("samples"))
    ranges = spark.createDataFrame([(0, "chr1", 500, 9000), (1, "chr2", 70, 80)], "interval_id long, chrom string, start long, stop long")
    every = asked.select("request_id").crossJoin(F.broadcast(ranges))
    _, pairs = requests.interval_pairs(asked, every, chroms, sites, marks)
    assert pairs.count() == 4
    got = requests.answer_intervals(asked, every, chroms, sites, meth, marks, prefix, covered=True).collect()
    want = {(i, c): brute(chrom, a, b, s) for i, chrom, a, b in [(0, "chr1", 500, 9000), (1, "chr2", 70, 80)] for c, s in enumerate("bab")}
    assert len(got) == 6000 and all((r.n_meth, r.n_unmeth, r.n_covered) == want[r.interval_id, r.col_ord] for r in got)


def test_contigs_by_ordered_merge(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 2, 3, 400]) for _ in range(3000)] + [200_000, 0, 5]
    offsets = [0, *itertools.accumulate(sizes)]
    chroms = spark.createDataFrame([("g", f"c{i}", i, offsets[i], n) for i, n in enumerate(sizes)], "genome string, chrom string, chrom_ord int, chrom_offset long, n_sites long")
    rows = spark.range(offsets[-1]).select(F.lit("g").alias("genome"), F.col("id").alias("site_idx"), (F.col("id") * 2).alias("pos"))
    placed = src.placed_in_contigs(rows, chroms)
    got = {r.chrom: (r.a, r.b, r.n) for r in placed.groupBy("chrom").agg(F.min("site_idx").alias("a"), F.max("site_idx").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == {f"c{i}": (offsets[i], offsets[i + 1] - 1, n) for i, n in enumerate(sizes) if n}
    assert "BroadcastHashJoin" not in placed._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in placed._jdf.queryExecution().executedPlan().toString()


def test_binary_files_in_ranges(spark, tmp_path):
    n = 5000
    pos = np.sort(np.random.default_rng(1).choice(100_000, n, replace=False)).astype("<u4")
    (tmp_path / "g.cpg_idx").write_bytes(pos.tobytes())
    (tmp_path / "g.cpg_idx.json").write_text(json.dumps({"genome_name": "g", "n_cpgs": n, "chrom_order": ["x", "y"], "chrom_size": [100_000, 100_000], "chrom_offset": [0, 1234]}))
    pairs = np.random.default_rng(2).integers(0, 3, (n, 2)).astype("<u2")
    for name in ("s", "t"):
        (tmp_path / f"{name}.m16").write_bytes(pairs.tobytes())
        (tmp_path / f"{name}.m16.json").write_text(json.dumps({"version": "1", "methylome_hash": 1, "index_hash": 2, "genome_name": "g", "n_cpgs": n, "is_compressed": False}))
    ranges = src.byte_ranges(spark, str(tmp_path), "*.cpg_idx", 4, 1001)
    assert ranges.rdd.getNumPartitions() == 20 and ranges.count() == 20
    sites, _ = src.read_index(spark, str(tmp_path), 1001)
    assert [(r.chrom, r.pos) for r in sites.orderBy("site_idx").collect()] == [("x" if i < 1234 else "y", int(p)) for i, p in enumerate(pos)]
    meth, _ = src.read_methylomes(spark, str(tmp_path), 999)
    want = sorted((name, i, int(m), int(u)) for name in "st" for i, (m, u) in enumerate(pairs) if m + u)
    assert sorted((r["sample"], r.site_idx, r.n_meth, r.n_unmeth) for r in meth.collect()) == want
    (tmp_path / "t.m16").write_bytes(pairs.tobytes()[:-2])
    with pytest.raises(ValueError):
        src.read_methylomes(spark, str(tmp_path))


#: A counts file that doesn't end in a line feed, its genome, and what follows from it.
UNTERMINATED = """#ignore this header line
chr1 10 + CG 0.9 10
chr1 20 + CG 0.5 12
chr2 5 + CG 0.1 10
chr2 15 + CG 0.9 20
chr10 3 + CG 0.8 5
chr10 17 + CG 0.3 15"""
POSITIONS = {"chr1": (22, [10, 20]), "chr10": (19, [3, 17]), "chr2": (17, [5, 15])}


def _small_genome(spark):
    return genome.build(
        spark.createDataFrame([("g", c, p) for c, (_, ps) in POSITIONS.items() for p in ps], "genome string, chrom string, pos long"),
        spark.createDataFrame([("g", c, n) for c, (n, _) in POSITIONS.items()], "genome string, chrom string, chrom_size long"),
    )


@pytest.mark.parametrize("drop,checksum,text", [(True, 44695609, ["chr1\t0\t22\t15\t7", "chr10\t0\t19\t4\t1", "chr2\t0\t17\t19\t11"]), (False, 55181384, ["chr1\t0\t22\t15\t7", "chr10\t0\t19\t9\t11", "chr2\t0\t17\t19\t11"])])
def test_unterminated_last_line(spark, tmp_path, drop, checksum, text):
    sites, chroms = _small_genome(spark)
    (tmp_path / "s.sym").write_text(UNTERMINATED)
    rows = counts.parse_counts(lines.read_lines(spark, str(tmp_path / "s.sym"), drop_unterminated=drop))
    meth, rejects = counts.align(rows.withColumns({"genome": F.lit("g"), "sample": F.lit("s")}), sites)
    n = spark.createDataFrame([("g", 6)], "genome string, n_sites long")
    assert rejects.count() == 0 and check.methylome_hash(meth, n).first().methylome_hash == checksum
    samples = spark.createDataFrame([("g", "s")], "genome string, sample string")
    output.write_lines(output.to_lines(levels.bin_levels(chroms, sites, meth, samples, 100), ["chrom", "start", "stop"], ["s"]), ["chrom", "start"], str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == text


def test_ends_of_several_files(spark, tmp_path):
    import gzip

    contents = {"a.txt": "1\n2\n3", "b.txt": "4\r\n5\r\n", "c.txt": "", "d.txt": "6", "e.txt": "é\n\n"}
    for name, text in contents.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "f.txt.gz").write_bytes(gzip.compress(b"7\n8"))
    got = lines.read_lines(spark, str(tmp_path), drop_unterminated=True).collect()
    assert sorted((r.file[-5:], r.value) for r in got) == [("a.txt", "1"), ("a.txt", "2"), ("b.txt", "4"), ("b.txt", "5"), ("e.txt", ""), ("e.txt", "é"), ("xt.gz", "7"), ("xt.gz", "8")]


def test_fasta_of_the_small_genome(spark, tmp_path):
    text = {}
    for c, (n, ps) in POSITIONS.items():
        letters = ["A"] * n
        for p in ps:
            letters[p : p + 2] = "CG"
        text[c] = "".join(letters)
    (tmp_path / "g.fa").write_text("".join(f">{c}\n{s[:7]}\n{s[7:]}\n" for c, s in text.items()))
    got = fasta.parse(lines.read_lines(spark, str(tmp_path / "g.fa")), "CG")[0].collect()
    assert sorted((r.chrom, r.pos) for r in got) == sorted((c, p) for c, (_, ps) in POSITIONS.items() for p in ps)


def test_numbers_of_a_hot_group(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 100).cast("string"))).alias("group"), (F.col("id") * 7919 % 40_009).alias("k"))
    got = scan.numbered(rows, ["group"], ["k"], "n")
    by = {}
    for r in got.collect():
        by.setdefault(r.group, []).append((r.n, r.k))
    assert all([n for n, _ in sorted(v)] == list(range(1, len(v) + 1)) and [k for _, k in sorted(v)] == sorted(k for _, k in v) for v in by.values())
    spread = rows.repartitionByRange(4, "group", "k").where("group = 'hot'").groupBy(F.spark_partition_id()).count()
    assert spread.agg(F.max("count")).first()[0] < 0.6 * 36_000


def test_search_in_one_pass(spark):
    rng = random.Random(6)
    words = ["liver", "Brain", "blood", "cell", "t(x)"]
    rows = [(str(i), rng.choice([*words, None]), {rng.choice("ab"): rng.choice([*words, None]), "c": rng.choice(words)} if i % 9 else None) for i in range(200)]
    info = spark.createDataFrame(rows, "accession string, label string, metadata map<string,string>")
    import re

    for patterns in (["liver"], ["brain", "nothing", "blood"], ["liver", "brain", "blood", "cell"], ["zzz"], [], ["LIVER", "^b", "cell", "brain"]):
        want = rows
        for p in patterns:
            hit = [r for r in want if any(v is not None and re.search(p, v, re.I) for v in [r[1], *(r[2] or {}).values()])]
            want = hit or want
        assert sorted(r.accession for r in catalog.search(info, patterns).collect()) == sorted(r[0] for r in want)
    assert catalog.search(info.limit(0), ["x"]).count() == 0


def test_sums_of_blocks(spark, big):
    sites, chroms, meth, _ = big
    n = spark.createDataFrame([("g", 1_000_000)], "genome string, n_sites long")
    before = scan.stored(check.methylome_sums(meth, 4096), "sums")
    whole = {r["sample"]: r.methylome_hash for r in check.methylome_hash(meth, n).collect()}
    assert {r["sample"]: r.methylome_hash for r in check.hash_of_sums(before, n).collect()} == whole
    changed = meth.withColumn("n_unmeth", F.when((F.col("sample") == "a") & F.col("site_idx").isin(5000, 700_001), 60_000).otherwise(F.col("n_unmeth")))
    odd = check.changed_blocks(before, check.methylome_sums(changed, 4096), ["genome", "sample"])
    assert sorted((r["sample"], r.block) for r in odd.collect()) == [("a", 5000 // 4096), ("a", 700_001 // 4096)]
    after = check.updated_sums(before, changed, odd, 4096)
    assert {r["sample"]: r.methylome_hash for r in check.hash_of_sums(after, n).collect()} == {r["sample"]: r.methylome_hash for r in check.methylome_hash(changed, n).collect()}
    stored = scan.stored(check.site_sums(sites, chroms), "site_sums")
    assert check.index_hash_of_sums(stored, chroms).first() == check.index_hash(sites, chroms).first()
    moved = sites.withColumn("pos", F.when(F.col("site_idx") == 600_000, F.col("pos") + 1).otherwise(F.col("pos")))
    assert [(r.chrom, r.block) for r in check.changed_blocks(stored, check.site_sums(moved, chroms), ["genome", "chrom"]).collect()] == [("chr2", 100_000 // check.BLOCK)]


def test_elements_of_a_stored_result(spark, tmp_path):
    result = spark.range(200_000).select((F.col("id") % 50_000).alias("interval_id"), F.expr("cast(id div 50000 as int)").alias("col_ord"), (F.col("id") * 3).alias("n_meth"), (F.col("id") % 5).alias("n_unmeth"), F.lit(1).cast("long").alias("n_covered"))
    output.write_result(result, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    row, read = rows_read(spark, lambda: requests.at(back, 31_000, 2))
    assert row.n_meth == 3 * 131_000 and read <= 2 * output.PAGE_ROWS
    assert (requests.n_meth(back, 7, 0), requests.n_unmeth(back, 8, 1), requests.n_covered(back, 7, 3)) == (21, 50_008 % 5, 1)
    assert requests.element_wmean(back, 1, 0) == 3 / 4
    for wrong in ((50_000, 0), (0, 4), (-1, 0)):
        with pytest.raises(IndexError):
            requests.at(back, *wrong)


def test_lines_with_a_header(spark, tmp_path):
    rows = spark.range(3000).select(F.lit("chr1").alias("chrom"), (2999 - F.col("id")).alias("start"), (2999 - F.col("id")).cast("string").alias("line"))
    output.write_lines(rows, ["chrom", "start"], str(tmp_path / "out"), "head")
    got = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert got == ["head", *map(str, range(3000))]


def test_wide_means_and_order(spark):
    wide = spark.createDataFrame([("r", 3, 1, 2, 0, 0, 0)], "name string, x_M long, x_U long, x_C long, y_M long, y_U long, y_C long")
    got = fn.matrix_wmeans(wide, ["name"], has_covered=True)
    assert got.columns == ["name", "x", "y"] and tuple(got.first()) == ("r", 0.75, None)
    with pytest.raises(ValueError):
        fn.matrix_wmeans(wide.drop("y_C"), ["name"])
    pairs = spark.createDataFrame([((1, 5, 9), (1, 5, 9)), ((1, 5, 9), (1, 5, 10)), ((2, 0, 1), (1, 5, 9))], "a struct<chrom_ord:int,start:long,stop:long>, b struct<chrom_ord:int,start:long,stop:long>")
    assert [r[0] for r in pairs.select(intervals.compared("a", "b")).collect()] == [0, -1, 1]


def test_delta_coded_files_in_a_stream(spark, tmp_path):
    n = 4000
    sites = spark.range(2 * n).select(F.lit("g").alias("genome"), F.when(F.col("id") < n, "chr1").otherwise("chr2").alias("chrom"), (F.col("id") % n * 3).alias("pos"), F.col("id").alias("site_idx"))
    (tmp_path / "in").mkdir()

    def delta(shift):
        return "#chr1 99999\n" + "".join(f"chr{c}\n" + "".join(f"{3 if i else 0} {(i + shift) % 9} {i % 4 + 1}\n" for i in range(n)) for c in (1, 2))

    def watch():
        q = ingest.watch_counts(spark, str(tmp_path / "in"), sites, "g", str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True)
        q.awaitTermination()

    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # many splits of a file
    try:
        (tmp_path / "in" / "S1.xsym").write_text(delta(0))
        (tmp_path / "in" / "S2.sym").write_text("chr1 3 + CG 0.5 4\nchr1 4 + CG 0.5 4\n")
        watch()
        (tmp_path / "in" / "S3.xsym").write_text(delta(5))
        (tmp_path / "in" / "S4.txt").write_text("what is this\n")
        watch()  # a new query goes on where the last one ended
        watch()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {(s, c * n + i, (i + shift) % 9, i % 4 + 1) for s, shift in (("S1", 0), ("S3", 5)) for c in (0, 1) for i in range(n)} | {("S2", 1, 2, 2)}
    assert len(got) == len(want) and {(r["sample"], r.site_idx, r.n_meth, r.n_unmeth) for r in got} == want
    assert sorted((r["sample"], r.error) for r in spark.read.parquet(str(tmp_path / "out_rejects")).collect()) == [("S2", "not a site"), ("S4", "unknown format")]


def test_binary_files_written(spark, tmp_path):
    sites, chroms = _small_genome(spark)
    meth = spark.createDataFrame([("g", "s", 1, 70_000, 7), ("g", "s", 4, 0, 3)], "genome string, sample string, site_idx long, n_meth int, n_unmeth int")
    genomes = spark.createDataFrame([("g", "1", 63438916, 6)], "genome string, version string, index_hash long, n_cpgs long")
    meta = spark.createDataFrame([("s", "g", "1", 5, 63438916, 6), ("t", "g", "1", 0, 63438916, 6)], "sample string, genome string, version string, methylome_hash long, index_hash long, n_cpgs long")
    for _ in range(2):  # writing again replaces the files
        output.write_binary_index(sites, chroms, genomes, str(tmp_path))
        output.write_binary_methylomes(meth, meta, f"file://{tmp_path}")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["g.cpg_idx", "g.cpg_idx.json", "s.m16", "s.m16.json", "t.m16", "t.m16.json"]
    assert np.frombuffer((tmp_path / "g.cpg_idx").read_bytes(), "<u4").tolist() == [10, 20, 3, 17, 5, 15]
    assert np.frombuffer((tmp_path / "s.m16").read_bytes(), "<u2").tolist() == [0, 0, 65535, 7, 0, 0, 0, 0, 0, 3, 0, 0]
    assert (tmp_path / "t.m16").read_bytes() == bytes(24)
    assert json.loads((tmp_path / "g.cpg_idx.json").read_text())["chrom_offset"] == [0, 2, 4]
    back, chroms_back = src.read_index(spark, str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sites.select(*back.columns).collect()))
    assert sorted((r.chrom, r.n_sites) for r in chroms_back.collect()) == [("chr1", 2), ("chr10", 2), ("chr2", 2)]
    got, _ = src.read_methylomes(spark, str(tmp_path))
    assert sorted((r["sample"], r.site_idx, r.n_meth, r.n_unmeth) for r in got.collect()) == [("s", 1, 65535, 7), ("s", 4, 0, 3)]


def test_half_a_million_contigs(spark):
    n, i = 500_000, F.col("id")
    offset = F.expr("id div 3 * 3 + greatest(id % 3 - 1, 0)")
    chroms = spark.range(n).select(F.lit("g").alias("genome"), F.concat(F.lit("c"), i.cast("string")).alias("chrom"), i.cast("int").alias("chrom_ord"), offset.alias("chrom_offset"), (i % 3).alias("n_sites"))
    rows = spark.range(n - 2).select(F.lit("g").alias("genome"), i.alias("site_idx"), i.alias("pos"))
    got = src.placed_in_contigs(rows, chroms)
    want = F.expr("site_idx div 3 * 3 + if(site_idx % 3 = 0, 1, 2)").cast("int")
    assert got.agg(F.count(F.lit(1)), F.sum((F.col("chrom_ord") != want).cast("int"))).first()[:] == (n - 2, 0)


def test_small_ranges_don_t_make_a_task_each(spark, tmp_path):
    """A file of 25,000 ranges is read by few tasks, and each range comes once."""
    (tmp_path / "a.m16").write_bytes(np.arange(100_000, dtype="<u4").tobytes())
    got = src.byte_ranges(spark, str(tmp_path), "*.m16", 4, 16)
    assert got.rdd.getNumPartitions() <= 2 * src.SPREAD
    rows = got.orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(0, 400_000, 16))
    assert b"".join(bytes(r.content) for r in rows) == (tmp_path / "a.m16").read_bytes()

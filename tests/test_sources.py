"""Readers, parsers, text output and column functions."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from methgrid.functions import columns as fn
from methgrid.operators import catalog, requests
from methgrid.sources import counts, fasta, lines, output
from methgrid.sources import tables as src
from methgrid.streaming import ingest


def as_lines(spark, values, file="f"):
    return spark.createDataFrame([(file, i // 3, i, v) for i, v in enumerate(values)], "file string, block long, id long, value string")


@pytest.mark.parametrize("split", ["40", "1000000"])
def test_fasta_with_splits(spark, tmp_path, split):
    rng = random.Random(2)
    seqs = {f"chr{c}": "".join(rng.choice("acgtCGN") for _ in range(n)) for c, n in ((1, 301), (10, 57), (2, 120))}
    text = "".join(f">{c}\n" + "\n".join(s[i : i + 13] for i in range(0, len(s), 13)) + "\n" for c, s in seqs.items())
    (tmp_path / "tiny.fa").write_text(text.rstrip("\n"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        sites, chroms = fasta.read_genome(spark, str(tmp_path / "tiny.fa"))
        got = sorted((r.genome, r.chrom, r.pos) for r in sites.collect())
        sizes = {r.chrom: r.chrom_size for r in chroms.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sizes == {c: len(s) for c, s in seqs.items()}
    assert got == sorted(("tiny", c, i) for c, s in seqs.items() for i in range(len(s) - 1) if s[i : i + 2].upper() == "CG")


def test_motifs(spark):
    rows = spark.createDataFrame([("ACGTGCGTGCGT",), ("AACCTTGG",), ("",), ("cg",), (None,)], "s string")
    got = [r[0] for r in rows.select(fasta.motif_positions(F.col("s"))).collect()]
    assert got == [[1, 5, 9], [], [], [0], None]
    assert rows.limit(1).select(fasta.motif_positions(F.lit("aaab"), "AA")).first()[0] == [0, 1]


def test_fasta_name_is_checked(spark, tmp_path):
    (tmp_path / "tiny.txt").write_text(">c\nCG\n")
    with pytest.raises(ValueError):
        fasta.read_genome(spark, str(tmp_path / "tiny.txt"))


def test_counts_text(spark):
    got = counts.parse_counts(as_lines(spark, ["# x", "chr1\t5\t+\tCG\t0.333333\t3", "chr1 9 + CG 0.0505050505 99", "chr1 9 + CG 0.0795454545 88", "chr1 x + CG 0.5 2", "chr1 3 + CG 1.5 2", "chr1 3", "chr1 1 - CG 1 200000"]))
    rows = [(r.pos, r.n_meth, r.n_unmeth, r.error) for r in got.collect()]
    assert rows == [(5, 1, 2, None), (9, 5, 94, None), (9, 7, 81, None), (None, None, None, "bad position"), (3, None, None, "bad level"), (3, None, None, "too few fields"), (1, 65535, 0, None)]


def test_xcounts_text(spark):
    text = ["#v", "#chr1 100", "#", "chr1", "5 1 2", "10 3 4", "chr2", "7 1 1", "bad 1 1", "1 0 9"]
    got = {(r.chrom, r.pos, r.n_meth, r.n_unmeth) for r in counts.parse_xcounts(as_lines(spark, text)).where("error is null").collect()}
    assert got == {("chr1", 5, 1, 2), ("chr1", 15, 3, 4), ("chr2", 7, 1, 1), ("chr2", 8, 0, 9)}
    chroms = spark.createDataFrame([("chr1", 99)], "chrom string, chrom_size long")
    assert [r.error for r in counts.header_errors(as_lines(spark, text), chroms).collect()] == ["other size"]
    both = as_lines(spark, text, "x").unionByName(as_lines(spark, ["chr1 5 + CG 0.3 3"], "c")).unionByName(as_lines(spark, ["<html> a"], "u"))
    assert {r.file: r.format for r in counts.detect(both).collect()} == {"x": "xcounts", "c": "counts", "u": "unknown"}


def test_align(spark):
    sites = spark.createDataFrame([("g", "chr1", 5, 0), ("g", "chr1", 9, 1)], "genome string, chrom string, pos long, site_idx long")
    rows = spark.createDataFrame([("g", "s", "chr1", 5, 1, 2, None), ("g", "s", "chr1", 6, 1, 2, None), ("g", "s", "chr1", 9, 1, 2, None), ("g", "s", "chr1", 9, 3, 4, None), ("g", "s", "chr1", None, None, None, "bad position")], "genome string, sample string, chrom string, pos long, n_meth int, n_unmeth int, error string")
    kept, rejects = counts.align(rows, sites, "permissive")
    assert [(r.site_idx, r.n_meth) for r in kept.collect()] == [(0, 1)]
    assert sorted(r.error for r in rejects.collect()) == ["bad position", "not a site", "repeated position"]
    with pytest.raises(ValueError):
        counts.align(rows, sites)


def test_bed(spark, tmp_path):
    chroms = spark.createDataFrame([("chr1", 100)], "chrom string, chrom_size long")
    (tmp_path / "x.bed").write_text("chr1 0 10 name\nchr1\t5\t101\nchr9 1 2\nchr1 9 3\nchr1 a 3\nchr1 100 100")
    got = src.parse_bed(lines.read_lines(spark, str(tmp_path / "x.bed")), chroms).orderBy("interval_id").collect()
    assert [(r.interval_id, r.error) for r in got] == [(0, None), (1, "beyond the chromosome"), (2, "unknown chromosome"), (3, "start beyond stop"), (4, "bad interval"), (5, None)]


def test_binary_import(spark, tmp_path):
    pos = [10, 20, 3, 17]
    (tmp_path / "g.cpg_idx").write_bytes(struct.pack("<4I", *pos))
    (tmp_path / "g.cpg_idx.json").write_text(json.dumps({"genome_name": "g", "n_cpgs": 4, "chrom_order": ["chr1", "chr10"], "chrom_size": [22, 19], "chrom_offset": [0, 2]}))
    sites, chroms = src.read_index(spark, str(tmp_path))
    assert [(r.chrom, r.pos) for r in sites.orderBy("site_idx").collect()] == [("chr1", 10), ("chr1", 20), ("chr10", 3), ("chr10", 17)]
    (tmp_path / "s.m16").write_bytes(struct.pack("<8H", 1, 2, 0, 0, 3, 4, 0, 65535))
    (tmp_path / "s.m16.json").write_text(json.dumps({"version": "1", "methylome_hash": 1, "index_hash": 2, "genome_name": "g", "n_cpgs": 4, "is_compressed": False}))
    meth, meta = src.read_methylomes(spark, str(tmp_path))
    assert sorted((r["sample"], r.site_idx, r.n_meth, r.n_unmeth) for r in meth.collect()) == [("s", 0, 1, 2), ("s", 2, 3, 4), ("s", 3, 0, 65535)]
    (tmp_path / "g.cpg_idx").write_bytes(struct.pack("<3I", *pos[:3]))
    with pytest.raises(ValueError):
        src.read_index(spark, str(tmp_path))


def test_names_and_catalog(spark, tmp_path):
    (tmp_path / "l.txt").write_text("SRX2\nSRX1\n")
    (tmp_path / "l.json").write_text('{"b": "SRX1", "a": "SRX2"}')
    assert [r["sample"] for r in src.read_names(spark, str(tmp_path / "l.txt")).orderBy("col_ord").collect()] == ["SRX2", "SRX1"]
    assert [(r.label, r["sample"]) for r in src.read_names(spark, str(tmp_path / "l.json")).orderBy("col_ord").collect()] == [("a", "SRX2"), ("b", "SRX1")]
    (tmp_path / "c.json").write_text(json.dumps({"g": {"S1": {"label": "x", "metadata": {"tissue": "Brain", "age": "9"}}, "S2": {"label": "y", "metadata": "liver"}, "S3": {"label": "z"}}}))
    info = src.read_catalog(spark, str(tmp_path / "c.json"))
    assert {r.accession: r.metadata for r in info.collect()} == {"S1": {"tissue": "Brain", "age": "9"}, "S2": {"metadata": "liver"}}
    assert [r.accession for r in catalog.search(info, ["brain", "nothing"]).collect()] == ["S1"]
    assert info.where("accession = 'S1'").select(catalog.metadata_text()).first()[0] == "age: 9 | tissue: Brain"
    (tmp_path / "t.tsv").write_text("assembly\tname\nhg38\ta\nmm10\tb\n")
    assert [r.name for r in src.read_sample_table(spark, str(tmp_path / "t.tsv"), "hg38").collect()] == ["a"]
    with pytest.raises(ValueError):
        src.read_sample_table(spark, str(tmp_path / "t.tsv"), "hg19")


def test_groups(spark, tmp_path):
    members = spark.createDataFrame([("x_y", "S3"), ("x_y", "S1"), ("x_y", "S2")], "group string, accession string")
    groups = catalog.make_groups(members)
    assert {r.accession: r.label for r in groups.collect()} == {"S1": "x_y_00001", "S2": "x_y_00002", "S3": "x_y_00003"}
    left = catalog.remove_members(groups, spark.createDataFrame([("x_y", "S1")], "group string, accession string"))
    assert {r.accession: r.label for r in left.collect()} == {"S2": "x_y_00001", "S3": "x_y_00002"}
    assert {r.label for r in catalog.rename_group(left, "x_y", "q").collect()} == {"q_00001", "q_00002"}
    assert catalog.delete_group(groups, "x_y").count() == 0
    (tmp_path / "g.json").write_text(output.groups_json(groups).first().json)
    assert {(r.group, r.accession) for r in src.read_groups(spark, str(tmp_path / "g.json")).collect()} == {("x_y", a) for a in ("S1", "S2", "S3")}
    info = spark.createDataFrame([("g", "S1")], "genome string, accession string")
    assert {r.accession for r in catalog.unknown_members(groups, info, "g").collect()} == {"S2", "S3"}
    one, two = info.select("accession"), spark.createDataFrame([("S1",), ("S9",)], "accession string")
    assert {r.accession for r in catalog.toggle(one, two).collect()} == {"S9"}
    assert catalog.add(one, two).count() == 2 and catalog.remove(two, one).count() == 1


def test_requests(spark):
    rows = [(0, "bins", 200, None, 1, ["a"]), (1, "what", 200, None, 1, ["a"]), (2, "bins", 5, None, 1, ["a"]), (3, "bins", 200, None, 1, []), (4, "bins", 200, None, 1, ["a-b"]), (5, "bins", 200, None, 1, ["zz"]), (6, "bins", 200, None, 9, ["a"]), (7, "windows", 200, 10, 1, ["a"]), (8, "intervals", 7, None, 1, ["a", "a"]), (9, "bins", 200, None, 1, ["lost"])]
    asked = spark.createDataFrame(rows, "request_id int, kind string, aux long, step long, index_hash long, samples array<string>")
    genomes = spark.createDataFrame([("g", 1)], "genome string, index_hash long")
    meta = spark.createDataFrame([("a", "g", 1), ("lost", "h", 1)], "sample string, genome string, index_hash long")
    got = {r.request_id: r.status for r in requests.statuses(asked, genomes, meta).collect()}
    assert got == {0: "ok", 1: "invalid_kind", 2: "invalid_size", 3: "invalid_sample_count", 4: "invalid_name", 5: "methylome_not_found", 6: "invalid_index_hash", 7: "invalid_size", 8: "ok", 9: "index_not_found"}
    chroms = spark.createDataFrame([("g", 401), ("g", 10)], "genome string, chrom_size long")
    shapes = {r.request_id: (r.n_rows, r.n_cols) for r in requests.shapes(asked.where("request_id in (0, 8)"), genomes, chroms).collect()}
    assert shapes == {0: (4, 1), 8: (7, 2)}
    with pytest.raises(IndexError):
        requests.at(spark.createDataFrame([(1, 0)], "interval_id long, col_ord int"), 2, 0)


def test_text_numbers(spark):
    values = [144 / 167, 2 / 87, 0.0, 0.94, 1.0, 13 / 128, 1e-5, 0.5, 1 / 3, 0.0001]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(fn.fmt_g6(F.col("x"))).collect()]
    assert got == ["0.862275", "0.0229885", "0", "0.94", "1", "0.101562", "1e-05", "0.5", "0.333333", "0.0001"]


def test_names_of_files(spark):
    row = spark.createDataFrame([("/a/b/hg38.fa.gz", "/a/SRX1.m16.json")], "g string, m string").select(fn.genome_from_path(F.col("g")), fn.name_from_path(F.col("m")), fn.valid_name(F.lit("a_1")), fn.valid_name(F.lit("a-1")), fn.valid_name(F.lit(""))).first()
    assert tuple(row) == ("hg38", "SRX1", True, False, False)


def test_output(spark, tmp_path):
    lv = spark.createDataFrame([(0, "chr1", 0, 5, "a", 1, 3, 2, 7), (0, "chr1", 0, 5, "b", 0, 0, 0, 7)], "interval_id long, chrom string, start long, stop long, sample string, n_meth long, n_unmeth long, n_covered long, n_cpgs long")
    ranges = ["chrom", "start", "stop"]
    text = lambda **k: output.to_lines(lv, ranges, ["b", "a"], **k).first().line
    assert text() == "chr1\t0\t5\t0\t0\t1\t3"
    assert text(covered=True, cpgs=True) == "chr1\t0\t5\t0\t0\t0\t1\t3\t2\t7"
    assert text(kind="classic", prefix="named") == "chr1.0.5\t0\t0\t0.25\t4"
    assert text(kind="scores", min_reads=1, prefix="bare") == "NA\t0.25"
    assert output.header(["b", "a"], "classic", covered=True, cpgs=True) == "b_M\tb_R\tb_C\ta_M\ta_R\ta_C\tN_CPG"
    wide = output.to_wide(lv, ranges, ["b", "a"], kind="scores", cpgs=True, min_reads=1)
    assert wide.columns == ["interval_id", "chrom", "start", "stop", "name", "b", "a", "N_CPG"] and wide.first().b is None
    # Equal ranges stay apart, and a sample asked for twice is there twice.
    twice = lv.unionByName(lv.withColumn("interval_id", F.lit(1).cast("long")))
    assert [r.line for r in output.to_lines(twice, ranges, ["b", "a", "b"]).collect()] == ["chr1\t0\t5\t0\t0\t1\t3\t0\t0"] * 2
    again = output.to_wide(twice, ranges, ["a", "b", "a"], names=["x", "y", "z"])
    assert sorted((r.interval_id, r.x_M, r.y_M, r.z_U) for r in again.collect()) == [(0, 1, 0, 3), (1, 1, 0, 3)]
    output.write_lines(output.to_lines(lv, ranges, ["a"]), ["chrom", "start"], str(tmp_path / "out"), "h")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["h", "chr1\t0\t5\t1\t3"]


def test_matrix(spark):
    got = src.parse_matrix(as_lines(spark, ["1 2 3 4", "5 6 7 8"])).orderBy("interval_id", "col_ord").collect()
    assert [(r.n_meth, r.n_unmeth) for r in got] == [(1, 2), (3, 4), (5, 6), (7, 8)]
    for bad in (["1 2 3"], ["1 2", "1 2 3 4"]):
        with pytest.raises(ValueError):
            src.parse_matrix(as_lines(spark, bad))


def test_tables_round_trip(spark, tmp_path):
    sites = spark.createDataFrame([("g", "c", 0, 5, 0)], "genome string, chrom string, chrom_ord int, pos long, site_idx long")
    chroms = spark.createDataFrame([("g", "c", 0, 9, 0, 1)], "genome string, chrom string, chrom_ord int, chrom_size long, chrom_offset long, n_sites long")
    output.write_index(sites, chroms, str(tmp_path))
    meth = spark.createDataFrame([("g", "s", 0, 1, 2)], "genome string, sample string, site_idx long, n_meth int, n_unmeth int")
    output.write_methylomes(meth, spark.createDataFrame([("s",)], "sample string"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/sites").count() == 1
    back = spark.read.parquet(f"{tmp_path}/methylomes")
    assert back.first().n_unmeth == 2
    have = spark.createDataFrame([("s",), ("t",)], "sample string")
    assert [r["sample"] for r in catalog.missing(have, back, ["sample"]).collect()] == ["t"]
    assert catalog.listing(back, have, ["sample"]).count() == 1


def test_incremental_ingest(spark, tmp_path):
    sites = spark.createDataFrame([("g", "chr1", 5, 0), ("g", "chr1", 9, 1)], "genome string, chrom string, pos long, site_idx long")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "S1.sym").write_text("chr1 5 + CG 0.5 4\nchr1 6 + CG 0.5 4\n")
    q = ingest.watch_counts(spark, str(tmp_path / "in"), sites, "g", str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    (tmp_path / "in" / "S2.sym").write_text("chr1 9 + CG 1.0 4\n")
    q.processAllAvailable()
    q.stop()
    assert {(r["sample"], r.site_idx, r.n_meth) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("S1", 0, 2), ("S2", 1, 4)}
    assert spark.read.parquet(str(tmp_path / "out_rejects")).count() == 1


def test_answers_without_requests_of_a_kind(spark):
    asked = spark.createDataFrame([(1, "bins", 100, 1, "g", ["a", "a"])], "request_id long, kind string, aux long, step long, genome string, samples array<string>")
    chroms = spark.createDataFrame([("g", "chr1", 0, 250, 0, 2)], "genome string, chrom string, chrom_ord int, chrom_size long, chrom_offset long, n_sites long")
    sites = spark.createDataFrame([("g", "chr1", 0, 5, 0), ("g", "chr1", 0, 210, 1)], "genome string, chrom string, chrom_ord int, pos long, site_idx long")
    meth = spark.createDataFrame([("g", "a", 0, 3, 4)], "genome string, sample string, site_idx long, n_meth int, n_unmeth int")
    got = requests.answer_bins(asked, chroms, sites, meth).collect()
    assert sorted((r.col_ord, r.start, r.stop, r.n_meth, r.n_unmeth) for r in got) == [(c, a, min(a + 100, 250), 3 * (a == 0), 4 * (a == 0)) for c in (0, 1) for a in (0, 100, 200)]
    none = spark.createDataFrame([], "request_id long, interval_id long, chrom string, start long, stop long")
    assert requests.answer_windows(asked, chroms, sites, meth).count() == 0
    assert requests.answer_intervals(asked, none, chroms, sites, meth).count() == 0


def test_six_digits_of_fractions(spark):
    """As C prints a 32-bit float; nearly all fractions are printed without their decimal expansion."""
    pairs = spark.range(400).crossJoin(spark.range(400).withColumnRenamed("id", "b")).where("b >= id and b > 0").select((F.col("id") / F.col("b")).alias("x"))
    got = pairs.unionByName(spark.createDataFrame([(x,) for x in (1e-4, 0.00012345678, 0.0009999999, 0.00999999999, 0.0999999999, 0.99999999, 0.999999, 0.1, 0.01, 0.001, 0.5, 1.0, 0.25000050, 0.1234565, 0.015625, 0.00390625)], "x double"))
    rows = got.select("x", fn.fmt_g6(F.col("x")).alias("s"), fn.g6_fraction(F.col("x").cast("float").cast("double")).alias("fast")).collect()
    assert all(r.s == "%.6g" % float(np.float32(r.x)) for r in rows)
    assert sum(r.fast is None for r in rows) < 0.02 * len(rows)

"""Checksums and consistency of genomes and methylomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methgrid.operators.scan import small

#: Fixed value: the modulus of Adler-32.
MOD = 65521


#: Sites of a block of checksums.
BLOCK = 1 << 16


def _sums(parts: list[tuple[Column, Column]]) -> list[Column]:
    """(a, w) of (byte, place) of all bytes: the sum of bytes, and that of bytes times places.

    Adler-32 with start 0 is made of both, and both add up over blocks. Products are reduced row by row, so sums
    stay far below 2^63.
    """
    a = sum((F.sum(b) for b, _ in parts), F.lit(0)) % MOD
    w = sum((F.sum(b * (i % MOD)) for b, i in parts), F.lit(0)) % MOD
    return [a.cast("long").alias("a"), w.cast("long").alias("w")]


def _adler(length: Column) -> Column:
    """Adler-32 with start 0 of ``length`` bytes whose blocks have sums a and w."""
    a = F.sum("a") % MOD
    return (F.pmod((length % MOD) * a - F.sum("w"), F.lit(MOD)) * 65536 + a).cast("long")


def _bytes(value: Column, width: int, at: Column) -> list[tuple[Column, Column]]:
    return [(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(255), at + k) for k in range(width)]


def methylome_sums(methylomes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(genome, sample, block, a, w) over the 16-bit pairs of each block of sites, to be stored; blocks without reads have none."""
    at = F.col("site_idx") * 4
    parts = _bytes(F.col("n_meth"), 2, at) + _bytes(F.col("n_unmeth"), 2, at + 2)
    return methylomes.groupBy("genome", "sample", F.expr(f"site_idx div {block}").alias("block")).agg(*_sums(parts))


def site_sums(sites: DataFrame, chroms: DataFrame, block: int = BLOCK) -> DataFrame:
    """(genome, chrom, block, a, w) over the 32-bit positions of each block of a chromosome's sites, to be stored."""
    rows = sites.join(small(chroms.select("genome", "chrom", "chrom_offset")), ["genome", "chrom"]).withColumn("nth", F.col("site_idx") - F.col("chrom_offset"))
    return rows.groupBy("genome", "chrom", F.expr(f"nth div {block}").alias("block")).agg(*_sums(_bytes(F.col("pos"), 4, F.col("nth") * 4)))


def updated_sums(sums: DataFrame, methylomes: DataFrame, touched: DataFrame, block: int = BLOCK) -> DataFrame:
    """Stored ``sums`` with those of the blocks ``touched`` (genome, sample, block) made again from ``methylomes``, of which only these are summed."""
    keys = ["genome", "sample", "block"]
    again = small(touched.select(*keys).distinct())
    fresh = methylomes.withColumn("block", F.expr(f"site_idx div {block}")).join(again, keys, "left_semi")
    return sums.join(again, keys, "left_anti").unionByName(methylome_sums(fresh.drop("block"), block))


def changed_blocks(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block) whose sums differ between two tables of sums, or that only one of them has."""
    both = before.withColumnsRenamed({"a": "a0", "w": "w0"}).join(now, [*keys, "block"], "full")
    return both.where(~(F.col("a0").eqNullSafe(F.col("a")) & F.col("w0").eqNullSafe(F.col("w")))).select(*keys, "block")


def hash_of_sums(sums: DataFrame, n_sites: DataFrame) -> DataFrame:
    """(genome, sample, methylome_hash) of stored sums. n_sites: (genome, n_sites), one row for a genome."""
    return sums.join(small(n_sites), "genome").groupBy("genome", "sample", "n_sites").agg(_adler(F.col("n_sites") * 4).alias("methylome_hash")).drop("n_sites")


def methylome_hash(methylomes: DataFrame, n_sites: DataFrame) -> DataFrame:
    """(genome, sample, methylome_hash) over the 16-bit pairs of all sites; sites without reads add nothing.

    n_sites: (genome, n_sites), one row for a genome.
    """
    return hash_of_sums(methylome_sums(methylomes), n_sites)


def chrom_hash(sites: DataFrame, chroms: DataFrame) -> DataFrame:
    """(genome, chrom, chrom_ord, n_sites, chrom_hash) over the 32-bit positions of each chromosome."""
    return chrom_hash_of_sums(site_sums(sites, chroms), chroms)


def chrom_hash_of_sums(sums: DataFrame, chroms: DataFrame) -> DataFrame:
    """(genome, chrom, chrom_ord, n_sites, chrom_hash) of stored sums; chromosomes without sites have 0."""
    names = ["genome", "chrom", "chrom_ord", "n_sites"]
    met = chroms.select(*names).join(sums, ["genome", "chrom"], "left").fillna(0, ["a", "w"])
    return met.groupBy(*names).agg(_adler(F.col("n_sites") * 4).alias("chrom_hash"))


def index_hash(sites: DataFrame, chroms: DataFrame) -> DataFrame:
    """(genome, index_hash): the chromosomes' checksums combined in order, from 1."""
    return index_hash_of_sums(site_sums(sites, chroms), chroms)


def index_hash_of_sums(sums: DataFrame, chroms: DataFrame) -> DataFrame:
    """(genome, index_hash) of stored sums. A genome's list of chromosomes is short, so it is folded in one row."""
    per = chrom_hash_of_sums(sums, chroms).groupBy("genome").agg(F.sort_array(F.collect_list(F.struct("chrom_ord", (F.col("n_sites") * 4).alias("len"), "chrom_hash"))).alias("parts"))

    def combine(acc, x):
        rem = x["len"] % MOD
        a, b = x["chrom_hash"] % 65536, F.shiftright(x["chrom_hash"], 16)
        return F.struct(((acc["a"] + a + (MOD - 1)) % MOD).alias("a"), ((rem * acc["a"] + acc["b"] + b + (MOD - rem)) % MOD).alias("b"))

    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    return per.select("genome", F.aggregate("parts", start, combine, lambda acc: acc["b"] * 65536 + acc["a"]).alias("index_hash"))


def metadata_valid(columns: list[str]) -> Column:
    """Whether all of the fields are there and not empty."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return ok


#: Fields in which methylomes of one index agree.
SHARED = ["version", "index_hash", "genome", "n_cpgs"]


def consistent_pairs(meta: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, consistent) of pairs of samples: equal version, index hash, genome and number of sites."""
    a = meta.select(F.col("sample").alias("a"), *[F.col(c).alias(f"a_{c}") for c in SHARED])
    b = meta.select(F.col("sample").alias("b"), *[F.col(c).alias(f"b_{c}") for c in SHARED])
    same = F.lit(True)
    for c in SHARED:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", same.alias("consistent"))


def check_all(sites: DataFrame, chroms: DataFrame, genomes: DataFrame, methylomes: DataFrame, meta: DataFrame) -> DataFrame:
    """One row for a genome or methylome: (kind, name, genome, hash_ok, index_found, index_ok, n_meth, n_unmeth, n_covered, ok).

    genomes: (genome, version, index_hash, n_cpgs); meta: (sample, genome, version, methylome_hash, index_hash, n_cpgs).
    """
    own = genomes.join(index_hash(sites, chroms).withColumnRenamed("index_hash", "found"), "genome", "left")
    hash_ok = F.coalesce(F.col("found") == F.col("index_hash"), F.lit(False))
    none = F.lit(None).cast("long")
    by_genome = own.select(F.lit("genome").alias("kind"), F.col("genome").alias("name"), "genome", hash_ok.alias("hash_ok"), F.lit(True).alias("index_found"), F.lit(True).alias("index_ok"), none.alias("n_meth"), none.alias("n_unmeth"), none.alias("n_covered"), hash_ok.alias("ok"))
    totals = methylomes.groupBy("genome", "sample").agg(F.sum(F.col("n_meth").cast("long")).alias("n_meth"), F.sum(F.col("n_unmeth").cast("long")).alias("n_unmeth"), F.sum((F.col("n_meth") + F.col("n_unmeth") > 0).cast("long")).alias("n_covered"))
    sizes = chroms.groupBy("genome").agg(F.sum("n_sites").alias("n_sites"))
    hashes = methylome_hash(methylomes, sizes).withColumnRenamed("methylome_hash", "found")
    index = genomes.select("genome", F.lit(True).alias("has"), F.col("version").alias("i_version"), F.col("index_hash").alias("i_hash"), F.col("n_cpgs").alias("i_cpgs"))
    rows = meta.join(hashes, ["genome", "sample"], "left").join(totals, ["genome", "sample"], "left").join(index, "genome", "left")
    found = F.coalesce("has", F.lit(False))
    agrees = found & F.col("version").eqNullSafe(F.col("i_version")) & F.col("index_hash").eqNullSafe(F.col("i_hash")) & F.col("n_cpgs").eqNullSafe(F.col("i_cpgs"))
    same = F.coalesce(F.coalesce("found", F.lit(0)) == F.col("methylome_hash"), F.lit(False))
    by_sample = rows.select(F.lit("methylome").alias("kind"), F.col("sample").alias("name"), "genome", same.alias("hash_ok"), found.alias("index_found"), agrees.alias("index_ok"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_meth", "n_unmeth", "n_covered")], (same & agrees).alias("ok"))
    return by_genome.unionByName(by_sample)


def verdict(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))

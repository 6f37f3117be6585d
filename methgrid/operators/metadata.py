"""Metadata rows of genomes and methylomes, made from their data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methgrid.operators import check
from methgrid.operators.scan import small

VERSION = "1"


def genome_metadata(sites: DataFrame, chroms: DataFrame, version: str = VERSION) -> DataFrame:
    """(genome, version, index_hash, n_cpgs) of each genome."""
    sizes = chroms.groupBy("genome").agg(F.sum("n_sites").alias("n_cpgs"))
    return check.index_hash(sites, chroms).join(sizes, "genome").select("genome", F.lit(version).alias("version"), "index_hash", "n_cpgs")


def methylome_metadata(methylomes: DataFrame, genomes: DataFrame, version: str = VERSION) -> DataFrame:
    """(sample, genome, version, methylome_hash, index_hash, n_cpgs) of each sample, for new and for changed data alike.

    Rows beyond the genome's sites are refused: a methylome is as long as its index.
    """
    sizes = small(genomes.select("genome", F.col("n_cpgs").alias("n_sites")))
    odd = methylomes.join(sizes, "genome").where((F.col("site_idx") < 0) | (F.col("site_idx") >= F.col("n_sites"))).limit(1).collect()
    if odd:
        raise ValueError(f"a site that the index doesn't have: {odd[0]}")
    hashed = check.methylome_hash(methylomes, genomes.select("genome", F.col("n_cpgs").alias("n_sites")))
    return _rows(hashed, genomes, version)


def updated_metadata(sums: DataFrame, genomes: DataFrame, version: str = VERSION) -> DataFrame:
    """``methylome_metadata`` of stored block sums, such as ``check.updated_sums`` makes of those of changed blocks: data isn't read again."""
    return _rows(check.hash_of_sums(sums, genomes.select("genome", F.col("n_cpgs").alias("n_sites"))), genomes, version)


def _rows(hashed: DataFrame, genomes: DataFrame, version: str) -> DataFrame:
    return hashed.join(genomes.drop("version"), "genome").select("sample", "genome", F.lit(version).alias("version"), "methylome_hash", "index_hash", "n_cpgs")

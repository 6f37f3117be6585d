"""The catalogue of genomes, methylomes and their metadata: listing, search, selections, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methgrid.operators.scan import numbered


def listing(data: DataFrame, meta: DataFrame, key: list[str]) -> DataFrame:
    """Names that have both data and metadata."""
    return meta.select(*key).distinct().join(data.select(*key).distinct(), key, "left_semi")


def missing(requested: DataFrame, catalog: DataFrame, key: list[str]) -> DataFrame:
    """Requested names that the catalogue doesn't have."""
    return requested.select(*key).distinct().join(catalog, key, "left_anti")


def genome_of(meta: DataFrame, requested: DataFrame) -> DataFrame:
    """(sample, genome, index_hash) of the requested samples, from metadata alone."""
    return requested.select("sample").distinct().join(meta.select("sample", "genome", "index_hash"), "sample")


def genomes(info: DataFrame) -> DataFrame:
    return info.select("genome").distinct()


def metadata_text(metadata: str = "metadata") -> Column:
    """``k: v | k: v`` of a map, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat_ws(": ", e["key"], e["value"])), " | ")


def matches(pattern: str) -> Column:
    """Whether a case-insensitive pattern is found in the label or in a metadata value."""
    p = f"(?i){pattern}"
    return F.coalesce(F.col("label").rlike(p), F.lit(False)) | F.coalesce(F.exists(F.map_values("metadata"), lambda v: v.rlike(p)), F.lit(False))


def search(info: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows that match all patterns; a pattern that nothing left matches is passed over.

    Every row gets one bit for each pattern in one pass. Which patterns hold is folded from the distinct sets of
    bits, at most 2^patterns of them, in the same query: a pattern joins those before it if some set has them all.
    """
    if not patterns:
        return info
    if len(patterns) > 62:
        raise ValueError("more than 62 patterns")
    bits = F.lit(0).cast("long")
    for i, pattern in enumerate(patterns):
        bits = bits + F.when(matches(pattern), 1 << i).otherwise(0).cast("long")
    rows = info.withColumn("_bits", bits)
    sets = F.collect_set("_bits")
    each = F.array(*[F.lit(1 << i).cast("long") for i in range(len(patterns))])

    def joined(held, bit):
        both = held.bitwiseOR(bit)
        return F.when(F.exists("_sets", lambda s: s.bitwiseAND(both) == both), both).otherwise(held)

    held = rows.agg(sets.alias("_sets")).select(F.aggregate(each, F.lit(0).cast("long"), joined).alias("_held"))
    return rows.where(F.col("_bits").bitwiseAND(held.scalar()) == held.scalar()).drop("_bits")


def add(selection: DataFrame, more: DataFrame) -> DataFrame:
    return selection.unionByName(more).distinct()


def remove(selection: DataFrame, less: DataFrame) -> DataFrame:
    return selection.distinct().join(less, selection.columns, "left_anti")


def toggle(selection: DataFrame, those: DataFrame) -> DataFrame:
    """Selected ones of ``those`` go, the others come."""
    key = selection.columns
    both = selection.distinct().withColumn("_in", F.lit(1)).unionByName(those.distinct().withColumn("_in", F.lit(2)))
    return both.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(*key)


def make_groups(members: DataFrame) -> DataFrame:
    """(group, label, accession): labels group_00001, ... by accession in each group; later ones than group_99999 have more digits."""
    return _labelled(members.select("group", "accession").distinct(), "accession")


def _labelled(rows: DataFrame, order: str) -> DataFrame:
    place = F.col("_place").cast("string")
    padded = F.lpad(place, F.greatest(F.lit(5), F.length(place)), F.lit("0"))
    return numbered(rows, ["group"], [order], "_place").select("group", F.concat_ws("_", "group", padded).alias("label"), "accession")


def group_name(patterns: list[str]) -> str:
    return "_".join(patterns)


def group_of(label: Column) -> Column:
    """The label up to its last underscore."""
    return F.regexp_extract(label, "^(.*)_", 1)


def remove_members(groups: DataFrame, gone: DataFrame) -> DataFrame:
    """Groups without the (group, accession) of ``gone``, numbered again in the old order."""
    left = groups.join(gone, ["group", "accession"], "left_anti").withColumn("_old", F.regexp_extract("label", "([0-9]+)$", 1).cast("long"))
    return _labelled(left, "_old")


def rename_group(groups: DataFrame, old: str, new: str) -> DataFrame:
    own = F.col("group") == old
    return groups.select(
        F.when(own, F.lit(new)).otherwise(F.col("group")).alias("group"),
        F.when(own, F.concat_ws("_", F.lit(new), F.regexp_extract("label", "([0-9]+)$", 1))).otherwise(F.col("label")).alias("label"),
        "accession",
    )


def delete_group(groups: DataFrame, name: str) -> DataFrame:
    return groups.where(F.col("group") != name)


def unknown_members(groups: DataFrame, info: DataFrame, genome: str) -> DataFrame:
    """Members that the genome doesn't have; groups are valid if there are none."""
    return groups.join(info.where(F.col("genome") == genome).select("accession"), "accession", "left_anti")

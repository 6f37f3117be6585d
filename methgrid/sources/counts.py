"""Read counts of samples from text, and their alignment with the sites of a genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methgrid.functions.columns import decoded_meth, fit_u16
from methgrid.operators.scan import running, small
from methgrid.sources.lines import last_seen

SPLIT = "[ \t]+"


def parse_counts(lines: DataFrame) -> DataFrame:
    """(file, chrom, pos, n_meth, n_unmeth, error) of lines ``chrom pos strand context level n_reads``.

    Comments start with #. ``error`` names what is wrong with a line, null if nothing is.
    """
    parts = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split("value", SPLIT))
    pos, level, reads = F.get("f", 1).try_cast("long"), F.get("f", 4).try_cast("double"), F.get("f", 5).try_cast("long")
    error = (
        F.when(F.size("f") < 6, "too few fields")
        .when(pos.isNull() | (pos < 0), "bad position")
        .when(level.isNull() | ~level.between(0.0, 1.0), "bad level")
        .when(reads.isNull() | (reads < 0), "bad reads")
    )
    meth = decoded_meth(level, reads)
    m, u = F.col("m"), F.col("u")
    return (
        parts.withColumns({"error": error, "chrom": F.get("f", 0), "pos": pos, "m": meth.cast("long"), "u": reads - meth})
        .select("file", "chrom", "pos", F.when(F.col("error").isNull(), fit_u16(m, u)).alias("n_meth"), F.when(F.col("error").isNull(), fit_u16(u, m)).alias("n_unmeth"), "error")
    )


def parse_xcounts(lines: DataFrame) -> DataFrame:
    """(file, chrom, pos, n_meth, n_unmeth, error) of delta-coded lines ``step n_meth n_unmeth`` under chromosome lines.

    Positions are sums of the steps since the chromosome's line, taken in two levels over blocks of the file.
    """
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split("value", SPLIT))
    title = F.size("f") == 1
    step, m, u = (F.get("f", i).try_cast("long") for i in range(3))
    bad = ~title & (step.isNull() | m.isNull() | u.isNull())
    rows = body.withColumns({"title": title, "m": m, "u": u, "error": F.when(bad, "bad record")})
    summed = running(rows, ["file"], "block", ["id"], {"at": F.when(title | bad, 0).otherwise(step)})
    named = last_seen(summed, F.when(F.col("title"), F.struct(F.get("f", 0).alias("chrom"), F.col("at").alias("zero"))), "seen")
    m, u = F.col("m"), F.col("u")
    return named.where(~F.col("title")).select(
        "file",
        "seen.chrom",
        (F.col("at") - F.col("seen.zero")).alias("pos"),
        F.when(F.col("error").isNull(), fit_u16(m, u)).alias("n_meth"),
        F.when(F.col("error").isNull(), fit_u16(u, m)).alias("n_unmeth"),
        F.when(F.col("seen").isNull(), "no chromosome").otherwise(F.col("error")).alias("error"),
    )


def header_errors(lines: DataFrame, chroms: DataFrame) -> DataFrame:
    """(file, chrom, chrom_size, error) of header lines ``#chrom size`` that the index doesn't know or has otherwise."""
    heads = lines.select("file", F.regexp_extract("value", r"^#(\S+)\s+([0-9]+)\s*$", 1).alias("chrom"), F.regexp_extract("value", r"^#(\S+)\s+([0-9]+)\s*$", 2).alias("size")).where("chrom != ''")
    met = heads.select("file", "chrom", F.col("size").cast("long").alias("chrom_size")).join(small(chroms.select("chrom", F.col("chrom_size").alias("known"))), "chrom", "left")
    return met.select("file", "chrom", "chrom_size", F.when(F.col("known").isNull(), "unknown chromosome").when(F.col("known") != F.col("chrom_size"), "other size").alias("error")).where("error is not null")


def detect(lines: DataFrame) -> DataFrame:
    """(file, format): counts, xcounts or unknown, by the first lines that aren't comments."""
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    first = body.groupBy("file").agg(F.min_by("value", F.struct("block", "id")).alias("first"))
    counts = F.col("first").rlike(r"^\S+[ \t]+[0-9]+[ \t]+[+-][ \t]+\S+[ \t]+[0-9.eE+-]+[ \t]+[0-9]+([ \t].*)?$")
    return first.select("file", F.when(counts, "counts").when(F.col("first").rlike(r"^\S+$"), "xcounts").otherwise("unknown").alias("format"))


def align(rows: DataFrame, sites: DataFrame, mode: str = "failfast") -> tuple[DataFrame, DataFrame]:
    """(methylomes, rejects) of rows (genome, sample, chrom, pos, n_meth, n_unmeth, error).

    Rows meet sites of the same position. Rejects are malformed rows, positions that are no sites and
    all rows of a position that a sample has twice; with ``failfast`` any malformed row is refused.
    """
    if mode == "failfast":
        bad = rows.where("error is not null").limit(1).collect()
        if bad:
            raise ValueError(f"malformed record: {bad[0]}")
    sound = rows.where("error is null")
    times = sound.groupBy("genome", "sample", "chrom", "pos").agg(F.first("n_meth").alias("n_meth"), F.first("n_unmeth").alias("n_unmeth"), F.count(F.lit(1)).alias("times"))
    met = times.join(sites.select("genome", "chrom", "pos", "site_idx"), ["genome", "chrom", "pos"], "left")
    fine = (F.col("times") == 1) & F.col("site_idx").isNotNull()
    methylomes = met.where(fine & (F.col("n_meth") + F.col("n_unmeth") > 0)).select("genome", "sample", "site_idx", "n_meth", "n_unmeth")
    why = F.when(F.col("site_idx").isNull(), "not a site").otherwise(F.lit("repeated position"))
    rejects = met.where(~fine).select("genome", "sample", "chrom", "pos", why.alias("error")).unionByName(rows.where("error is not null").select("genome", "sample", "chrom", "pos", "error"))
    return methylomes, rejects

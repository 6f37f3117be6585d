"""Genomes from FASTA: sites of a two-letter motif, chromosome sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.functions.columns import genome_from_path
from methgrid.operators import genome as g
from methgrid.operators.scan import running
from methgrid.sources.lines import last_seen, previous, read_lines


def motif_positions(sequence: Column, motif: str = "CG") -> Column:
    """Array of the zero-based places of a motif of letters, in either case, overlapping ones too.

    The sequence is cut before each place; lengths of the pieces add up to the places.
    """
    pieces = F.split(sequence, f"(?i)(?={motif})", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, piece):
        at = acc["at"] + F.length(piece)
        return F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out"))

    inner = F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda acc: acc["out"])
    return F.when(F.substring(sequence, 1, len(motif)).rlike(f"(?i)^{motif}$"), F.array_insert(inner, 1, F.lit(0))).otherwise(inner)


def parse(lines: DataFrame, motif: str = "CG", name: str = "line") -> tuple[DataFrame, DataFrame]:
    """(positions, sizes): distinct (genome, chrom, pos) and (genome, chrom, chrom_size) of ordered lines.

    A header is a line that starts with ``>``; its name is the whole line or, with
    ``name="word"``, its first word. A motif may be cut by a line's end: each line is searched
    with the last letter of the line before in front.
    """
    header = F.col("value").startswith(">")
    kept = lines.where(F.col("value") != "").withColumn("len", F.when(header, 0).otherwise(F.length("value")))
    placed = running(kept, ["file"], "block", ["id"], {"end": F.col("len").cast("long")})
    title = F.expr("substring(value, 2)")
    title = F.regexp_extract(title, r"^\s*(\S+)", 1) if name == "word" else title
    named = last_seen(placed, F.when(header, F.struct(title.alias("chrom"), F.col("end").alias("zero"))), "at")
    joined = previous(named, F.when(header, F.lit(None).cast("string")).otherwise(F.expr("right(value, 1)")), "before")
    body = joined.where(~header & F.col("at").isNotNull()).select(genome_from_path(F.col("file")).alias("genome"), F.col("at.chrom").alias("chrom"), (F.col("end") - F.col("len") - F.col("at.zero")).alias("start"), "len", "value", F.coalesce("before", F.lit("")).alias("before"))
    found = body.select("genome", "chrom", (F.col("start") - F.length("before")).alias("start"), F.explode(motif_positions(F.concat("before", "value"), motif)).alias("i"))
    sizes = body.groupBy("genome", "chrom").agg(F.sum("len").alias("chrom_size"))
    return found.select("genome", "chrom", (F.col("start") + F.col("i")).alias("pos")), sizes


def read_genome(spark: SparkSession, paths: str | list[str], motif: str = "CG", name: str = "line") -> tuple[DataFrame, DataFrame]:
    """(sites, chroms) of FASTA files, plain or gzip; files without a FASTA suffix are refused."""
    lines = read_lines(spark, paths)
    odd = lines.select("file").distinct().where(genome_from_path(F.col("file")).isNull()).limit(1).collect()
    if odd:
        raise ValueError(f"not a FASTA name: {odd[0].file}")
    return g.build(*parse(lines, motif, name))

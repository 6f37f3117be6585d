"""BED intervals, binary imports, names, metadata and matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from methgrid.operators.scan import last_before, small
from methgrid.sources.scratch import stored


def parse_bed(lines: DataFrame, chroms: DataFrame) -> DataFrame:
    """(interval_id, chrom, start, stop, error) of the first three fields; all offending rows get their error.

    ``interval_id`` is the place of the line in file order, counted in blocks.
    """
    numbered = number(lines.where(F.trim("value") != ""))
    f = F.split("value", "[ \t]+")
    rows = numbered.select("interval_id", F.get(f, 0).alias("chrom"), F.get(f, 1).try_cast("long").alias("start"), F.get(f, 2).try_cast("long").alias("stop"))
    met = rows.join(small(chroms.select("chrom", "chrom_size")), "chrom", "left")
    error = (
        F.when(F.col("start").isNull() | F.col("stop").isNull() | (F.col("start") < 0), "bad interval")
        .when(F.col("chrom_size").isNull(), "unknown chromosome")
        .when(F.col("start") > F.col("stop"), "start beyond stop")
        .when(F.col("stop") > F.col("chrom_size"), "beyond the chromosome")
    )
    return met.select("interval_id", "chrom", "start", "stop", error.alias("error"))


def number(lines: DataFrame) -> DataFrame:
    """Lines with ``interval_id`` from 0 in file order: counted inside blocks, shifted by the blocks before.

    Lines are stored, as they are read for the counts and for the numbers, and are made once then.
    """
    lines = stored(lines, "lines")
    inside = Window.partitionBy("file", "block").orderBy("id")
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("file", "block").count().select("file", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    return lines.withColumn("nth", F.row_number().over(inside) - 1).join(small(counts), ["file", "block"]).withColumn("interval_id", F.col("nth") + F.col("shift")).drop("nth", "shift")


def from_frame(frame: DataFrame, genome: str) -> DataFrame:
    """Intervals of any frame whose first three columns are chrom, start and stop."""
    a, b, c = frame.columns[:3]
    return frame.select(F.monotonically_increasing_id().alias("interval_id"), F.lit(genome).alias("genome"), F.col(a).cast("string").alias("chrom"), F.col(b).cast("long").alias("start"), F.col(c).cast("long").alias("stop"))


#: Bytes of a binary file that one task reads, and tasks at most.
CHUNK, TASKS = 16 << 20, 20_000
#: Tasks that are wanted at least, if there are as many ranges.
SPREAD = 64
#: Bytes of ranges that are passed on together.
BATCH = 1 << 20
#: Site ranks of a block in which contigs are looked up.
CONTIG_BLOCK = 1 << 16


def _open(path: str):
    """A file for reading at any place, in a local or any other store that pyarrow knows."""
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def byte_ranges(spark: SparkSession, folder: str, names: str, width: int, chunk: int = CHUNK) -> DataFrame:
    """(path, length, at, content) of the files of ``folder`` whose names match a glob, in ranges of whole records of ``width`` bytes.

    Ranges are made of the listing, dealt out to tasks and read there, so one file is read by many tasks. In a
    store that pyarrow can't open a file is read whole by Spark.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder)
    first = files.select("path").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "path string, length long, at long, content binary")
    try:
        _open(first[0].path).close()
    except Exception:
        return files.select("path", "length", F.lit(0).cast("long").alias("at"), "content")
    step = max(1, chunk // width) * width
    # A task takes neighbouring ranges, CHUNK bytes together, so tasks grow with the bytes and not with the ranges.
    span = step * max(1, CHUNK // step)
    total = files.agg(F.sum("length")).first()[0]
    while span > step and (total or 0) < span * SPREAD:
        span = max(step, span // 2 // step * step)
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L), {span}L)")).alias("at"))
    dealt = ranges.repartition(max(1, min(ranges.count(), TASKS)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, length, at in frame.itertuples(index=False):
                end = min(at + span, length)
                with _open(path) as f:
                    f.seek(at)
                    while True:
                        places = list(range(at, min(end, at + max(step, BATCH // step * step)), step)) or [at]
                        contents = [f.read(min(step, end - p)) for p in places]
                        yield pd.DataFrame({"path": path, "length": length, "at": places, "content": contents})
                        at = places[-1] + step
                        if at >= end:
                            break

    return dealt.mapInPandas(run, "path string, length long, at long, content binary")


def placed_in_contigs(rows: DataFrame, chroms: DataFrame) -> DataFrame:
    """``rows`` (genome, site_idx, ...) with chrom and chrom_ord of the contig that holds the rank.

    Ranks meet the contigs' offsets in blocks, in order; each block is opened by the contig that reaches into
    it. So the cost is that of one exchange of both, whatever the number of contigs.
    """
    held = chroms.where("n_sites > 0").select("genome", F.expr(f"chrom_offset div {CONTIG_BLOCK}").alias("block"), F.col("chrom_offset").alias("site_idx"), F.struct("chrom", "chrom_ord").alias("contig"))
    axis = chroms.groupBy("genome").agg(F.sum("n_sites").alias("n")).where("n > 0").select("genome", F.explode(F.expr(f"sequence(0L, (n - 1) div {CONTIG_BLOCK})")).alias("block"))
    lasts = held.groupBy("genome", "block").agg(F.max_by("contig", "site_idx").alias("contig"))
    earlier = Window.partitionBy("genome").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    seeds = axis.join(lasts, ["genome", "block"], "left").select("genome", "block", (F.col("block") * CONTIG_BLOCK).alias("site_idx"), F.lit(-2).alias("rank"), F.last("contig", ignorenulls=True).over(earlier).alias("contig"))
    marks = seeds.unionByName(held.withColumn("rank", F.lit(-1)))
    events = rows.withColumn("block", F.expr(f"site_idx div {CONTIG_BLOCK}"))
    found = last_before(events, marks, ["genome"], "site_idx", ["contig"])
    return found.select(*rows.columns, "contig.chrom", "contig.chrom_ord")


def read_index(spark: SparkSession, folder: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(sites, chroms) of index pairs ``name.cpg_idx`` (32-bit positions, chromosomes in order) and ``name.cpg_idx.json``.

    A file is read in ranges of ``chunk`` bytes; one whose length disagrees with its metadata raises.
    """
    meta = spark.read.option("multiLine", True).schema("genome_name string, n_cpgs long, chrom_order array<string>, chrom_size array<long>, chrom_offset array<long>").json(f"{folder}/*.cpg_idx.json")
    per = meta.select("genome_name", "n_cpgs", F.posexplode("chrom_order").alias("chrom_ord", "chrom"), "chrom_size", "chrom_offset")
    size, offset = F.get("chrom_size", F.col("chrom_ord")), F.get("chrom_offset", F.col("chrom_ord"))
    end = F.coalesce(F.get("chrom_offset", F.col("chrom_ord") + 1), "n_cpgs")
    chroms = per.select(F.col("genome_name").alias("genome"), "chrom", "chrom_ord", size.alias("chrom_size"), offset.alias("chrom_offset"), (end - offset).alias("n_sites"))
    genome = F.regexp_extract("path", r"([^/]+)\.cpg_idx$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cpg_idx").load(folder).select(genome.alias("genome"), "length")
    odd = files.join(meta.select(F.col("genome_name").alias("genome"), "n_cpgs"), "genome", "full").where("not (length <=> n_cpgs * 4)").limit(1).collect()
    if odd:
        raise ValueError(f"index data and metadata disagree: {odd[0]}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, at, content in frame.itertuples(index=False):
                pos = np.frombuffer(content, "<u4")
                yield pd.DataFrame({"genome": name, "site_idx": at // 4 + np.arange(len(pos)), "pos": pos.astype(np.int64)})

    raw = byte_ranges(spark, folder, "*.cpg_idx", 4, chunk).select(genome.alias("genome"), "at", "content").mapInPandas(run, "genome string, site_idx long, pos long")
    return placed_in_contigs(raw, chroms).select("genome", "chrom", "chrom_ord", "pos", "site_idx"), chroms


def read_methylomes(spark: SparkSession, folder: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(methylomes, meta) of pairs ``name.m16`` (16-bit counts) and ``name.m16.json``; compressed ones are refused.

    A file is read in ranges of ``chunk`` bytes; one whose length disagrees with its metadata raises.
    """
    schema = "version string, methylome_hash long, index_hash long, genome_name string, n_cpgs long, is_compressed boolean"
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.m16\.json$", 1)
    meta = spark.read.option("multiLine", True).schema(schema).json(f"{folder}/*.m16.json").select(name.alias("sample"), F.col("genome_name").alias("genome"), "version", "methylome_hash", "index_hash", "n_cpgs", "is_compressed")
    odd = meta.where("is_compressed").limit(1).collect()
    if odd:
        raise ValueError(f"compressed methylome: {odd[0]['sample']}")
    sample = F.regexp_extract("path", r"([^/]+)\.m16$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.m16").load(folder).select(sample.alias("sample"), "length")
    odd = files.join(meta.select("sample", "n_cpgs"), "sample", "full").where("not (length <=> n_cpgs * 4)").limit(1).collect()
    if odd:
        raise ValueError(f"methylome data and metadata disagree: {odd[0]}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, at, content in frame.itertuples(index=False):
                pairs = np.frombuffer(content, "<u2").reshape(-1, 2).astype(np.int32)
                covered = np.flatnonzero(pairs.any(1))
                yield pd.DataFrame({"sample": name, "site_idx": at // 4 + covered, "n_meth": pairs[covered, 0], "n_unmeth": pairs[covered, 1]})

    raw = byte_ranges(spark, folder, "*.m16", 4, chunk).select(sample.alias("sample"), "at", "content").mapInPandas(run, "sample string, site_idx long, n_meth int, n_unmeth int")
    return raw.join(small(meta.select("sample", "genome")), "sample").select("genome", "sample", "site_idx", "n_meth", "n_unmeth"), meta


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(label, sample, col_ord): a JSON map of labels to names, by label, or a list of names, one a line."""
    text = spark.read.text(path, wholetext=True)
    found = F.from_json("value", "map<string,string>")
    pairs = text.select(F.when(F.col("value").startswith("{"), F.array_sort(F.map_entries(found))).otherwise(F.transform(F.filter(F.split("value", r"\s*\n\s*"), lambda x: x != ""), lambda x: F.struct(x.alias("key"), x.alias("value")))).alias("pairs"))
    return pairs.select(F.posexplode("pairs").alias("col_ord", "p")).select(F.col("p.key").alias("label"), F.col("p.value").alias("sample"), "col_ord")


def read_sample_table(spark: SparkSession, path: str, assembly: str) -> DataFrame:
    """Rows of a tab-separated table of samples for one assembly, without that column; none is an error."""
    rows = spark.read.csv(path, sep="\t", header=True).where(F.col("assembly") == assembly)
    if not rows.limit(1).count():
        raise ValueError(f"no samples of {assembly}")
    return rows.drop("assembly")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(genome, accession, label, metadata MAP) of a nested JSON file; entries without label or metadata are left out.

    Metadata may be an object or a plain string, which gets the key ``metadata``.
    """
    text = spark.read.text(path, wholetext=True)
    by_genome = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("genome", "entries"))
    rows = by_genome.select("genome", F.explode("entries").alias("accession", "entry"))
    label, raw = F.get_json_object("entry", "$.label"), F.get_json_object("entry", "$.metadata")
    metadata = F.when(raw.startswith("{"), F.from_json(raw, "map<string,string>")).otherwise(F.create_map(F.lit("metadata"), raw))
    return rows.select("genome", "accession", label.alias("label"), F.when(raw.isNotNull(), metadata).alias("metadata")).where("label is not null and metadata is not null")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group, label, accession) of a JSON map of labels to accessions."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("label", "accession"))
    return rows.select(F.regexp_extract("label", "^(.*)_", 1).alias("group"), "label", "accession")


def parse_matrix(lines: DataFrame) -> DataFrame:
    """(interval_id, col_ord, n_meth, n_unmeth) of rows of pairs; a row with an odd or another number of values raises."""
    rows = number(lines).select("interval_id", F.split(F.trim("value"), "[ \t]+").alias("v"))
    width = F.size("v")
    shape = rows.agg(F.min(width).alias("a"), F.max(width).alias("b"), F.max(width % 2).alias("odd")).first()
    if shape.odd or shape.a != shape.b:
        raise ValueError("ragged matrix")
    cells = rows.select("interval_id", F.posexplode("v").alias("i", "x"))
    even = F.col("i") % 2 == 0
    return cells.groupBy("interval_id", F.expr("i div 2").cast("int").alias("col_ord")).agg(F.max(F.when(even, F.col("x").cast("long"))).alias("n_meth"), F.max(F.when(~even, F.col("x").cast("long"))).alias("n_unmeth"))

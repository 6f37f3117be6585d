"""Results as wide tables and text, and tables as Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.functions.columns import element, fit_u16, n_reads, row_name, wmean, wmean_or
from methgrid.operators.scan import small

#: Suffixes of a sample's columns.
SUFFIX = {"counts": ["M", "U"], "classic": ["M", "R"], "scores": [""]}


def write_index(sites: DataFrame, chroms: DataFrame, path: str) -> None:
    """Site index: one folder for a genome, sorted by place, so that ranges prune row groups."""
    sites.repartitionByRange("genome", "chrom_ord", "pos").sortWithinPartitions("genome", "chrom_ord", "pos").write.mode("overwrite").partitionBy("genome").parquet(f"{path}/sites")
    chroms.write.mode("overwrite").partitionBy("genome").parquet(f"{path}/chroms")


def write_methylomes(methylomes: DataFrame, meta: DataFrame, path: str) -> None:
    """Methylomes: one folder for a genome and sample, so that queries read what they name."""
    methylomes.repartition("genome", "sample", F.expr("site_idx div 524288")).sortWithinPartitions("genome", "sample", "site_idx").write.mode("overwrite").option("compression", "zstd").partitionBy("genome", "sample").parquet(f"{path}/methylomes")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sites, chroms) that ``write_index`` wrote."""
    sites = spark.read.schema("chrom string, chrom_ord int, pos long, site_idx long, genome string").parquet(f"{path}/sites")
    return sites, spark.read.schema("chrom string, chrom_ord int, chrom_size long, chrom_offset long, n_sites long, genome string").parquet(f"{path}/chroms")


def read_methylomes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(methylomes, meta) that ``write_methylomes`` wrote; counts are as wide as they were written."""
    methylomes = spark.read.parquet(f"{path}/methylomes")
    return methylomes.select(F.col("genome").cast("string").alias("genome"), F.col("sample").cast("string").alias("sample"), "site_idx", "n_meth", "n_unmeth"), spark.read.parquet(f"{path}/meta")


#: Rows of a Parquet page of tables that are read block by block: pages carry the statistics that filters prune by.
PAGE_ROWS = 1024
#: Sites whose records are packed together for a binary file.
PACKED = 1 << 16


def _by_block(df: DataFrame, order: list[str], folders: list[str], path: str) -> None:
    df.sortWithinPartitions(*order).write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).option("compression", "zstd").partitionBy(*folders).parquet(path)


def write_marks(marks: DataFrame, path: str) -> None:
    """The marks of ``site_marks``: one folder for a genome, sorted by chromosome, block and place."""
    _by_block(marks.repartitionByRange("genome", "chrom", "block"), ["genome", "chrom", "block", "pos", "rank"], ["genome"], path)


def write_prefix(prefix: DataFrame, path: str) -> None:
    """The sums of ``prefix_sums``: one folder for a genome and sample, files of whole blocks, sorted by block and place."""
    _by_block(prefix.repartition("genome", "sample", F.expr("block div 4096")), ["genome", "sample", "block", "at", "rank"], ["genome", "sample"], path)


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_marks`` wrote."""
    return spark.read.schema("block long, pos long, rank int, before long, chrom string, genome string").parquet(path)


def read_prefix(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_prefix`` wrote."""
    return spark.read.schema("block long, at long, rank int, n_meth long, n_unmeth long, n_covered long, genome string, sample string").parquet(path)


def _keys(levels: DataFrame, ranges: list[str], cpgs: bool) -> list[str]:
    """The columns of a range: its id, if it has one, tells equal ranges apart."""
    return [*(["interval_id"] if "interval_id" in levels.columns else []), *ranges, *(["n_cpgs"] if cpgs else [])]


def _ordered(levels: DataFrame, samples: list[str]) -> DataFrame:
    """The requested samples' rows with ``_at``, their place in the request; a sample requested twice has two rows.

    Results that carry ``col_ord`` keep it, as it says which request's column a row is.
    """
    if "col_ord" in levels.columns:
        return levels.withColumn("_at", F.col("col_ord").cast("int"))
    asked = levels.sparkSession.createDataFrame([(s, i) for i, s in enumerate(samples)], "sample string, _at int")
    return levels.join(F.broadcast(asked), "sample")  # as long as the user's list


def _flat(levels: DataFrame, keys: list[str], samples: list[str], covered: bool) -> DataFrame:
    """One row for a range with the numbers of each requested sample, in columns <place>_m, <place>_u and <place>_c."""
    values = {"m": "n_meth", "u": "n_unmeth"} | ({"c": "n_covered"} if covered else {})
    if "cells" in levels.columns:
        return levels.select(*keys, *[F.col("cells")[s][n].alias(f"{i}_{v}") for i, s in enumerate(samples) for v, n in values.items()])
    # A range's rows differ in their place, so its cells are picked in one aggregation of numbers.
    return _ordered(levels, samples).groupBy(*keys).agg(*[F.max(F.when(F.col("_at") == i, F.col(n))).alias(f"{i}_{v}") for i in range(len(samples)) for v, n in values.items()])


def to_wide(levels: DataFrame, ranges: list[str], samples: list[str], kind: str = "counts", covered: bool = False, cpgs: bool = False, min_reads: int = 0, sep: str = ".", names: list[str] | None = None) -> DataFrame:
    """One row for a range with a row name and, for each requested sample in order, its columns.

    ranges: the columns of the range, first the chromosome; equal ranges are told apart by
    interval_id. kind: counts (sample_M, sample_U), classic (sample_M is the score, sample_R the
    reads) or scores (sample, null below min_reads), ``covered`` adds sample_C but to scores,
    ``cpgs`` the column N_CPG at the end. names replace the samples in column names. Samples are
    given, so no job is needed to find them. levels: long rows, or one row for a range with ``cells``
    (``levels.interval_cells``), which needs no exchange.
    """
    covered = covered and kind != "scores"
    keys = _keys(levels, ranges, cpgs)
    wide = _flat(levels, keys, samples, covered)
    out = [row_name(ranges, sep).alias("name")]
    for i, shown in enumerate(names or samples):
        m, u = f"`{i}_m`", f"`{i}_u`"
        if kind == "counts":
            out += [F.col(m).alias(f"{shown}_M"), F.col(u).alias(f"{shown}_U")]
        elif kind == "classic":
            out += [wmean(m, u).alias(f"{shown}_M"), n_reads(m, u).alias(f"{shown}_R")]
        else:
            out.append(wmean_or(min_reads, None, m, u).alias(shown))
        if covered:
            out.append(F.col(f"`{i}_c`").alias(f"{shown}_C"))
    return wide.select(*[c for c in keys if c != "n_cpgs"], *out, *([F.col("n_cpgs").alias("N_CPG")] if cpgs else []))


def header(samples: list[str], kind: str = "counts", covered: bool = False, cpgs: bool = False) -> str:
    """The header line of a table: sample columns with their suffixes, N_CPG last."""
    parts = SUFFIX[kind] + (["C"] if covered and kind != "scores" else [])
    return "\t".join([f"{s}_{p}" if p else s for s in samples for p in parts] + (["N_CPG"] if cpgs else []))


def to_lines(levels: DataFrame, ranges: list[str], samples: list[str], kind: str = "counts", covered: bool = False, cpgs: bool = False, min_reads: int = 0, prefix: str = "bed", sep: str = ".") -> DataFrame:
    """(range columns, line): text rows, BED-like (range fields first), named (row name first) or bare.

    Each sample's element is made in its long row; elements of a range are then joined in the order
    of the request. Equal ranges are told apart by interval_id. levels: as for ``to_wide``; the
    ``cells`` of a range are written where they are.
    """
    keys = _keys(levels, ranges, cpgs)
    if "cells" in levels.columns:
        own = F.array(*[F.col("cells")[s] for s in samples])
        joined = levels.select(*keys, F.transform(own, lambda x: element(kind, x["n_meth"], x["n_unmeth"], x["n_covered"] if covered else None, min_reads)).alias("elements"))
    else:
        text = element(kind, covered="n_covered" if covered else None, min_reads=min_reads)
        rows = _ordered(levels, samples).select(*keys, "_at", text.alias("text"))
        joined = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "text")))["text"].alias("elements"))
    start = {"bed": [F.col(c).cast("string") for c in ranges], "named": [row_name(ranges, sep)], "bare": []}[prefix]
    line = F.concat_ws("\t", *start, "elements", *([F.col("n_cpgs").cast("string")] if cpgs else []))
    return joined.select(*[c for c in keys if c != "n_cpgs"], line.alias("line"))


def write_lines(lines: DataFrame, order: list[str], path: str, head: str | None = None) -> None:
    """Lines as text files whose names, and the lines in them, are in the order of the ranges; the header, if any, is the first line of the first file."""
    rows = lines.select(*order, "line").withColumn("_body", F.lit(1))
    if head is not None:
        first = lines.sparkSession.createDataFrame([(head,)], "line string")
        rows = rows.unionByName(first.withColumn("_body", F.lit(0)), allowMissingColumns=True)
    rows.repartitionByRange("_body", *order).sortWithinPartitions("_body", *order).select("line").write.mode("overwrite").text(path)


def write_result(levels: DataFrame, path: str) -> None:
    """A long result (interval_id, col_ord, ...), sorted by both in small pages, so that single elements and ranges of intervals are read by themselves."""
    order = ["interval_id", "col_ord"]
    levels.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).option("compression", "zstd").parquet(path)


def _place(path: str) -> tuple:
    """(file system of pyarrow, path in it) of a path with or without a scheme."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


def _write_binary(rows: DataFrame, heads: DataFrame, name: str, folder: str, suffix: str, width: int, kind: str) -> None:
    """One file ``<name><suffix>`` of little-endian records and one of JSON for each row of ``heads`` (name, n_cpgs, head).

    rows: (name, site_idx, v0, ...), ``width`` values of a record. Records are packed to bytes in blocks of sites, by many
    tasks. One task writes a file from such blocks in order, under another name first, so a task that is run again replaces
    the file as a whole; it copies bytes and sees no rows. Sites that rows leave out are records of zeros.
    """
    values = [f"v{i}" for i in range(width)]
    record = width * np.dtype(kind).itemsize

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for (key, _), own in frame.groupby([name, "_block"], sort=False):
                places = own.site_idx.to_numpy()
                records = np.zeros((int(places[-1] - places[0]) + 1, width), kind)
                records[places - places[0]] = own[values].to_numpy()
                out.append((key, int(places[0]), records.tobytes()))
            yield pd.DataFrame(out, columns=[name, "at", "content"])

    blocks = rows.select(name, "site_idx", *values, F.expr(f"site_idx div {PACKED}").alias("_block"))
    packed = blocks.repartition(name, "_block").sortWithinPartitions(name, "_block", "site_idx").mapInPandas(pack, f"{name} string, at long, content binary")
    starts = heads.select(name, F.lit(-1).cast("long").alias("at"), "n_cpgs", "head")
    both = starts.unionByName(packed, allowMissingColumns=True)
    dealt = both.repartition(name).sortWithinPartitions(name, "at")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _place(folder)
        store.create_dir(root, recursive=True)
        at = {}

        def filled(to: int) -> None:
            while at["done"] < to:
                n = min(to - at["done"], PACKED)
                at["file"].write(bytes(n * record))
                at["done"] += n

        def closed() -> pd.DataFrame:
            filled(at["n"])
            at["file"].close()
            with store.open_output_stream(f"{root}/{at['name']}{suffix}.json") as f:
                f.write(at["head"].encode())
            store.move(at["part"], f"{root}/{at['name']}{suffix}")
            return pd.DataFrame({"name": [at["name"]], "n": [at["n"]]})

        for frame in frames:
            for key, place, n_cpgs, head, content in frame[[name, "at", "n_cpgs", "head", "content"]].itertuples(index=False):
                if place == -1:
                    if at:
                        yield closed()
                    part = f"{root}/_{uuid.uuid4().hex}"
                    at = {"name": key, "n": int(n_cpgs), "head": head, "done": 0, "part": part, "file": store.open_output_stream(part)}
                else:
                    filled(place)
                    at["file"].write(content)
                    at["done"] += len(content) // record
        if at:
            yield closed()

    dealt.mapInPandas(run, "name string, n long").write.format("noop").mode("overwrite").save()


def write_binary_index(sites: DataFrame, chroms: DataFrame, genomes: DataFrame, folder: str) -> None:
    """Index pairs that ``tables.read_index`` reads: 32-bit positions in order, and JSON. genomes: (genome, version, index_hash, n_cpgs)."""
    listed = F.array_sort(F.collect_list(F.struct("chrom_ord", "chrom", "chrom_size", "chrom_offset")))
    per = chroms.groupBy("genome").agg(listed.alias("c")).join(genomes, "genome")
    head = F.to_json(F.struct("version", "index_hash", F.col("genome").alias("genome_name"), "n_cpgs", F.col("c.chrom").alias("chrom_order"), F.col("c.chrom_size").alias("chrom_size"), F.col("c.chrom_offset").alias("chrom_offset")))
    _write_binary(sites.select("genome", "site_idx", F.col("pos").alias("v0")), per.select("genome", "n_cpgs", head.alias("head")), "genome", folder, ".cpg_idx", 1, "<u4")


def write_binary_methylomes(methylomes: DataFrame, meta: DataFrame, folder: str) -> None:
    """Methylome pairs that ``tables.read_methylomes`` reads: 16-bit counts of all sites, larger ones rescaled, and JSON.

    meta: (sample, genome, version, methylome_hash, index_hash, n_cpgs), of counts that fit.
    """
    m, u = F.col("n_meth"), F.col("n_unmeth")
    rows = methylomes.join(small(meta.select("genome", "sample")), ["genome", "sample"], "left_semi").select("sample", "site_idx", fit_u16(m, u).cast("long").alias("v0"), fit_u16(u, m).cast("long").alias("v1"))
    head = F.to_json(F.struct("version", "methylome_hash", "index_hash", F.col("genome").alias("genome_name"), "n_cpgs", F.lit(False).alias("is_compressed")))
    _write_binary(rows, meta.select("sample", "n_cpgs", head.alias("head")), "sample", folder, ".m16", 2, "<u2")


def groups_json(groups: DataFrame) -> DataFrame:
    """(group, json): a map of labels to accessions for each group."""
    return groups.groupBy("group").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "accession"))))).alias("json"))


def selection_lines(selection: DataFrame) -> DataFrame:
    return selection.select(F.col("accession").alias("line"))

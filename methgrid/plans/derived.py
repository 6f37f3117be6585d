"""Methylation tables derived by Spark from the driver's tables, and the same derivations in SQL.

sites: distinct (supplier mod 5, 7 x part) of lineitem; samples: return flag and line status;
counts: quantities of even and odd lines; intervals: from orders.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.operators import genome as g
from methgrid.operators.intervals import site_marks
from methgrid.operators.levels import prefix_sums
from methgrid.operators.pyramid import Pyramid, read_pyramid, write_pyramid
from methgrid.sources import output, scratch

GENOME = "g1"
#: Bin sizes of the stored levels.
UNITS = [10, 50, 500, 5000]
#: A request for all samples, by name.
SAMPLES = ["A_F", "A_O", "N_F", "N_O", "R_F", "R_O"]
#: Rows of the driver's tables for a partition of an exchange, at most.
ROWS = 250_000


class Tables:
    """The derived tables of a folder. Each is stored when it is first asked for, with those that it is made of."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.folder = spark, sf_dir, scratch.new_folder(spark, "derived")
        scratch.roomy(spark, sum(read(spark, sf_dir, name).count() for name in ("lineitem", "orders")), ROWS)

    @cached_property
    def _placed(self) -> DataFrame:
        return read(self.spark, self.sf_dir, "lineitem").select(
            F.lit(GENOME).alias("genome"),
            F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("chrom"),
            (F.col("l_partkey") * 7).alias("pos"),
            F.concat_ws("_", "l_returnflag", "l_linestatus").alias("sample"),
            F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("long")).otherwise(0).alias("m"),
            F.when(F.col("l_linenumber") % 2 != 0, F.col("l_quantity").cast("long")).otherwise(0).alias("u"),
        )

    @cached_property
    def _index(self) -> tuple[DataFrame, DataFrame]:
        positions = scratch.stored(self._placed.select("genome", "chrom", "pos").distinct(), "positions")
        sizes = positions.groupBy("genome", "chrom").agg((F.max("pos") + 2).alias("chrom_size"))
        output.write_index(*g.build(positions, sizes), self.folder)
        return output.read_index(self.spark, self.folder)

    @property
    def sites(self) -> DataFrame:
        return self._index[0]

    @property
    def chroms(self) -> DataFrame:
        return self._index[1]

    @cached_property
    def samples(self) -> DataFrame:
        return scratch.stored(self._placed.select("genome", "sample").distinct(), "samples")

    @cached_property
    def methylomes(self) -> DataFrame:
        # Dealt by place once, for the sums and for the join with the sites.
        counts = self._placed.repartition("genome", "chrom", "pos").groupBy("genome", "chrom", "pos", "sample").agg(F.sum("m").alias("n_meth"), F.sum("u").alias("n_unmeth"))
        aligned = counts.join(self.sites.select("genome", "chrom", "pos", "site_idx"), ["genome", "chrom", "pos"])
        output.write_methylomes(aligned.select("genome", "sample", "site_idx", "n_meth", "n_unmeth"), self.samples, self.folder)
        return output.read_methylomes(self.spark, self.folder)[0]

    @cached_property
    def intervals(self) -> DataFrame:
        order = read(self.spark, self.sf_dir, "orders")
        raw = order.select(F.col("o_orderkey").alias("interval_id"), F.lit(GENOME).alias("genome"), F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")).alias("chrom"), (F.col("o_orderkey") * 13).alias("a"), (100 + F.col("o_custkey") % 400).alias("width"))
        clipped = raw.join(F.broadcast(self.chroms.select("chrom", "chrom_size")), "chrom")  # five chromosomes
        start = F.col("a") % F.col("chrom_size")
        return clipped.select("interval_id", "genome", "chrom", start.alias("start"), F.least(start + F.col("width"), F.col("chrom_size")).alias("stop"))

    @cached_property
    def marks(self) -> DataFrame:
        output.write_marks(site_marks(self.sites, self.chroms), f"{self.folder}/marks")
        return output.read_marks(self.spark, f"{self.folder}/marks")

    @cached_property
    def prefix(self) -> DataFrame:
        output.write_prefix(prefix_sums(self.methylomes, self.chroms), f"{self.folder}/prefix")
        return output.read_prefix(self.spark, f"{self.folder}/prefix")

    @cached_property
    def pyramid(self) -> Pyramid:
        write_pyramid(self.methylomes, self.sites, f"{self.folder}/pyramid", UNITS)
        return read_pyramid(self.spark, f"{self.folder}/pyramid", UNITS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables made in this process, by application and files; those of one folder are held at a time.
_MADE: dict[tuple, Tables] = {}


def _files(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Files of a table with their sizes and times of change, as Spark's file system lists them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in path.getFileSystem(conf).listStatus(path)))


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived tables, stored in the shared folder as ingest would; made again when the files they come from have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, _files(spark, sf_dir, "lineitem"), _files(spark, sf_dir, "orders"))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Tables(spark, sf_dir)
    return _MADE[key]


#: The same tables in SQL: sites, chroms, meth (with chrom and pos), samples, ivs.
SQL = """
WITH placed AS (
  SELECT 'chr' || CAST(l_suppkey % 5 AS VARCHAR) AS chrom, l_partkey * 7 AS pos, l_returnflag || '_' || l_linestatus AS sample,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS m,
    CASE WHEN l_linenumber % 2 <> 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS u
  FROM lineitem
), sites AS (
  SELECT chrom, pos, CAST(row_number() OVER (ORDER BY chrom, pos) - 1 AS BIGINT) AS site_idx FROM (SELECT DISTINCT chrom, pos FROM placed)
), chroms AS (
  SELECT chrom, max(pos) + 2 AS chrom_size, CAST(count(*) AS BIGINT) AS n_sites,
    CAST(row_number() OVER (ORDER BY chrom) - 1 AS INTEGER) AS chrom_ord, CAST(min(site_idx) AS BIGINT) AS chrom_offset
  FROM sites GROUP BY chrom
), meth AS (
  SELECT p.sample, s.site_idx, p.chrom, p.pos, CAST(sum(m) AS BIGINT) AS n_meth, CAST(sum(u) AS BIGINT) AS n_unmeth
  FROM placed p JOIN sites s ON p.chrom = s.chrom AND p.pos = s.pos GROUP BY ALL
), samples AS (
  SELECT DISTINCT sample FROM placed
), ivs AS (
  SELECT o_orderkey AS interval_id, c.chrom, (o_orderkey * 13) % chrom_size AS start,
    least((o_orderkey * 13) % chrom_size + 100 + o_custkey % 400, chrom_size) AS stop
  FROM orders JOIN chroms c ON c.chrom = 'chr' || CAST(o_custkey % 5 AS VARCHAR)
), bins500 AS (
  SELECT chrom, k * 500 AS start, least(k * 500 + 500, chrom_size) AS stop
  FROM (SELECT chrom, chrom_size, unnest(range(CAST(ceil(chrom_size / 500.0) AS BIGINT))) AS k FROM chroms)
)
"""


def window_sql(size: int, step: int) -> str:
    return f"wins AS (SELECT chrom, k * {step} AS start, least(k * {step} + {size}, chrom_size) AS stop FROM (SELECT chrom, chrom_size, unnest(range(CAST(ceil(chrom_size / {step}.0) AS BIGINT))) AS k FROM chroms))"

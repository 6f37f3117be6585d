"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.functions import columns as fn
from methgrid.operators import catalog, check, genome, intervals, levels, merge, metadata, requests
from methgrid.plans.derived import SAMPLES, SQL, Tables, read, tables, window_sql
from methgrid.sources import counts, output, scratch
from methgrid.sources import tables as src
from methgrid.sources import fasta
from methgrid.sources.lines import previous

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir), or of Tables if it takes one argument, by its name."""

    def put(f):
        QUERIES[f.__name__] = f if f.__code__.co_argcount == 2 else lambda spark, sf_dir: f(tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


SUM = "CAST(coalesce(sum(n_meth), 0) AS BIGINT) AS n_meth, CAST(coalesce(sum(n_unmeth), 0) AS BIGINT) AS n_unmeth"
COVERED = ", CAST(count(*) FILTER (n_meth + n_unmeth > 0) AS BIGINT) AS n_covered"


def _range_sql(ranges: str, keys: str, extra: str = "") -> str:
    return f"SELECT {keys}, x.sample, {SUM}{extra} FROM {ranges} i CROSS JOIN samples x LEFT JOIN meth t ON t.sample = x.sample AND t.chrom = i.chrom AND t.pos >= i.start AND t.pos < i.stop GROUP BY ALL"


def _ranked(t: Tables) -> DataFrame:
    return intervals.site_ranks(t.intervals, t.sites, t.chroms, t.marks)


@query(SQL + _range_sql("ivs", "i.interval_id"))
def interval_levels(t: Tables):
    return levels.levels("intervals", chroms=t.chroms, sites=t.sites, methylomes=t.methylomes, samples=t.samples, intervals=t.intervals, marks=t.marks, prefix=t.prefix)


@query(SQL + _range_sql("ivs", "i.interval_id", COVERED))
def interval_levels_covered(t: Tables):
    return levels.levels("query", chroms=t.chroms, sites=t.sites, methylomes=t.methylomes, samples=t.samples, ranked=_ranked(t), covered=True, prefix=t.prefix)


@query(SQL + "SELECT interval_id, CAST((SELECT count(*) FROM sites s WHERE s.chrom < i.chrom OR s.chrom = i.chrom AND s.pos < i.start) AS BIGINT) AS lo, CAST((SELECT count(*) FROM sites s WHERE s.chrom < i.chrom OR s.chrom = i.chrom AND s.pos < i.stop) AS BIGINT) AS hi FROM ivs i")
def interval_site_ranks(t: Tables):
    return _ranked(t).select("interval_id", "lo", "hi")


@query(SQL + "SELECT interval_id, CAST(count(s.pos) AS BIGINT) AS n_cpgs FROM ivs i LEFT JOIN sites s ON s.chrom = i.chrom AND s.pos >= i.start AND s.pos < i.stop GROUP BY interval_id")
def interval_cpgs(t: Tables):
    return intervals.n_cpgs(_ranked(t))


@query(SQL + _range_sql("bins500", "i.chrom, i.start, i.stop"))
def bin_levels(t: Tables):
    return levels.bin_levels(t.chroms, t.sites, t.methylomes, t.samples, 500, pyramid=t.pyramid).drop("genome")


@query(SQL + _range_sql("bins500", "i.chrom, i.start, i.stop", COVERED))
def bin_levels_covered(t: Tables):
    return levels.bin_levels(t.chroms, t.sites, t.methylomes, t.samples, 500, covered=True, pyramid=t.pyramid).drop("genome")


@query(SQL + "SELECT i.chrom, i.start, i.stop, CAST(count(s.pos) AS BIGINT) AS n_cpgs FROM bins500 i LEFT JOIN sites s ON s.chrom = i.chrom AND s.pos >= i.start AND s.pos < i.stop GROUP BY ALL")
def bin_cpgs(t: Tables):
    return levels.bin_cpgs(t.chroms, t.sites, 500).drop("genome")


def _windows(name: str, size: int, step: int, covered: bool = False) -> None:
    def f(t: Tables):
        return levels.window_levels(t.chroms, t.sites, t.methylomes, t.samples, size, step, covered, t.marks, t.prefix, t.pyramid).drop("genome")

    f.__name__ = name
    query(SQL.rstrip() + ", " + window_sql(size, step) + _range_sql("wins", "i.chrom, i.start, i.stop", COVERED if covered else ""))(f)


_windows("window_levels", 600, 200)
_windows("window_levels_covered", 600, 200, covered=True)
_windows("window_levels_gaps", 200, 600)
_windows("window_levels_long", 1001, 500)


@query(SQL.rstrip() + ", " + window_sql(600, 200) + "SELECT i.chrom, i.start, i.stop, CAST(count(s.pos) AS BIGINT) AS n_cpgs FROM wins i LEFT JOIN sites s ON s.chrom = i.chrom AND s.pos >= i.start AND s.pos < i.stop GROUP BY ALL")
def window_cpgs(t: Tables):
    return levels.window_cpgs(t.chroms, t.sites, 600, 200).drop("genome")


@query(SQL + f"SELECT sample, {SUM}{COVERED} FROM meth WHERE sample IN (SELECT sample FROM samples) GROUP BY sample")
def global_levels(t: Tables):
    return levels.global_levels(t.methylomes, t.samples, covered=True).drop("genome")


@query(SQL + f"SELECT x.sample, x.col_ord, {SUM} FROM meth t JOIN (VALUES ('R_F', 0), ('A_F', 1), ('R_F', 2)) x(sample, col_ord) ON x.sample = t.sample GROUP BY ALL")
def requested_samples(t: Tables):
    asked = levels.requested(t.methylomes, ["R_F", "A_F", "R_F"])
    return asked.groupBy("sample", "col_ord").agg(F.sum("n_meth").alias("n_meth"), F.sum("n_unmeth").alias("n_unmeth"))


@query(SQL + "SELECT chrom, chrom_ord, chrom_size, chrom_offset, n_sites, CAST(ceil(chrom_size / 500.0) AS BIGINT) AS n_bins, CAST(ceil(chrom_size / 200.0) AS BIGINT) AS n_windows FROM chroms")
def chromosomes(t: Tables):
    return t.chroms.select("chrom", "chrom_ord", "chrom_size", "chrom_offset", "n_sites", F.ceil(F.col("chrom_size") / 500).alias("n_bins"), F.ceil(F.col("chrom_size") / 200).alias("n_windows"))


@query(SQL + "SELECT CAST(sum(ceil(chrom_size / 200.0)) AS BIGINT) AS n_windows FROM chroms")
def number_of_windows(t: Tables):
    return genome.n_windows(t.chroms, 200).select("n_windows")


@query(SQL + "SELECT chrom, start, stop, chrom || '.' || CAST(start AS VARCHAR) || '.' || CAST(stop AS VARCHAR) AS name FROM bins500")
def generated_bins(t: Tables):
    return genome.bins(t.chroms, 500).select("chrom", "start", "stop", fn.row_name(["chrom", "start", "stop"]).alias("name"))


@query(SQL + "SELECT CAST(sum(ceil(chrom_size / 500.0)) AS BIGINT) AS n_bins FROM chroms")
def number_of_bins(t: Tables):
    return genome.n_bins(t.chroms, 500).select("n_bins")


@query(SQL + "SELECT bool_and(start <= stop) AS valid FROM ivs")
def intervals_valid(t: Tables):
    return intervals.are_valid(t.intervals)


@query(SQL + """, o AS (SELECT *, lag(chrom) OVER (ORDER BY interval_id) AS pc, lag(start) OVER (ORDER BY interval_id) AS ps FROM ivs)
SELECT NOT bool_or(coalesce(pc = chrom AND start < ps, false)) AND coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM o WHERE pc IS NULL OR pc <> chrom GROUP BY chrom)), 0) <= 1 AS sorted FROM o""")
def intervals_sorted(t: Tables):
    return intervals.are_sorted(t.intervals)


@query(SQL + "SELECT sample, site_idx, n_meth / greatest(1, n_meth + n_unmeth) AS wmean, CASE WHEN n_meth + n_unmeth >= 60 THEN n_meth / greatest(1, n_meth + n_unmeth) ELSE -1.0 END AS matrix_wmean, CASE WHEN n_meth + n_unmeth >= 60 THEN n_meth / greatest(1, n_meth + n_unmeth) END AS wmean_or_null, n_meth + n_unmeth AS n_reads FROM meth")
def site_scores(t: Tables):
    return t.methylomes.select("sample", "site_idx", fn.wmean().alias("wmean"), fn.wmean_or(60, -1.0).alias("matrix_wmean"), fn.wmean_or(60).alias("wmean_or_null"), fn.n_reads().alias("n_reads"))


@query(SQL + """, big AS (SELECT sample, site_idx, n_meth * 4001 AS m, n_unmeth * 3001 AS u, greatest(n_meth * 4001, n_unmeth * 3001) AS top FROM meth)
SELECT sample, site_idx, CAST(CASE WHEN top > 65535 THEN round(m / top * 65535) ELSE m END AS INTEGER) AS n_meth, CAST(CASE WHEN top > 65535 THEN round(u / top * 65535) ELSE u END AS INTEGER) AS n_unmeth FROM big""")
def rescaled_counts(t: Tables):
    m, u = F.col("n_meth") * 4001, F.col("n_unmeth") * 3001
    return t.methylomes.select("sample", "site_idx", fn.fit_u16(m, u).alias("n_meth"), fn.fit_u16(u, m).alias("n_unmeth"))


@query(SQL + f"SELECT split_part(sample, '_', 1) AS sample, site_idx, {SUM} FROM meth WHERE sample IN (SELECT sample FROM samples) GROUP BY ALL")
def merged_by_group(t: Tables):
    groups = t.samples.select("sample", F.substring_index("sample", "_", 1).alias("group"))
    return merge.merge_by(t.methylomes, groups).drop("genome")


_BYTES = """, n AS (SELECT count(*) AS n FROM sites), b AS (
  SELECT sample, n * 4 AS len, unnest([n_meth & 255, (n_meth >> 8) & 255, n_unmeth & 255, (n_unmeth >> 8) & 255]) AS d, site_idx * 4 + unnest([0, 1, 2, 3]) AS i FROM meth, n)
"""


@query(SQL + _BYTES + "SELECT sample, CAST((sum(d * ((len - i) % 65521)) % 65521) * 65536 + sum(d) % 65521 AS BIGINT) AS methylome_hash FROM b GROUP BY sample")
def methylome_hashes(t: Tables):
    return check.methylome_hash(t.methylomes, t.chroms.groupBy("genome").agg(F.sum("n_sites").alias("n_sites"))).drop("genome")


@query(SQL + """, b AS (SELECT s.chrom, n_sites * 4 AS len, unnest([pos & 255, (pos >> 8) & 255, (pos >> 16) & 255, (pos >> 24) & 255]) AS d, (site_idx - chrom_offset) * 4 + unnest([0, 1, 2, 3]) AS i FROM sites s JOIN chroms c ON s.chrom = c.chrom)
SELECT chrom, CAST((sum(d * ((len - i) % 65521)) % 65521) * 65536 + sum(d) % 65521 AS BIGINT) AS chrom_hash FROM b GROUP BY chrom""")
def chromosome_hashes(t: Tables):
    return check.chrom_hash(t.sites, t.chroms).select("chrom", "chrom_hash")


@query(SQL + _BYTES + "SELECT sample, CAST((sum(d * ((len - i) % 65521)) % 65521) * 65536 + sum(d) % 65521 AS BIGINT) AS methylome_hash, CAST((SELECT n FROM n) AS BIGINT) AS n_cpgs FROM b GROUP BY sample")
def methylome_metadata(t: Tables):
    return metadata.methylome_metadata(t.methylomes, metadata.genome_metadata(t.sites, t.chroms)).select("sample", "methylome_hash", "n_cpgs")


@query(SQL + f""", m AS (SELECT sample, n_meth + CASE WHEN sample = 'N_F' AND site_idx % 2 = 0 THEN 1 ELSE 0 END AS n_meth, n_unmeth FROM meth)
SELECT 'methylome' AS kind, sample AS name, sample <> 'N_F' AS hash_ok, true AS index_found, sample <> 'A_F' AS index_ok, {SUM}{COVERED}, sample NOT IN ('A_F', 'N_F') AS ok FROM m GROUP BY sample
UNION ALL SELECT 'genome', 'g1', true, true, true, NULL, NULL, NULL, true UNION ALL SELECT 'genome', 'g2', false, true, true, NULL, NULL, NULL, false""")
def consistency_report(t: Tables):
    """Metadata of one sample names another index; the counts of one, and the sites of a second genome, changed since their metadata were stored."""
    both = [x.unionByName(x.withColumn("genome", F.lit("g2"))) for x in (t.sites, t.chroms)]
    genomes = scratch.stored(metadata.genome_metadata(*both), "genomes")
    meta = metadata.methylome_metadata(t.methylomes, genomes.where("genome = 'g1'")).withColumn("index_hash", F.when(F.col("sample") == "A_F", 0).otherwise(F.col("index_hash")))
    changed = t.methylomes.withColumn("n_meth", F.col("n_meth") + F.when((F.col("sample") == "N_F") & (F.col("site_idx") % 2 == 0), 1).otherwise(0))
    moved = both[0].withColumn("pos", F.col("pos") + F.when((F.col("genome") == "g2") & (F.col("site_idx") == 11), 1).otherwise(0))
    return check.check_all(moved, both[1], genomes, changed, meta).drop("genome")


_CHANGED = _BYTES.replace("FROM meth, n", "FROM (SELECT sample, site_idx, n_meth + CASE WHEN sample = 'N_F' AND site_idx % 512 < 200 THEN 3 ELSE 0 END AS n_meth, n_unmeth FROM meth), n")


def _changed(t: Tables) -> DataFrame:
    """Counts of one sample raised in every other block of 256 sites."""
    return t.methylomes.withColumn("n_meth", F.col("n_meth") + F.when((F.col("sample") == "N_F") & (F.col("site_idx") % 512 < 200), 3).otherwise(0))


@query(SQL + "SELECT DISTINCT sample, site_idx // 256 AS block FROM meth WHERE sample = 'N_F' AND site_idx % 512 < 200")
def blocks_changed(t: Tables):
    before = scratch.stored(check.methylome_sums(t.methylomes, 256), "sums")
    return check.changed_blocks(before, check.methylome_sums(_changed(t), 256), ["genome", "sample"]).select("sample", "block")


@query(SQL + _CHANGED + "SELECT sample, CAST((sum(d * ((len - i) % 65521)) % 65521) * 65536 + sum(d) % 65521 AS BIGINT) AS methylome_hash, CAST((SELECT n FROM n) AS BIGINT) AS n_cpgs FROM b GROUP BY sample")
def metadata_updated(t: Tables):
    """New metadata after a change, from stored sums of blocks and the changed blocks alone."""
    before, changed = scratch.stored(check.methylome_sums(t.methylomes, 256), "sums"), _changed(t)
    touched = changed.where("sample = 'N_F' and site_idx % 512 < 200").select("genome", "sample", F.expr("site_idx div 256").alias("block")).distinct()
    sums = check.updated_sums(before, changed, touched, 256)
    return metadata.updated_metadata(sums, metadata.genome_metadata(t.sites, t.chroms)).select("sample", "methylome_hash", "n_cpgs")


@query(SQL.rstrip().replace("WITH placed", "WITH RECURSIVE placed", 1) + """, b AS (SELECT s.chrom, n_sites * 4 AS len, unnest([pos & 255, (pos >> 8) & 255, (pos >> 16) & 255, (pos >> 24) & 255]) AS d, (site_idx - chrom_offset) * 4 + unnest([0, 1, 2, 3]) AS i FROM sites s JOIN chroms c ON s.chrom = c.chrom),
h AS (SELECT chrom_ord, any_value(len) % 65521 AS rem, CAST(sum(d) % 65521 AS BIGINT) AS a, CAST(sum(d * ((len - i) % 65521)) % 65521 AS BIGINT) AS b FROM b JOIN chroms USING (chrom) GROUP BY chrom_ord),
fold AS (SELECT 0 AS k, CAST(1 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b UNION ALL SELECT k + 1, (fold.a + h.a + 65520) % 65521, (rem * fold.a + fold.b + h.b + 65521 - rem) % 65521 FROM fold JOIN h ON h.chrom_ord = k)
SELECT b * 65536 + a AS index_hash, (SELECT CAST(count(*) AS BIGINT) FROM sites) AS n_cpgs FROM fold ORDER BY k DESC LIMIT 1""")
def genome_hash(t: Tables):
    return metadata.genome_metadata(t.sites, t.chroms).select("index_hash", "n_cpgs")


@query(SQL + ", e AS (" + _range_sql("bins500", "i.chrom, i.start, i.stop") + ") SELECT chrom, start, chrom || chr(9) || CAST(start AS VARCHAR) || chr(9) || CAST(stop AS VARCHAR) || chr(9) || string_agg(CAST(n_meth AS VARCHAR) || chr(9) || CAST(n_unmeth AS VARCHAR), chr(9) ORDER BY sample) AS line FROM e GROUP BY chrom, start, stop")
def bin_counts_text(t: Tables):
    got = levels.bin_levels(t.chroms, t.sites, t.methylomes, t.samples, 500)
    return output.to_lines(got, ["chrom", "start", "stop"], SAMPLES).select("chrom", "start", "line")


@query(SQL + ", e AS (" + _range_sql("bins500", "i.chrom, i.start, i.stop") + ") SELECT chrom, start, stop, chrom || '.' || CAST(start AS VARCHAR) || '.' || CAST(stop AS VARCHAR) AS name, " + ", ".join(f"max(CASE WHEN sample = '{s}' THEN n_meth / greatest(1, n_meth + n_unmeth) END) AS \"{s}_M\", max(CASE WHEN sample = '{s}' THEN n_meth + n_unmeth END) AS \"{s}_R\"" for s in SAMPLES) + " FROM e GROUP BY ALL")
def bin_classic_table(t: Tables):
    got = levels.bin_levels(t.chroms, t.sites, t.methylomes, t.samples, 500)
    return output.to_wide(got, ["chrom", "start", "stop"], SAMPLES, kind="classic")


_G6 = "format('{:g}', CAST(CAST(n_meth / greatest(1, n_meth + n_unmeth) AS FLOAT) AS DOUBLE))"


@query(SQL + f"SELECT sample, site_idx, {_G6} || chr(9) || CAST(n_meth + n_unmeth AS VARCHAR) AS classic, CASE WHEN n_meth + n_unmeth >= 60 THEN {_G6} ELSE 'NA' END AS score FROM meth")
def site_score_text(t: Tables):
    return t.methylomes.select("sample", "site_idx", fn.element("classic").alias("classic"), fn.element("scores", min_reads=60).alias("score"))


def _as_lines(rows: DataFrame) -> DataFrame:
    """Rows as lines of one file, in blocks of up to 65,536 lines of a partition."""
    id_ = F.monotonically_increasing_id()
    return rows.select(F.lit("x").alias("file"), F.shiftright(id_, 16).alias("block"), id_.alias("id"), "value")


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_discount * l_quantity) AS INTEGER) AS n_meth, CAST(CAST(l_quantity AS BIGINT) - round(l_discount * l_quantity) AS INTEGER) AS n_unmeth FROM lineitem")
def counts_text_decoded(spark: SparkSession, sf_dir: str):
    line = read(spark, sf_dir, "lineitem")
    text = line.select(F.concat_ws("\t", F.concat(F.lit("c"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"), F.lit("+"), F.lit("CG"), F.col("l_discount").cast("string"), F.col("l_quantity").cast("long").cast("string")).alias("value"))
    got = counts.parse_counts(_as_lines(text)).where("error is null")
    return got.select(F.expr("substring(chrom, 2)").cast("long").alias("l_orderkey"), F.col("pos").cast("int").alias("l_linenumber"), "n_meth", "n_unmeth")


@query("SELECT doc_id, CAST(i AS INTEGER) AS pos FROM (SELECT doc_id, replace(text, chr(10), '') AS s, unnest(range(length(replace(text, chr(10), '')))) AS i FROM documents) WHERE substr(s, CAST(i AS INTEGER) + 1, 2) IN ('TH', 'Th', 'tH', 'th')")
def motif_scan(spark: SparkSession, sf_dir: str):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "").alias("s"))
    return docs.select("doc_id", F.explode(fasta.motif_positions(F.col("s"), "TH")).alias("pos"))


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("genome"), F.col("doc_id").cast("string").alias("accession"), F.col("source").alias("label"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("text"), F.col("text")).alias("metadata"))


@query("SELECT CAST(doc_id AS VARCHAR) AS accession FROM documents WHERE (regexp_matches(source, 'src1', 'i') OR regexp_matches(lang, 'src1', 'i') OR regexp_matches(text, 'src1', 'i')) AND (regexp_matches(source, 'license', 'i') OR regexp_matches(lang, 'license', 'i') OR regexp_matches(text, 'license', 'i'))")
def sample_search(spark: SparkSession, sf_dir: str):
    return catalog.search(_info(spark, sf_dir), ["SRC1", "no such sample at all", "license"]).select("accession")


@query("SELECT DISTINCT lang AS genome FROM documents")
def catalog_genomes(spark: SparkSession, sf_dir: str):
    return catalog.genomes(_info(spark, sf_dir))


@query("SELECT CAST(doc_id AS VARCHAR) AS accession, 'lang: ' || lang || ' | text: ' || text AS serialised FROM documents")
def catalog_metadata_text(spark: SparkSession, sf_dir: str):
    return _info(spark, sf_dir).select("accession", catalog.metadata_text().alias("serialised"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("group"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("accession"))


#: A member's label: five digits at least; DuckDB's lpad alone would cut longer numbers to five.
_LABEL = "c_mktsegment || '_' || lpad(CAST(n AS VARCHAR), CAST(greatest(5, length(CAST(n AS VARCHAR))) AS INTEGER), '0')"


def _groups_sql(where: str = "") -> str:
    return f"SELECT c_mktsegment AS \"group\", {_LABEL} AS label, accession FROM (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS accession FROM customer{where})"


_GROUPS = _groups_sql()


@query(_GROUPS)
def sample_groups(spark: SparkSession, sf_dir: str):
    return catalog.make_groups(_members(spark, sf_dir))


@query(_groups_sql(" WHERE c_custkey % 3 <> 0"))
def sample_groups_removed(spark: SparkSession, sf_dir: str):
    groups = catalog.make_groups(_members(spark, sf_dir))
    gone = groups.where(F.col("accession").cast("long") % 3 == 0).select("group", "accession")
    return catalog.remove_members(groups, gone)


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS accession FROM customer WHERE (c_custkey % 2 = 0) <> (c_custkey % 3 = 0)")
def selection_toggled(spark: SparkSession, sf_dir: str):
    every = _members(spark, sf_dir).select("accession")
    number = F.col("accession").cast("long")
    return catalog.toggle(every.where(number % 2 == 0), every.where(number % 3 == 0))


def _requests(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """Requests made of a table's keys, valid ones and others."""
    k = F.col(key)
    kind = F.when(k % 4 == 3, "other").when(k % 4 == 2, "windows").when(k % 4 == 1, "bins").otherwise("intervals")
    names = F.when(k % 5 == 4, F.array(F.lit("A-F"))).when(k % 5 == 3, F.array(F.lit("X_X"))).when(k % 5 == 2, F.array(F.lit("R_F"), F.lit("A_F"), F.lit("R_F"))).otherwise(F.array(F.lit("A_F"), F.lit("R_O")))
    return read(spark, sf_dir, table).select(k.alias("request_id"), kind.alias("kind"), (k % 40 * 20 + 50).cast("long").alias("aux"), F.lit(100).cast("long").alias("step"), F.when(k % 7 == 6, 2).otherwise(1).cast("long").alias("index_hash"), names.alias("samples"), F.lit("g1").alias("genome"))


def _catalog_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([("g1", 1)], "genome string, index_hash long"), spark.createDataFrame([(s, "g1", 1) for s in SAMPLES], "sample string, genome string, index_hash long")


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 4 = 3 THEN 'invalid_kind' WHEN o_orderkey % 4 <> 0 AND o_orderkey % 40 * 20 + 50 < 100 THEN 'invalid_size'
WHEN o_orderkey % 5 = 4 THEN 'invalid_name' WHEN o_orderkey % 5 = 3 THEN 'methylome_not_found' WHEN o_orderkey % 7 = 6 THEN 'invalid_index_hash' ELSE 'ok' END AS status FROM orders""")
def request_statuses(spark: SparkSession, sf_dir: str):
    return requests.statuses(_requests(spark, sf_dir, "orders", "o_orderkey").drop("genome"), *_catalog_tables(spark))


def _answerable(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    asked = _requests(spark, sf_dir, table, key)
    return requests.judged(asked, *_catalog_tables(spark)).where("status = 'ok'").drop("status")


def _req(table: str, key: str) -> str:
    """The valid requests r, and their columns rc, in SQL."""
    return f""", r AS (SELECT {key} AS request_id, {key} % 4 AS k, {key} % 40 * 20 + 50 AS size, CASE WHEN {key} % 5 = 2 THEN ['R_F', 'A_F', 'R_F'] ELSE ['A_F', 'R_O'] END AS names
FROM {table} WHERE {key} % 4 < 3 AND {key} % 5 < 3 AND {key} % 7 <> 6 AND ({key} % 4 = 0 OR {key} % 40 * 20 + 50 >= 100)),
rc AS (SELECT request_id, k, size, CAST(unnest(range(len(names))) AS INTEGER) AS col_ord, unnest(names) AS sample FROM r)
"""


@query(SQL + _req("orders", "o_orderkey") + "SELECT request_id, CASE WHEN k = 0 THEN size ELSE (SELECT CAST(sum(ceil(chrom_size / CAST(CASE k WHEN 1 THEN size ELSE 100 END AS DOUBLE))) AS BIGINT) FROM chroms) END AS n_rows, CAST(len(names) AS INTEGER) AS n_cols FROM r")
def request_shapes(spark: SparkSession, sf_dir: str):
    asked = _answerable(spark, sf_dir, "orders", "o_orderkey").drop("genome")
    return requests.shapes(asked, _catalog_tables(spark)[0], tables(spark, sf_dir).chroms)


@query(SQL + _req("supplier", "s_suppkey") + f""", b AS (SELECT request_id, size, chrom, k0 * size AS start, least(k0 * size + size, chrom_size) AS stop FROM (SELECT request_id, size, chrom, chrom_size, unnest(range(CAST(ceil(chrom_size / CAST(size AS DOUBLE)) AS BIGINT))) AS k0 FROM r, chroms WHERE k = 1))
SELECT request_id, col_ord, x.sample, i.chrom, i.start, i.stop, {SUM} FROM b i JOIN rc x USING (request_id) LEFT JOIN meth t ON t.sample = x.sample AND t.chrom = i.chrom AND t.pos >= i.start AND t.pos < i.stop GROUP BY ALL""")
def request_bins(spark: SparkSession, sf_dir: str):
    t = tables(spark, sf_dir)
    return requests.answer_bins(_answerable(spark, sf_dir, "supplier", "s_suppkey"), t.chroms, t.sites, t.methylomes, t.marks, t.prefix, t.pyramid)


@query(SQL + _req("supplier", "s_suppkey") + f""", w AS (SELECT request_id, size, chrom, k0 * 100 AS start, least(k0 * 100 + size, chrom_size) AS stop FROM r, (SELECT chrom, chrom_size, unnest(range(CAST(ceil(chrom_size / 100.0) AS BIGINT))) AS k0 FROM chroms) WHERE k = 2)
SELECT request_id, col_ord, x.sample, i.chrom, i.start, i.stop, {SUM} FROM w i JOIN rc x USING (request_id) LEFT JOIN meth t ON t.sample = x.sample AND t.chrom = i.chrom AND t.pos >= i.start AND t.pos < i.stop GROUP BY ALL""")
def request_windows(spark: SparkSession, sf_dir: str):
    t = tables(spark, sf_dir)
    return requests.answer_windows(_answerable(spark, sf_dir, "supplier", "s_suppkey"), t.chroms, t.sites, t.methylomes, t.marks, t.prefix)


@query(SQL + _req("supplier", "s_suppkey") + f""" SELECT request_id, col_ord, x.sample, i.interval_id, {SUM}{COVERED} FROM ivs i JOIN rc x ON x.request_id = 1 + i.interval_id % (SELECT max(s_suppkey) FROM supplier) AND x.k = 0 LEFT JOIN meth t ON t.sample = x.sample AND t.chrom = i.chrom AND t.pos >= i.start AND t.pos < i.stop GROUP BY ALL""")
def request_intervals(spark: SparkSession, sf_dir: str):
    t = tables(spark, sf_dir)
    last = read(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
    own = t.intervals.drop("genome").withColumn("request_id", 1 + F.col("interval_id") % last)
    return requests.answer_intervals(_answerable(spark, sf_dir, "supplier", "s_suppkey"), own, t.chroms, t.sites, t.methylomes, t.marks, t.prefix, covered=True)


@query(SQL + f""", own AS (SELECT c_custkey AS request_id, i.* FROM customer, (SELECT * FROM ivs ORDER BY interval_id LIMIT 3) i WHERE c_custkey % 4 <> 3)
SELECT request_id, CAST(x.col_ord AS INTEGER) AS col_ord, x.sample, interval_id, {SUM}{COVERED} FROM own o CROSS JOIN (VALUES ('A_F', 0), ('R_O', 1)) x(sample, col_ord)
LEFT JOIN meth t ON t.sample = x.sample AND t.chrom = o.chrom AND t.pos >= o.start AND t.pos < o.stop GROUP BY ALL""")
def request_repeated(spark: SparkSession, sf_dir: str):
    """Three of four customers ask for the same three intervals of the same two samples."""
    t = tables(spark, sf_dir)
    asked = read(spark, sf_dir, "customer").where("c_custkey % 4 != 3").select(F.col("c_custkey").alias("request_id"), F.lit("intervals").alias("kind"), F.lit(3).cast("long").alias("aux"), F.lit(None).cast("long").alias("step"), F.lit("g1").alias("genome"), F.array(F.lit("A_F"), F.lit("R_O")).alias("samples"))
    same = t.intervals.orderBy("interval_id").limit(3).drop("genome")
    return requests.answer_intervals(asked, asked.select("request_id").crossJoin(F.broadcast(same)), t.chroms, t.sites, t.methylomes, t.marks, t.prefix, covered=True)


@query(SQL + f""", b AS (SELECT chrom, k0 * 333 AS start, least(k0 * 333 + 333, chrom_size) AS stop FROM (SELECT chrom, chrom_size, unnest(range(CAST(ceil(chrom_size / 333.0) AS BIGINT))) AS k0 FROM chroms))
SELECT c_custkey AS request_id, CAST(0 AS INTEGER) AS col_ord, x.sample, i.chrom, i.start, i.stop, {SUM} FROM (SELECT min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey) CROSS JOIN b i CROSS JOIN (VALUES ('N_F')) x(sample) LEFT JOIN meth t ON t.sample = x.sample AND t.chrom = i.chrom AND t.pos >= i.start AND t.pos < i.stop GROUP BY ALL""")
def request_odd_bins(spark: SparkSession, sf_dir: str):
    """A customer of each nation asks for bins of 333, which no stored level divides."""
    t = tables(spark, sf_dir)
    asked = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("request_id")).select("request_id", F.lit("bins").alias("kind"), F.lit(333).cast("long").alias("aux"), F.lit(None).cast("long").alias("step"), F.lit("g1").alias("genome"), F.array(F.lit("N_F")).alias("samples"))
    return requests.answer_bins(asked, t.chroms, t.sites, t.methylomes, t.marks, t.prefix, t.pyramid)


@query("SELECT c_custkey AS interval_id, CAST(j AS INTEGER) AS col_ord, c_custkey + 2 * j AS n_meth, c_custkey + 2 * j + 1 AS n_unmeth FROM customer, range(3) r(j)")
def matrix_text_parsed(spark: SparkSession, sf_dir: str):
    keys = read(spark, sf_dir, "customer").select("c_custkey")
    values = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.col("c_custkey") + i).cast("string"))
    text = keys.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey").select(F.array_join(values, "\t").alias("value"))
    return src.parse_matrix(_as_lines(text))


@query(SQL + "SELECT sample, chrom, pos, CAST(n_meth AS INTEGER) AS n_meth, CAST(n_unmeth AS INTEGER) AS n_unmeth FROM meth")
def xcounts_text_decoded(t: Tables):
    placed = t.methylomes.join(t.sites.select("site_idx", "chrom", "chrom_ord", "pos"), "site_idx")
    cut = placed.select(F.concat_ws(" ", "sample", "chrom").alias("file"), F.expr("pos div 4096").alias("block"), F.col("pos").alias("id"), "sample", "chrom_ord", "pos", "n_meth", "n_unmeth")
    step = F.col("pos") - F.coalesce("_last", F.lit(0))
    records = previous(cut, F.col("pos"), "_last").select("sample", "chrom_ord", F.col("pos"), F.concat_ws(" ", step.cast("string"), F.col("n_meth").cast("string"), F.col("n_unmeth").cast("string")).alias("value"))
    titles = t.samples.crossJoin(t.chroms.select("chrom_ord", "chrom")).select("sample", "chrom_ord", F.lit(-1).cast("long").alias("pos"), F.col("chrom").alias("value"))
    text = titles.unionByName(records).select(F.col("sample").alias("file"), (F.col("chrom_ord") * 1000000 + F.expr("greatest(pos, 0) div 4096")).cast("long").alias("block"), (F.col("pos") + 1).alias("id"), "value")
    return counts.parse_xcounts(text).where("error is null").select(F.col("file").alias("sample"), "chrom", "pos", "n_meth", "n_unmeth")


@query("SELECT CAST(doc_id AS VARCHAR) AS chrom, i AS pos FROM (SELECT doc_id, replace(text, chr(10), '') AS s, unnest(range(length(replace(text, chr(10), '')))) AS i FROM documents) WHERE substr(s, CAST(i AS INTEGER) + 1, 2) IN ('AN', 'An', 'aN', 'an')")
def fasta_sites(spark: SparkSession, sf_dir: str):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.concat_ws("\n", F.concat(F.lit(">"), F.col("doc_id").cast("string")), "text"), "\n")).alias("id", "value"))
    text = docs.select(F.concat(F.lit("docs"), F.expr("doc_id div 1000").cast("string"), F.lit(".fa")).alias("file"), F.col("doc_id").alias("block"), F.col("id").cast("long").alias("id"), "value")
    return fasta.parse(text, "AN")[0].select("chrom", "pos")


@query(SQL + """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS interval_id, CASE WHEN c.chrom IS NULL THEN 'unknown chromosome' WHEN a > b THEN 'start beyond stop' WHEN b > chrom_size THEN 'beyond the chromosome' END AS error
FROM (SELECT *, o_orderkey * 7 % 16000 AS a, o_orderkey * 7 % 16000 + o_custkey % 50 - 3 AS b FROM orders) o LEFT JOIN chroms c ON c.chrom = 'chr' || CAST(o_custkey % 6 AS VARCHAR)""")
def bed_validated(spark: SparkSession, sf_dir: str):
    t = tables(spark, sf_dir)
    start = F.col("o_orderkey") * 7 % 16000
    rows = read(spark, sf_dir, "orders").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    text = rows.select(F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("o_custkey") % 6).cast("string")), start.cast("string"), (start + F.col("o_custkey") % 50 - 3).cast("string"), F.lit("x")).alias("value"))
    return src.parse_bed(_as_lines(text), t.chroms).select("interval_id", "error")


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS file, CASE l_orderkey % 3 WHEN 0 THEN 'counts' WHEN 1 THEN 'xcounts' ELSE 'unknown' END AS format FROM lineitem")
def format_detected(spark: SparkSession, sf_dir: str):
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").cast("string").alias("n"))
    kind = F.col("l_orderkey") % 3
    value = F.when(kind == 0, F.concat(F.lit("chr1 5 + CG 0.5 "), "n")).when(kind == 1, F.lit("chr1")).otherwise(F.concat(F.lit("a b "), "n"))
    rows = line.select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").cast("long").alias("block"), F.posexplode(F.array(F.lit("# head"), value, F.lit("5 1 2"))).alias("id", "value"))
    return counts.detect(rows)


@query("SELECT \"group\", CAST(to_json(map_from_entries(list((label, accession) ORDER BY label))) AS VARCHAR) AS json FROM (" + _GROUPS + ") GROUP BY ALL")
def sample_groups_json(spark: SparkSession, sf_dir: str):
    return output.groups_json(catalog.make_groups(_members(spark, sf_dir)))


#: Intervals on a grid, so that many are equal, and a request that has one sample twice.
_COARSE = ", co AS (SELECT interval_id, chrom, start // 500 * 500 AS start, least(start // 500 * 500 + 500, (SELECT chrom_size FROM chroms c WHERE c.chrom = ivs.chrom)) AS stop FROM ivs), rq AS (SELECT unnest([0, 1, 2]) AS col_ord, unnest(['R_F', 'A_F', 'R_F']) AS sample)"
_ASKED = ["R_F", "A_F", "R_F"]


def _coarse(t: Tables, covered: bool = False, cpgs: bool = False) -> DataFrame:
    sizes = F.broadcast(t.chroms.select("chrom", "chrom_size"))  # five chromosomes
    start = F.expr("start div 500 * 500")
    rough = t.intervals.join(sizes, "chrom").select("interval_id", "genome", "chrom", start.alias("start"), F.least(start + 500, F.col("chrom_size")).alias("stop"))
    ranked = intervals.site_ranks(rough, t.sites, t.chroms, t.marks)
    asked = t.samples.where(F.col("sample").isin(_ASKED))
    keys = ["interval_id", "chrom", "start", "stop"]
    if cpgs:
        ranked, keys = ranked.withColumn("n_cpgs", F.col("hi") - F.col("lo")), [*keys, "n_cpgs"]
    return levels.interval_cells(ranked, t.methylomes, asked, covered, t.chroms, t.prefix, keys=keys)


def _wide_sql(columns: str) -> str:
    """One row for a coarse interval from its rows e (interval_id, chrom, start, stop, col_ord, n_meth, n_unmeth, n_covered, n_cpgs)."""
    rows = f"SELECT i.interval_id, i.chrom, i.start, i.stop, x.col_ord, {SUM}{COVERED}, CAST((SELECT count(*) FROM sites s WHERE s.chrom = i.chrom AND s.pos >= i.start AND s.pos < i.stop) AS BIGINT) AS n_cpgs FROM co i CROSS JOIN rq x LEFT JOIN meth t ON t.sample = x.sample AND t.chrom = i.chrom AND t.pos >= i.start AND t.pos < i.stop GROUP BY ALL"
    return SQL.rstrip() + _COARSE + f", e AS ({rows}) SELECT interval_id, {columns} FROM e GROUP BY interval_id, chrom, start, stop"


_BED = "chrom || chr(9) || CAST(start AS VARCHAR) || chr(9) || CAST(stop AS VARCHAR)"
_NAME = "chrom || '.' || CAST(start AS VARCHAR) || '.' || CAST(stop AS VARCHAR)"


@query(_wide_sql(_BED + " || chr(9) || string_agg(CAST(n_meth AS VARCHAR) || chr(9) || CAST(n_unmeth AS VARCHAR) || chr(9) || CAST(n_covered AS VARCHAR), chr(9) ORDER BY col_ord) || chr(9) || CAST(min(n_cpgs) AS VARCHAR) AS line"))
def interval_counts_text(t: Tables):
    return output.to_lines(_coarse(t, covered=True, cpgs=True), ["chrom", "start", "stop"], _ASKED, covered=True, cpgs=True).select("interval_id", "line")


@query(_wide_sql(_BED + " || chr(9) || string_agg(CASE WHEN n_meth + n_unmeth >= 900 THEN " + _G6 + " ELSE 'NA' END, chr(9) ORDER BY col_ord) AS line"))
def interval_scores_text(t: Tables):
    return output.to_lines(_coarse(t), ["chrom", "start", "stop"], _ASKED, kind="scores", min_reads=900).select("interval_id", "line")


@query(_wide_sql("string_agg(CAST(n_meth AS VARCHAR) || chr(9) || CAST(n_unmeth AS VARCHAR), chr(9) ORDER BY col_ord) AS line"))
def interval_matrix_text(t: Tables):
    return output.to_lines(_coarse(t), ["chrom", "start", "stop"], _ASKED, prefix="bare").select("interval_id", "line")


def _picked(value: str, i: int) -> str:
    return f"max(CASE WHEN col_ord = {i} THEN {value} END)"


@query(_wide_sql(_NAME + " AS name, " + ", ".join(f'{_picked(v, i)} AS "{n}_{c}"' for i, n in enumerate("xyz") for v, c in (("n_meth", "M"), ("n_unmeth", "U"), ("n_covered", "C"))) + ', min(n_cpgs) AS "N_CPG"'))
def interval_counts_table(t: Tables):
    return output.to_wide(_coarse(t, covered=True, cpgs=True), ["chrom", "start", "stop"], _ASKED, covered=True, cpgs=True, names=["x", "y", "z"]).drop("chrom", "start", "stop")


@query(_wide_sql(_NAME + " AS name, " + ", ".join(f'{_picked("CASE WHEN n_meth + n_unmeth >= 900 THEN n_meth / greatest(1, n_meth + n_unmeth) END", i)} AS {n}' for i, n in enumerate("xyz"))))
def interval_scores_table(t: Tables):
    return output.to_wide(_coarse(t), ["chrom", "start", "stop"], _ASKED, kind="scores", min_reads=900, names=["x", "y", "z"]).drop("chrom", "start", "stop")


_ELEMENT = SQL.rstrip() + _COARSE + f" SELECT x.col_ord, x.sample, i.interval_id, {SUM}{COVERED} FROM co i CROSS JOIN rq x LEFT JOIN meth t ON t.sample = x.sample AND t.chrom = i.chrom AND t.pos >= i.start AND t.pos < i.stop WHERE x.col_ord = 2 AND i.interval_id = (SELECT min(interval_id) FROM co) GROUP BY ALL"


def _stored_result(t: Tables) -> tuple[DataFrame, int]:
    """A stored result of coarse intervals, and its first interval."""
    spark = t.sites.sparkSession
    path = scratch.new_folder(spark, "result")
    asked = spark.createDataFrame([(s, i) for i, s in enumerate(_ASKED)], "sample string, col_ord int")
    rows = _coarse(t, covered=True).select("interval_id", F.explode("cells").alias("sample", "_sum")).select("interval_id", "sample", "_sum.*")
    output.write_result(rows.join(F.broadcast(asked), "sample"), path)
    return spark.read.parquet(path), t.intervals.agg(F.min("interval_id")).first()[0]


@query(_ELEMENT)
def result_element(t: Tables):
    result, first = _stored_result(t)
    return t.sites.sparkSession.createDataFrame([requests.at(result, first, 2)], result.schema)


@query(f"SELECT n_meth, n_unmeth, n_covered, n_meth / greatest(1, n_meth + n_unmeth) AS wmean FROM ({_ELEMENT})")
def result_element_values(t: Tables):
    result, first = _stored_result(t)
    values = [f(result, first, 2) for f in (requests.n_meth, requests.n_unmeth, requests.n_covered, requests.element_wmean)]
    return t.sites.sparkSession.createDataFrame([tuple(values)], "n_meth long, n_unmeth long, n_covered long, wmean double")


@query(_wide_sql(_NAME + " AS name, " + ", ".join(f'{_picked("CASE WHEN n_meth + n_unmeth >= 5 THEN n_meth / greatest(1, n_meth + n_unmeth) END", i)} AS {n}' for i, n in enumerate("xyz"))))
def matrix_wmeans(t: Tables):
    wide = output.to_wide(_coarse(t, covered=True), ["chrom", "start", "stop"], _ASKED, covered=True, names=["x", "y", "z"]).drop("chrom", "start", "stop")
    return fn.matrix_wmeans(wide, ["interval_id", "name"], has_covered=True, min_reads=5)


@query(SQL + "SELECT a.interval_id, CASE WHEN (ca.chrom_ord, a.start, a.stop) < (cb.chrom_ord, b.start, b.stop) THEN -1 WHEN (ca.chrom_ord, a.start, a.stop) > (cb.chrom_ord, b.start, b.stop) THEN 1 ELSE 0 END AS compared FROM ivs a JOIN ivs b ON b.interval_id = a.interval_id + 1 JOIN chroms ca ON ca.chrom = a.chrom JOIN chroms cb ON cb.chrom = b.chrom")
def intervals_compared(t: Tables):
    """Each interval against the one with the next id."""
    placed = t.intervals.join(F.broadcast(t.chroms.select("chrom", "chrom_ord")), "chrom").select("interval_id", F.struct("chrom_ord", "start", "stop").alias("x"))  # five chromosomes
    pairs = placed.join(placed.select((F.col("interval_id") - 1).alias("interval_id"), F.col("x").alias("y")), "interval_id")
    return pairs.select("interval_id", intervals.compared("x", "y").alias("compared"))


@query(SQL + ", e AS (" + _range_sql("bins500", "i.chrom, i.start, i.stop") + ") SELECT 'chrom' || chr(9) || 'start' || chr(9) || 'stop' || chr(9) || '" + "' || chr(9) || '".join(f"{s}_M' || chr(9) || '{s}_U" for s in SAMPLES) + "' AS line UNION ALL SELECT chrom || chr(9) || CAST(start AS VARCHAR) || chr(9) || CAST(stop AS VARCHAR) || chr(9) || string_agg(CAST(n_meth AS VARCHAR) || chr(9) || CAST(n_unmeth AS VARCHAR), chr(9) ORDER BY sample) FROM e GROUP BY chrom, start, stop")
def text_with_header(t: Tables):
    spark = t.sites.sparkSession
    path = scratch.new_folder(spark, "text")
    got = levels.bin_levels(t.chroms, t.sites, t.methylomes, t.samples, 500, pyramid=t.pyramid)
    head = "chrom\tstart\tstop\t" + output.header(SAMPLES)
    output.write_lines(output.to_lines(got, ["chrom", "start", "stop"], SAMPLES), ["chrom", "start"], path, head)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(SQL + "SELECT interval_id, chrom || chr(9) || CAST(start AS VARCHAR) || chr(9) || CAST(stop AS VARCHAR) AS line FROM ivs")
def interval_text(t: Tables):
    return t.intervals.select("interval_id", intervals.as_text().alias("line"))


@query(SQL + "SELECT chrom, start, stop, CAST(count(*) AS BIGINT) AS n FROM ivs GROUP BY ALL")
def intervals_of_frame(t: Tables):
    got = src.from_frame(t.intervals.select("chrom", "start", "stop", "interval_id"), "g1")
    return got.groupBy("chrom", "start", "stop").agg(F.count_distinct("interval_id").alias("n"))


@query(SQL + "SELECT CAST(CASE WHEN sample LIKE 'A%' THEN 2 ELSE 1 END AS BIGINT) AS index_hash, string_agg(sample, ',' ORDER BY sample) AS samples FROM (SELECT DISTINCT sample FROM meth) WHERE sample <> 'R_O' GROUP BY 1")
def samples_by_index(t: Tables):
    meta = t.samples.select("sample", F.when(F.col("sample").startswith("A"), 2).otherwise(1).cast("long").alias("index_hash"))
    return levels.by_index(meta, [s for s in SAMPLES if s != "R_O"]).select("index_hash", F.array_join("samples", ",").alias("samples"))


@query("SELECT DISTINCT source || '_' || lang AS sample FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def names_of_files(spark: SparkSession, sf_dir: str):
    path = F.concat(F.lit("/data/"), "source", F.lit("_"), "lang", F.lit(".m16."), F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").where("source is not null and lang is not null").select(fn.name_from_path(path).alias("sample")).distinct()


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'g' || lang WHEN 1 THEN 'g' || lang WHEN 2 THEN 'g.' || lang END AS genome FROM documents WHERE lang IS NOT NULL")
def genomes_of_files(spark: SparkSession, sf_dir: str):
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat(F.lit("/x/g"), "lang", F.lit(".fa"))).when(k == 1, F.concat(F.lit("g"), "lang", F.lit(".faa.gz"))).when(k == 2, F.concat(F.lit("y/g."), "lang", F.lit(".fasta"))).otherwise(F.concat(F.lit("g"), "lang", F.lit(".txt")))
    return read(spark, sf_dir, "documents").where("lang is not null").select("doc_id", fn.genome_from_path(name).alias("genome"))


#: Records of lineitem, whose sites are those of two thirds of the positions.
_RAW = """, raw AS (SELECT sample, chrom, pos, count(*) AS n, CAST(sum(m) AS INTEGER) AS n_meth, CAST(sum(u) AS INTEGER) AS n_unmeth FROM placed GROUP BY ALL),
kept AS (SELECT chrom, pos FROM sites WHERE pos % 3 <> 0)
"""


def _aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = tables(spark, sf_dir)
    line = read(spark, sf_dir, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    n = F.col("l_quantity").cast("int")
    rows = line.select(F.lit("g1").alias("genome"), F.concat_ws("_", "l_returnflag", "l_linestatus").alias("sample"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("chrom"), (F.col("l_partkey") * 7).alias("pos"), F.when(even, n).otherwise(0).alias("n_meth"), F.when(even, 0).otherwise(n).alias("n_unmeth"), F.lit(None).cast("string").alias("error"))
    return counts.align(rows, t.sites.where("pos % 3 != 0"))


@query(SQL.rstrip() + _RAW + "SELECT r.sample, r.chrom, r.pos, n_meth, n_unmeth FROM raw r JOIN kept USING (chrom, pos) WHERE n = 1 AND n_meth + n_unmeth > 0")
def methylomes_formatted(spark: SparkSession, sf_dir: str):
    sites = tables(spark, sf_dir).sites.select("genome", "site_idx", "chrom", "pos")
    return _aligned(spark, sf_dir)[0].join(sites, ["genome", "site_idx"]).select("sample", "chrom", "pos", "n_meth", "n_unmeth")


@query(SQL.rstrip() + _RAW + "SELECT r.sample, r.chrom, r.pos, CASE WHEN s.pos IS NULL THEN 'not a site' ELSE 'repeated position' END AS error FROM raw r LEFT JOIN kept s USING (chrom, pos) WHERE s.pos IS NULL OR n > 1")
def records_rejected(spark: SparkSession, sf_dir: str):
    return _aligned(spark, sf_dir)[1].select("sample", "chrom", "pos", "error")


@query(SQL + _range_sql("ivs", "i.interval_id").replace("GROUP BY ALL", "WHERE x.sample IN ('A_F', 'R_F') GROUP BY ALL"))
def column_added(t: Tables):
    one, two = (levels.interval_levels(_ranked(t), t.methylomes, t.samples.where(F.col("sample") == s), False, t.chroms, t.prefix) for s in ("A_F", "R_F"))
    return merge.add_column(one, two)


@query(SQL + _range_sql("ivs", "i.interval_id", COVERED))
def prepared_query(t: Tables):
    """Intervals resolved once and asked of two lots of samples."""
    ranked = intervals.prepare(t.intervals, t.sites, t.chroms, t.marks)
    lots = [t.samples.where(F.col("sample").startswith("A")), t.samples.where(~F.col("sample").startswith("A"))]
    one, two = (levels.interval_cells(ranked, t.methylomes, lot, True, t.chroms, t.prefix, prepared=True) for lot in lots)
    one, two = (x.select("interval_id", F.explode("cells").alias("sample", "_sum")).select("interval_id", "sample", "_sum.*") for x in (one, two))
    return merge.add_column(one, two, checked=True)


@query(SQL + "SELECT a.sample AS a, b.sample AS b, (a.sample LIKE 'A%') = (b.sample LIKE 'A%') AS consistent FROM samples a JOIN samples b ON a.sample < b.sample")
def methylomes_consistent(t: Tables):
    totals = genome.genome_totals(t.chroms).select("genome", F.col("n_sites").alias("n_cpgs"))
    meta = t.samples.join(totals, "genome").select("sample", "genome", F.lit("1").alias("version"), F.when(F.col("sample").startswith("A"), 2).otherwise(1).alias("index_hash"), "n_cpgs")
    pairs = t.samples.select(F.col("sample").alias("a")).join(t.samples.select(F.col("sample").alias("b")), F.col("a") < F.col("b"))
    return check.consistent_pairs(meta, pairs)


@query("SELECT doc_id, coalesce(trim(text) <> '', false) AND coalesce(trim(source) <> '', false) AS valid FROM documents")
def metadata_fields_valid(spark: SparkSession, sf_dir: str):
    return read(spark, sf_dir, "documents").select("doc_id", check.metadata_valid(["text", "source"]).alias("valid"))


@query(SQL + "SELECT DISTINCT chrom AS name FROM ivs WHERE chrom IN (SELECT chrom FROM sites WHERE pos % 2 = 0)")
def catalog_listing(t: Tables):
    return catalog.listing(t.sites.where("pos % 2 = 0").select(F.col("chrom").alias("name")), t.intervals.select(F.col("chrom").alias("name")), ["name"])


@query("SELECT DISTINCT o_custkey AS sample FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def names_missing(spark: SparkSession, sf_dir: str):
    have = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("sample"))
    return catalog.missing(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample")), have, ["sample"])


@query("SELECT DISTINCT c_custkey AS sample, c_mktsegment AS genome, CAST(c_nationkey AS BIGINT) AS index_hash FROM customer JOIN orders ON c_custkey = o_custkey")
def genomes_of_samples(spark: SparkSession, sf_dir: str):
    meta = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("genome"), F.col("c_nationkey").cast("long").alias("index_hash"))
    return catalog.genome_of(meta, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample")))


@query("SELECT c_mktsegment AS \"group\", lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS accession FROM customer WHERE c_nationkey % 2 = 0")
def group_members_unknown(spark: SparkSession, sf_dir: str):
    info = read(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, "other").otherwise("g1").alias("genome"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("accession"))
    return catalog.unknown_members(catalog.make_groups(_members(spark, sf_dir)), info, "g1").select("group", "accession")


@query(SQL + "SELECT chrom, chrom_ord, pos, site_idx FROM sites JOIN chroms USING (chrom)")
def index_written(t: Tables):
    spark = t.sites.sparkSession
    path = scratch.new_folder(spark, "index")
    output.write_index(t.sites, t.chroms, path)
    return spark.read.parquet(f"{path}/sites").where("genome = 'g1'").select("chrom", "chrom_ord", "pos", "site_idx")


@query(SQL + """, ranked AS (SELECT sample, site_idx, CAST(sum(n_meth) OVER w AS BIGINT) AS n_meth, CAST(sum(n_unmeth) OVER w AS BIGINT) AS n_unmeth, CAST(sum(CASE WHEN n_meth + n_unmeth > 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_covered FROM meth WINDOW w AS (PARTITION BY sample ORDER BY site_idx))
SELECT * FROM ranked""")
def prefix_written(t: Tables):
    """The stored prefix sums of sites, without the seeds of blocks."""
    spark = t.sites.sparkSession
    path = scratch.new_folder(spark, "prefix")
    output.write_prefix(levels.prefix_sums(t.methylomes, t.chroms), path)
    return output.read_prefix(spark, path).where("rank = 1").select("sample", F.col("at").alias("site_idx"), "n_meth", "n_unmeth", "n_covered")


@query(SQL + "SELECT chrom, pos, site_idx + 1 AS before FROM sites")
def marks_written(t: Tables):
    """The stored marks of sites, without the seeds of blocks."""
    spark = t.sites.sparkSession
    path = scratch.new_folder(spark, "marks")
    output.write_marks(intervals.site_marks(t.sites, t.chroms), path)
    return output.read_marks(spark, path).where("rank = 1").select("chrom", "pos", "before")


@query(SQL + f"SELECT sample, 500 AS unit, chrom, pos // 500 AS bin, {SUM}{COVERED} FROM meth GROUP BY ALL UNION ALL SELECT sample, 10, chrom, pos // 10, {SUM}{COVERED} FROM meth GROUP BY ALL")
def pyramid_levels(t: Tables):
    return t.pyramid.levels.where("unit in (10, 500)").select("sample", "unit", "chrom", "bin", "n_meth", "n_unmeth", "n_covered")


@query(SQL + "SELECT chrom, chrom_ord, pos, site_idx FROM sites JOIN chroms USING (chrom)")
def binary_index_read(t: Tables):
    """The index written as a pair of a binary file and JSON, and read again in ranges of 4096 bytes."""
    spark = t.sites.sparkSession
    path = scratch.new_folder(spark, "binary")
    output.write_binary_index(t.sites, t.chroms, metadata.genome_metadata(t.sites, t.chroms), path)
    return src.read_index(spark, path, 4096)[0].select("chrom", "chrom_ord", "pos", "site_idx")


@query(SQL + "SELECT sample, site_idx, CAST(n_meth AS INTEGER) AS n_meth, CAST(n_unmeth AS INTEGER) AS n_unmeth FROM meth WHERE n_meth + n_unmeth > 0")
def binary_methylomes_read(t: Tables):
    """Methylomes written as pairs of binary files and JSON, and read again in ranges of 4096 bytes."""
    spark = t.sites.sparkSession
    path = scratch.new_folder(spark, "binary")
    output.write_binary_methylomes(t.methylomes, metadata.methylome_metadata(t.methylomes, metadata.genome_metadata(t.sites, t.chroms)), path)
    return src.read_methylomes(spark, path, 4096)[0].select("sample", "site_idx", "n_meth", "n_unmeth")


@query(SQL + "SELECT sample, site_idx, n_meth, n_unmeth FROM meth WHERE sample IN ('A_F', 'R_O')")
def methylomes_written(t: Tables):
    spark = t.sites.sparkSession
    path = scratch.new_folder(spark, "methylomes")
    output.write_methylomes(t.methylomes, t.samples, path)
    return spark.read.parquet(f"{path}/methylomes").where("genome = 'g1' and sample in ('A_F', 'R_O')").select("sample", "site_idx", "n_meth", "n_unmeth")


@query("SELECT CAST(c_custkey AS VARCHAR) AS experiment, c_mktsegment AS sample_name FROM customer WHERE c_nationkey = 3")
def sample_table_read(spark: SparkSession, sf_dir: str):
    path = scratch.new_folder(spark, "samples")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("experiment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("assembly"), F.col("c_mktsegment").alias("sample_name"))
    rows.write.csv(path, sep="\t", header=True)
    return src.read_sample_table(spark, path, "n3")


@query("SELECT lang AS genome, CAST(doc_id AS VARCHAR) AS accession, source AS label, 'n_chars: ' || CAST(n_chars AS VARCHAR) AS serialised FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND doc_id % 3 <> 0")
def catalog_read(spark: SparkSession, sf_dir: str):
    """The catalogue in JSON files of a thousand entries, of which a third lacks a label."""
    path = scratch.new_folder(spark, "catalog")
    docs = read(spark, sf_dir, "documents").where("lang is not null and source is not null")
    entry = F.struct(F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("label"), F.struct(F.col("n_chars").cast("string").alias("n_chars")).alias("metadata"))
    files = docs.groupBy("lang", F.expr("doc_id div 1000").alias("part")).agg(F.to_json(F.create_map("lang", F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), entry))))).alias("value"))
    files.withColumn("file", F.concat_ws("-", "lang", "part")).drop("lang", "part").write.partitionBy("file").text(path)
    return src.read_catalog(spark, f"{path}/*").select("genome", "accession", "label", catalog.metadata_text().alias("serialised"))


@query(_GROUPS)
def groups_read(spark: SparkSession, sf_dir: str):
    path = scratch.new_folder(spark, "groups")
    output.groups_json(catalog.make_groups(_members(spark, sf_dir))).select("group", F.col("json").alias("value")).write.partitionBy("group").text(path)
    return src.read_groups(spark, f"{path}/*")


@query('SELECT label, accession AS sample, CAST(row_number() OVER (PARTITION BY "group" ORDER BY label) - 1 AS INTEGER) AS col_ord FROM (' + _GROUPS + ")")
def names_read(spark: SparkSession, sf_dir: str):
    path = scratch.new_folder(spark, "names")
    output.groups_json(catalog.make_groups(_members(spark, sf_dir))).select("group", F.col("json").alias("value")).write.partitionBy("group").text(path)
    return src.read_names(spark, f"{path}/*")


@query(SQL + "SELECT 'f' || CAST(p_partkey % 100 AS VARCHAR) AS file, 'chr' || CAST(p_partkey % 6 AS VARCHAR) AS chrom, coalesce(chrom_size, 7) + p_partkey % 2 AS chrom_size, CASE WHEN chrom IS NULL THEN 'unknown chromosome' ELSE 'other size' END AS error FROM part LEFT JOIN chroms ON chrom = 'chr' || CAST(p_partkey % 6 AS VARCHAR) WHERE chrom IS NULL OR p_partkey % 2 = 1")
def header_errors(spark: SparkSession, sf_dir: str):
    t = tables(spark, sf_dir)
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("chr"), (F.col("p_partkey") % 6).cast("string")).alias("chrom"))
    size = F.coalesce("chrom_size", F.lit(7)) + F.col("p_partkey") % 2
    heads = part.join(F.broadcast(t.chroms.select("chrom", "chrom_size")), "chrom", "left").select(F.concat(F.lit("f"), (F.col("p_partkey") % 100).cast("string")).alias("file"), F.concat(F.lit("#"), "chrom", F.lit(" "), size.cast("string")).alias("value"))
    return counts.header_errors(heads, t.chroms)

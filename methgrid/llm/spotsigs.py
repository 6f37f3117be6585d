"""Document fingerprints by spot signatures.

A signature is the chain of the next two content words after an anchor; anchors are common words
and the start of the text, and words between the two that are anchors are skipped. A document's
fingerprint is its set of signatures, each hashed to 32 bits, ascending, in hexadecimal. Likeness is the Jaccard index of two sets. To find near
duplicates, fingerprints are partitioned by set length so that only neighbouring partitions can
hold a pair of the wanted likeness, candidates share a rare signature of their prefixes, and
Jaccard is computed only for pairs whose lengths allow it.

Nulls: a null text is an empty text; rows with a null ``doc_id`` come first in order. A text
without content words has an empty fingerprint: two of these have likeness 1 if
their words are the same, else 0. The next of a single document is itself. Rows with one doc_id
follow each other in the order of their texts. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

#: Common words of English, German, French and Spanish.
ANCHORS = "the of and to in is a der die das und von de la le les et el que en los".split()
#: Documents of a block in which each row sees the next one, and blocks at most.
BLOCK_ROWS, BLOCKS = 500, 16384

_ANCHORS = f"(?<= )(?:(?:{'|'.join(ANCHORS)}) )++"


def normal(text) -> F.Column:
    """Lower-case words, each with a space behind it; the text starts with a space."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def with_signatures(rows: DataFrame, text: str, sigs: str) -> DataFrame:
    """``rows`` with ``sigs``: the ascending distinct 32-bit hashes of the signatures of column ``text``.

    Anchors cut the text into runs of content words. A run's chain is its first two words, or
    its only word and the first of the next run. The runs are a column of their own, so that
    they are made once.
    """
    cut = rows.withColumn("_runs", F.filter(F.split(normal(F.col(text)), _ANCHORS), lambda r: (r != "") & (r != " ")))
    heads = cut.withColumn("_heads", F.transform("_runs", lambda r: F.substring_index(F.ltrim(r), " ", 2))).drop("_runs")
    nexts = F.slice("_heads", F.lit(2), F.size("_heads"))
    # A head of one word still ends with its space.
    whole = lambda r, s: F.when(r.endswith(" "), F.substring_index(F.concat(r, F.coalesce(s, F.lit(""))), " ", 2)).otherwise(r)
    chains = F.zip_with("_heads", nexts, lambda r, s: F.xxhash64(F.rtrim(whole(r, s))).bitwiseAND(0xFFFFFFFF))
    return heads.withColumn(sigs, F.array_sort(F.array_distinct(chains))).drop("_heads")


def fingerprint(sigs) -> F.Column:
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def likeness(a, b, same, least: float = 0.0) -> F.Column:
    """Jaccard index of two signature sets, 0 if their lengths alone rule out ``least``; ``same`` decides for empty sets."""
    long, short = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return (
        F.when(long == 0, same.cast("double"))
        .when((short == 0) | (short < long * F.lit(least)), F.lit(0.0))
        .otherwise(common / (F.size(a) + F.size(b) - common))
    )


def _bounds(docs: DataFrame) -> list[int]:
    """Ids that cut the documents into blocks of about BLOCK_ROWS."""
    n = docs.count()
    blocks = max(1, min(BLOCKS, n // BLOCK_ROWS))
    if blocks == 1:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0]
    return sorted(set(cuts or []))


def with_next(rows: DataFrame, bounds: list[int], columns: list[str]) -> DataFrame:
    """``rows`` with next_<column> of the row that follows by doc_id; the first follows the last.

    Rows are dealt to blocks of ids. The row that opens a block also goes, as a guest, to the
    block before, so that its last row sees it.
    """
    cuts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(bounds)).bit_length()))])
    at = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.coalesce(F.get(cuts, lo + s - 1) <= F.col("doc_id"), F.lit(False)), lo + s).otherwise(lo)))
    first = rows.agg(F.min(F.struct(F.col("doc_id").isNotNull().cast("int"), "doc_id"))["doc_id"].alias("id"), F.count(F.lit(1)).alias("n")).first()
    opens = F.col("doc_id").eqNullSafe(F.lit(first["id"])) | F.coalesce(F.array_contains(cuts, F.col("doc_id")), F.lit(False))
    blocks = len(bounds) + 1
    own = F.struct(F.col("_block").alias("block"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("_block") - 1, F.lit(blocks)).alias("block"), F.lit(1).alias("guest"))
    dealt = rows.withColumn("_block", at).withColumn("_to", F.explode(F.when(opens, F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("_to.block").orderBy("_to.guest", F.col("doc_id").asc_nulls_first(), "text")
    seen = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return seen.where(F.col("_to.guest") == 0).drop("_to", "_block")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs) of every row."""
    text = F.coalesce("text", F.lit(""))
    return with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), "text", "sigs")


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with their likeness to these and to the next document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    bounds = _bounds(docs)
    rows = with_next(fingerprints(docs), bounds, ["text", "sigs"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", 1, n - cut), F.substring("next_text", 1, cut))
    rows = rows.select("doc_id", "text", "sigs", "next_text", "next_sigs", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("sigs").alias("fingerprint"),
        fingerprint("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs", normal(F.col("text")) == normal(F.col("edited"))).alias("near_edited"),
        likeness("sigs", "next_sigs", normal(F.col("text")) == normal(F.col("next_text"))).alias("near_next"),
    )


def near_pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): near duplicates by fingerprint.

    members: (doc_id, fingerprint_id), equal fingerprints share one id. pairs: (a, b, likeness)
    of fingerprint ids with likeness ``least`` or more. Two sets that alike differ in length by
    ``least`` at most, so they lie in the same or in neighbouring length partitions, and share
    one of the rarest signatures: as many as leave less than ``least`` of the set.
    """
    sets = fingerprints(docs).select("doc_id", "sigs", F.md5(F.when(F.size("sigs") > 0, F.col("sigs").cast("string")).otherwise(normal(F.col("text")))).alias("fingerprint_id"))
    sets = written(sets, "spot_sets")
    distinct = sets.where(F.size("sigs") > 0).groupBy("fingerprint_id").agg(F.first("sigs").alias("sigs"))
    distinct = distinct.withColumn("len", F.size("sigs")).withColumn("part", F.floor(F.log("len") / math.log(1 / least)))
    spots = distinct.select("fingerprint_id", "len", "part", F.explode("sigs").alias("sig"))
    often = spots.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rare = Window.partitionBy("fingerprint_id").orderBy(F.coalesce("n", F.lit(1)), "sig")
    prefix = spots.join(often, "sig", "left").withColumn("nth", F.row_number().over(rare)).where((F.col("nth") <= F.col("len") - F.ceil(F.col("len") * least) + 1) & F.col("n").isNotNull())
    prefix = written(prefix.select("fingerprint_id", "len", "part", "sig"), "spot_prefixes")
    left = prefix.select("sig", F.col("fingerprint_id").alias("a"), F.col("len").alias("a_len"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = prefix.select("sig", "part", F.col("fingerprint_id").alias("b"), F.col("len").alias("b_len"))
    ordered = (F.col("a_len") < F.col("b_len")) | ((F.col("a_len") == F.col("b_len")) & (F.col("a") < F.col("b")))
    found = left.join(right, ["sig", "part"]).where(ordered & (F.col("a_len") >= F.col("b_len") * least)).select("a", "b").distinct()
    of = distinct.select("fingerprint_id", "sigs")
    both = found.join(of.toDF("a", "a_sigs"), "a").join(of.toDF("b", "b_sigs"), "b")
    pairs = both.select("a", "b", likeness("a_sigs", "b_sigs", F.lit(False), least).alias("likeness")).where(F.col("likeness") >= least)
    return pairs, sets.select("doc_id", "fingerprint_id")

"""Importance resampling of documents towards a target's distribution of hashed word runs.

A 256-byte table lower-cases A-Z and blanks every separator in a text's UTF-8 bytes, ``bytes.split``
yields the words, and ``zlib.crc32`` of a run of words seeds the checksum of the run with one word
more. Each task counts its buckets in a Counter; Spark adds up the Counters, at most ``buckets`` rows
for each task. A bucket's gain is the rounded log ratio of its smoothed shares in target and corpus; a
document's weight is the sum of its features' gains. Gumbel noise, fixed by the document's id, turns
the highest scores into a draw without replacement in proportion to the weights' exponentials.

The gains (one number for a bucket) go through the driver, as their number is fixed. Scores are ordered
by range, so no task holds them all. Texts are hashed a slice at a time, whole.

Nulls: a null or blank text has no words, features or weight and is never drawn; a null ``doc_id``
counts as an empty one in the hash and comes last among ties. Rows that share an id share their noise;
each may be drawn. An empty target or corpus has no counts, which the smoothing allows. Empty tables
give empty results; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, ordered, read_table, written

#: Lower-cases A-Z, keeps digits, a-z and all bytes of longer characters, blanks the rest.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

BUCKETS, LONGEST_RUN = 10_000, 3
#: Words that a document needs to be drawn, and the share of such documents that is drawn, in percent.
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of a text that are split at once.
SLICE = 1 << 20


def runs(data: bytes, longest: int = LONGEST_RUN) -> Iterator[tuple[int, list[int]]]:
    """(words, checksums of the runs of 1 to ``longest`` words that end in them) of each slice of a text."""
    data = data.translate(TABLE)
    tail: list[bytes] = []
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        fresh = data[at:end].split()
        at = end
        if not fresh:
            continue
        words, old = tail + fresh, len(tail)
        chained = list(map(crc32, words))
        found = chained[old:]
        spaced = [b" " + w for w in words]
        for more in range(1, longest):
            chained = list(map(crc32, spaced[more:], chained))
            found += chained[max(old - more, 0) :]
        yield len(fresh), found
        tail = words[max(len(words) - longest + 1, 0) :]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(bucket, n): features of all texts by bucket; buckets without any are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for _, hashes in runs(text.as_py() or b"", longest):
                    found.update(map(buckets.__rmod__, hashes))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], names=["bucket", "n"])

    texts = in_batches(docs.select(F.col("text").cast("binary").alias("text")))
    return texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of smoothed shares, rounded down, by bucket; from two tables of ``bucket_counts``."""
    s, t = ({r.bucket: r.n for r in x.collect()} for x in (corpus, target))
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * all_s / ((s.get(b, 0) + 1.0) * all_t))) for b in range(buckets)]


def noise(doc_id) -> int:
    """Thousandths of the Gumbel noise of an id, rounded down."""
    h = int(sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], longest: int = LONGEST_RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    buckets = len(gain)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.__getitem__
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = features = weight = 0
                for n, hashes in runs(text.as_py() or b"", longest):
                    words += n
                    features += len(hashes)
                    weight += sum(map(of, map(buckets.__rmod__, hashes)))
                rows.append((words, features, weight, weight + noise(doc_id.as_py())))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    texts = in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    return texts.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every row of ``docs``; rank is null where it isn't drawn."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    # Stored, as ordering by range reads its input twice; the row's number splits rows that tie in all else.
    rows = written(scored(docs, gain), "scored").withColumn("_short", F.col("n_words") < least_words).withColumn("_row", F.monotonically_increasing_id())
    drawn = percent * rows.where(~F.col("_short")).count() // 100
    placed = ordered(rows, ["_short", F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "_row"], "_place")
    rank = F.when(F.col("_place") < drawn, (F.col("_place") + 1).cast("long"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "n_words")


def op12_translate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weights towards the benchmark's texts, and the ranks of the twentieth that is drawn."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The same in SQL: CRC-32 by a table of 256 entries over the bytes of each distinct feature.
OP12_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, text, false AS target FROM documents UNION ALL SELECT row_number() OVER (), NULL, text, true FROM benchmark
), split AS (
  SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT r, target, unnest(list_concat(w, list_filter(list_transform(list_zip(w, w[2:]), lambda z: z[1] || ' ' || z[2]), lambda x: x IS NOT NULL), list_filter(list_transform(list_zip(w, w[2:], w[3:]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3]), lambda x: x IS NOT NULL))) AS g FROM split
), spelled AS (
  SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM runs)
), hashed AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM spelled, crc
), counted AS (
  SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM runs JOIN hashed USING (g) GROUP BY bucket
), gained AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM counted) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM counted) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counted
), weighed AS (
  SELECT r, count(*) AS n_features, sum(gain) AS weight FROM runs JOIN hashed USING (g) JOIN gained USING (bucket) WHERE NOT target GROUP BY r
), scored AS (
  SELECT s.doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM split s LEFT JOIN weighed USING (r) WHERE NOT target
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (SELECT 5 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END AS rank, n_words FROM placed
"""

"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are integers: floor(64 x) of each component. Rows are cut into blocks; each block is an
inverted index whose postings are grouped by quantised impact: segment i holds the components of
sizes 2^i to 2^(i+1) - 1. Segments are processed by descending impact, each for a block of queries
at once, and added to accumulators. What is left of a row after a segment can change its score by
the product of the query's length and the length of the row's rest at most (Cauchy-Schwarz), so
every row has a lower and an upper bound. A query stops only when few rows' upper bounds reach its
k-th lower bound; these, and only these, are scored exactly.

Every query block meets every row block, a block's best are merged by query in Spark.

Rows with a null id, a null vector, or null or non-finite components take no part; shorter
vectors count as filled with zeros. Ties go to the smaller id; rows that share the query's id
are never its candidates. Empty tables give empty results, other columns are ignored.
Of the rows that share a query's id, the one with the least vector asks. Finite components may have
any size up to 2^25; beyond that a product of two has no place in a 64-bit score, and is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, small

#: Rows of a block, and queries of one.
ROWS, QUERIES = 8192, 256


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q) with q the integer vector, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**25))
    sound = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    checked = sound.where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    q = F.when(finite, F.transform(x, lambda v: F.floor(v * 64).cast("int"))).otherwise(F.raise_error(F.lit("vector components beyond 2^25")).cast("array<int>"))
    return checked.select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of (ids, dim, matrix): up to ROWS vectors of one partition each."""

    def pack(ids: list, vectors: list) -> pa.RecordBatch:
        dim = max(map(len, vectors), default=0)
        matrix = np.zeros((len(ids), dim), np.int32)
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()]), pa.array([dim], pa.int32()), pa.array([matrix.tobytes()])], names=["ids", "dim", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            for i, v in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == ROWS:
                    yield pack(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield pack(ids, vectors)

    return rows.mapInArrow(run, "ids binary, dim int, matrix binary")


class ImpactIndex:
    """Posting segments of a block of integer vectors, by descending impact."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix.astype(np.int64)
        size = np.abs(self.matrix)
        self.largest = int(size.max(initial=0))
        self.segments: list[tuple[np.ndarray, np.ndarray]] = []
        rest = self.matrix.copy()
        for level in reversed(range(self.largest.bit_length())):
            part = np.where(size >> level == 1, self.matrix, 0)
            rest -= part
            # Sums of products below 2^24 are exact in 32 bits, below 2^53 in 64.
            self.segments.append((part, np.sqrt((rest.astype(np.float64) ** 2).sum(1))))

    def _exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products of rows; a sum that 64 bits can't hold is refused."""
        if int(np.abs(a).max(initial=0)) * self.largest * max(a.shape[1], 1) < 1 << 63:
            return (a * b).sum(1)
        return np.array([sum(map(int.__mul__, x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, ids, scores) of the k best rows for each query but rows of its own id, ties to smaller ids."""
        n, dim = self.matrix.shape
        fit = np.zeros((len(queries), dim), np.int64)
        width = min(dim, queries.shape[1])
        fit[:, :width] = queries[:, :width]
        kind = np.float32 if self.largest * int(np.abs(fit).max(initial=0)) * max(dim, 1) < 1 << 24 else np.float64
        length = np.sqrt((fit.astype(np.float64) ** 2).sum(1))
        # Sums of 64-bit floats beyond 2^53 are rounded; the bounds allow for that.
        loose = (max(dim, 1) + 2) * 2.0**-52 if kind is np.float64 else 0.0
        size = np.sqrt((self.matrix.astype(np.float64) ** 2).sum(1)) * loose
        own = query_ids[:, None] == self.ids[None, :]
        open_, acc = np.arange(len(fit)), np.zeros((len(fit), n), kind)
        pairs = []
        if n > 4 * k:
            for part, rest in self.segments:
                acc += fit[open_].astype(kind) @ part.T.astype(kind)
                slack = length[open_, None] * (rest + size)[None, :] + 0.5 * (rest[None, :] > 0)
                lower = np.where(own[open_], -np.inf, acc - slack)
                least = np.partition(lower, n - k, axis=1)[:, n - k]
                may = (acc + slack >= least[:, None]) & ~own[open_]
                done = may.sum(1) <= max(4 * k, n // 32)
                row, column = np.nonzero(may[done])
                pairs.append((open_[done][row], column))  # no other row can be among the k best
                open_, acc, may = open_[~done], acc[~done], may[~done]
                if not len(open_):
                    break
            else:
                row, column = np.nonzero(may) if self.segments else np.nonzero(~own[open_])
                pairs.append((open_[row], column))
        else:
            pairs.append(np.nonzero(~own))
        who, what = (np.concatenate(x) for x in zip(*pairs, strict=True))
        scores = np.empty(len(who), np.int64)
        for at in range(0, len(who), 100_000):
            part = slice(at, at + 100_000)
            scores[part] = self._exact(fit[who[part]], self.matrix[what[part]])
        order = np.lexsort((self.ids[what], -scores, who))
        who, what, scores = who[order], what[order], scores[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        best = nth < k
        return query_ids[who[best]], self.ids[what[best]], scores[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each row of ``queries``, both (vec_id, q)."""
    spark = vectors.sparkSession
    groups = -(-queries.count() // QUERIES)
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by_group = queries.groupBy(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(groups)).alias("group"))
    asked = by_group.agg(F.collect_list(F.struct("vec_id", "q")).alias("asked"))  # about QUERIES each
    offered = _blocks(vectors).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    pairs = offered.join(small(asked, 128), "group").select("ids", "dim", "matrix", "asked.vec_id", "asked.q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for row in range(len(batch)):
                ids, dim, raw = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                if (ids, raw) != last:
                    last = ids, raw
                    own = np.frombuffer(ids, np.int64)
                    index = ImpactIndex(own, np.frombuffer(raw, np.int32).reshape(len(own), dim))
                q_ids = batch.column(3)[row].values.to_numpy()
                lists = batch.column(4)[row].values.to_pylist()
                asked_for = np.zeros((len(lists), max(map(len, lists))), np.int64)
                for i, q in enumerate(lists):
                    asked_for[i, : len(q)] = q
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in index.search(q_ids, asked_for, k)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_score_at_a_time(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The 20 best of all embeddings for each whose id is divisible by 20."""
    vectors = quantised(read_table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0).groupBy("vec_id").agg(F.min("q").alias("q")), k)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id) a JOIN v b ON a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

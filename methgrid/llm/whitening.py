"""Whitening of embeddings by a block Jacobi-Davidson solver over matrix-free distributed products.

Vectors become integers and are stored once in blocks. Their covariance V is never formed: Spark
multiplies it with a few columns at a time, each task adding up centred rows times their projections,
``V q = sum of c (c . q) / n`` with ``c = (n x - S) / n`` from exact integers. The driver keeps a search space of
a bounded number of columns, takes Ritz pairs from it, and widens it by solutions of the projected
correction equations ``(1 - Q Q')(V - e)(1 - Q Q') t = -r``, which MINRES solves for several pairs in step, one
distributed product for each step. Leading pairs whose residuals are at double precision are locked.

Partial sums of tasks are added up in one more round of tasks before they reach the driver, which sees
vectors of the embeddings' dimension only.

Rows whose vector is null or holds null or non-finite entries are left out. A shorter vector counts as
filled up with zeros. Components beyond the covariance's rank (all vectors equal, fewer vectors than components) have no
variance: their ``whitened`` is null, ``explained`` 0, and they don't enter ``identity_error``. Entries too large for
64 bits count as the largest that fit, and a ``deviation`` that 64 bits can't hold is null. A null ``vec_id`` is kept,
repeated rows count as often as they occur. Empty tables give empty results; columns
other than ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, read_table, written

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Numbers in a stored block.
ELEMENTS = 1 << 19
#: The largest size of an entry.
LARGEST = 2.0**61

#: A residual of this part of the largest eigenvalue is at double precision.
TOLERANCE = 32 * np.finfo(float).eps
#: Steps and residual of one solution of the correction equations.
STEPS, REDUCTION = 4, 0.1
#: Rounds without a smaller residual after which rounding is taken to be all that is left, and rounds at most.
STALLED, ROUNDS = 6, 200


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, c) of the rows that take part."""
    c = F.col("embedding").cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c"))


def blocks(rows: DataFrame) -> DataFrame:
    """(ids, dim, kind, x): integer vectors of several rows as one matrix of numpy kind ``kind``."""

    def packed(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        dim = max(p.shape[1] for p in parts)
        x = np.concatenate([_widened(p, dim) for p in parts])
        kind = "<i4" if np.abs(x).max(initial=0) < 2**31 else "<i8"
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([dim], pa.int32()), pa.array([kind]), pa.array([x.astype(kind).tobytes()])], names=["ids", "dim", "kind", "x"])

    def integers(c: pa.ListArray) -> np.ndarray:
        sizes = np.diff(c.offsets.to_numpy())
        values = np.clip(np.floor(SCALE * c.flatten().to_numpy(zero_copy_only=False)), -LARGEST, LARGEST).astype(np.int64) + OFFSET
        x = np.full((len(sizes), sizes.max(initial=0)), OFFSET, np.int64)
        x[np.arange(x.shape[1]) < sizes[:, None]] = values
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            ids += batch.column(0).to_pylist()
            parts.append(integers(batch.column(1)))
            held += parts[-1].size
            if held >= ELEMENTS:
                yield packed(ids, parts)
                ids, parts, held = [], [], 0
        if ids:
            yield packed(ids, parts)

    return in_batches(rows).mapInArrow(run, "ids array<long>, dim int, kind string, x binary")


def _widened(x: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dim - x.shape[1])), constant_values=OFFSET)


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    """(ids, integer vectors of ``dim`` entries) of stored blocks."""
    for batch in batches:
        for ids, own, kind, x in zip(*batch.columns, strict=True):
            matrix = np.frombuffer(x.as_py(), kind.as_py()).astype(np.int64)
            yield ids, _widened(matrix.reshape(len(ids), own.as_py()), dim)


class Fit:
    """Vectors' number and exact sums, and products with their covariance."""

    def __init__(self, stored: DataFrame):
        """``stored``: a written table of ``blocks``."""
        self.stored = stored
        self.tasks = stored.rdd.getNumPartitions()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, totals = 0, []
            for batch in batches:
                for ids, own, kind, x in zip(*batch.columns, strict=True):
                    matrix = np.frombuffer(x.as_py(), kind.as_py()).astype(np.int64).reshape(-1, own.as_py())
                    totals += [n * OFFSET] * (matrix.shape[1] - len(totals))
                    # High and low halves, so that sums of 64-bit numbers stay exact.
                    high, low = (matrix >> 32).sum(0).tolist(), (matrix & 0xFFFFFFFF).sum(0).tolist()
                    rows = len(ids)
                    n += rows
                    totals = [t + (h << 32) + w for t, h, w in zip(totals, high + [0] * len(totals), low + [0] * len(totals), strict=False)]
                    for d in range(matrix.shape[1], len(totals)):
                        totals[d] += rows * OFFSET
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(totals)), pa.int32()), pa.array([n] * (len(totals) + 1), pa.int64()), pa.array([Decimal(t) for t in [n, *totals]], pa.decimal128(38, 0))], names=["d", "n", "total"])

        summed = stored.mapInArrow(add, "d int, n long, total decimal(38,0)").groupBy("d").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        by = {r.d: (r.n, int(r.total)) for r in summed}
        self.n = by.pop(-1, (0, 0))[0]
        self.dim = len(by)
        self.sums = [by[d][1] + (self.n - by[d][0]) * OFFSET for d in range(self.dim)]

    def centred(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A function from integer vectors to (n x - S, exact; that over n)."""
        n, sums = self.n, self.sums
        top = max(map(abs, sums), default=0)

        def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if n * int(np.abs(x).max(initial=0)) + top < 2**62:
                exact = n * x - np.array(sums, np.int64)
                return exact, exact / float(n)
            exact = n * x.astype(object) - np.array(sums, object)
            return exact, (exact / n).astype(float)

        return of

    def _added(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum over all blocks of ``part(c)``, an array of ``shape``, for the centred rows c of a block."""
        dim, centred = self.dim, self.centred()

        def one(total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], names=["part"])

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for _, x in _matrices(batches, dim):
                total += part(centred(x)[1])
            yield one(total)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield one(sum((np.frombuffer(x.as_py()).reshape(shape) for batch in batches for x in batch.column(0)), np.zeros(shape)))

        parts = self.stored.mapInArrow(multiply, "part binary")
        if self.tasks > 64:
            parts = parts.repartition(math.isqrt(self.tasks)).mapInArrow(add, "part binary")
        return sum((np.frombuffer(r.part).reshape(shape) for r in parts.collect()), np.zeros(shape))

    def product(self, q: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``q``."""
        return self._added(lambda c: c.T @ (c @ q), q.shape) / self.n

    def trace(self) -> float:
        return float(self._added(lambda c: np.array([[np.einsum("ij,ij->", c, c)]]), (1, 1))[0, 0]) / self.n

    def covariance_of(self, q: np.ndarray) -> np.ndarray:
        """The covariance of the rows' projections on the columns of ``q``."""
        k = q.shape[1]
        return self._added(lambda c: (z := c @ q).T @ z, (k, k)) / self.n


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int = STEPS, reduction: float = REDUCTION) -> np.ndarray:
    """Columns t with ``product(t)`` near ``right``, each column by its own recurrence; ``product`` is symmetric for each column."""
    size = np.linalg.norm(right, axis=0)
    safe = lambda a: np.where(a > 0, a, 1.0)
    v, v_before = right / safe(size), np.zeros_like(right)
    w, w_before, t = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    beta, rest = np.zeros_like(size), size.copy()
    cosine, sine, d_bar, epsilon = -np.ones_like(size), np.zeros_like(size), np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        y = product(v)
        alpha = (v * y).sum(0)
        y = y - alpha * v - beta * v_before
        beta = np.linalg.norm(y, axis=0)
        epsilon_before, delta, g_bar = epsilon, cosine * d_bar + sine * alpha, sine * d_bar - cosine * alpha
        epsilon, d_bar = sine * beta, -cosine * beta
        gamma = safe(np.hypot(g_bar, beta))
        cosine, sine = g_bar / gamma, beta / gamma
        w, w_before = (v - epsilon_before * w_before - delta * w) / gamma, w
        t = t + cosine * rest * w
        rest = sine * rest
        v, v_before = y / safe(beta), v
        if (rest <= reduction * size).all():
            break
    return t


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Unit columns orthogonal to those of ``against`` and to each other that span what ``new`` adds to them."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        new = new - against @ (against.T @ new)
    q, strength, _ = np.linalg.svd(new, full_matrices=False)
    q = q[:, strength > 1e-8]
    q = q - against @ (against.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors, residuals' norms) of a symmetric positive semidefinite matrix, by Jacobi-Davidson."""
    wanted = min(wanted, dim)
    rng = np.random.default_rng(seed)
    locked = np.zeros((dim, 0))
    space = _orthonormal(rng.standard_normal((dim, min(dim, 2 * wanted))), locked)
    image = product(space)
    scale, best, stalled = 0.0, np.inf, 0
    for _ in range(ROUNDS):
        h = space.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        scale = max(scale, float(values[0]))
        block = min(wanted - locked.shape[1], space.shape[1])
        rest = image[:, :block] - space[:, :block] * values[:block]
        rest = rest - locked @ (locked.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        whole = locked.shape[1] + space.shape[1] == dim
        stalled, best = (0, size[0]) if size[0] < 0.5 * best else (stalled + 1, best)
        fine = size <= (np.inf if whole or stalled >= STALLED and size[0] <= 1e-9 * scale else TOLERANCE * scale)
        done = block if fine.all() else int(np.argmin(fine))
        if done:
            locked = np.linalg.qr(np.hstack((locked, space[:, :done])))[0]
            space, image, best, stalled = space[:, done:], image[:, done:], np.inf, 0
            if locked.shape[1] == wanted:
                break
            values, rest, block = values[done:], rest[:, done:], block - done
        if space.shape[1] > max(6 * wanted, 2):
            space, image, values = space[:, : 3 * wanted], image[:, : 3 * wanted], values[: 3 * wanted]
        if block:
            q = np.hstack((locked, space[:, :block]))
            shut = lambda a: a - q @ (q.T @ a)
            corrections = minres(lambda t: shut(product(shut(t)) - values[:block] * shut(t)), shut(-rest))  # noqa: B023
        else:
            corrections = rng.standard_normal((dim, wanted - locked.shape[1]))
        held = np.hstack((locked, space))
        new = _orthonormal(corrections, held)
        if not new.shape[1] and held.shape[1] < dim:
            new = _orthonormal(rng.standard_normal((dim, 1)), held)
        if new.shape[1]:
            space, image = np.hstack((space, new)), np.hstack((image, product(new)))
    else:
        raise RuntimeError(f"{locked.shape[1]} of {wanted} components after {ROUNDS} rounds")
    image = product(locked)
    h = locked.T @ image
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = np.linalg.qr(locked @ turn)[0]
    return values, vectors, np.linalg.norm(image @ turn - vectors * np.sign((vectors * (locked @ turn)).sum(0)) * values, axis=0)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue, residual) of every sound row and component."""
    spark = vectors.sparkSession
    fit = Fit(written(blocks(sound(vectors)), "vectors"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, residual double"
    if not fit.n or not fit.dim:
        return spark.createDataFrame([], schema)
    values, axes, residuals = leading_pairs(fit.product, fit.dim, components)
    trace = fit.trace()
    # Components beyond the rank have nothing but rounding for variance.
    real = values > max(fit.dim, fit.n**0.5) * np.finfo(float).eps * max(values[0], 0.0)
    values = np.where(real, values, 0.0)
    filters = np.where(real, axes / np.sqrt(np.where(real, values, 1.0)), 0.0)
    kept = filters[:, real]
    error = float(np.abs(fit.covariance_of(kept) - np.eye(kept.shape[1])).max(initial=0.0)) if real.any() else 0.0
    count, dim, n, centred = len(values), fit.dim, fit.n, fit.centred()
    explained = values / trace if trace > 0 else np.zeros(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, dim):
            exact, c = centred(x)
            if exact.dtype != object and int(np.abs(exact).max(initial=0)) ** 2 * dim < 2**63:
                deviation = pa.array((exact**2).sum(1))
            else:
                deviation = pa.array([d if d < 2**63 else None for d in (sum(int(v) ** 2 for v in row) for row in exact.tolist())], pa.int64())
            rows = pa.array(np.repeat(np.arange(len(x)), count))
            fixed = [pa.array(np.tile(v, len(x))) for v in (explained, np.full(count, error), values, residuals)]
            shown = pa.array((c @ filters).ravel(), mask=np.tile(~real, len(x)))
            columns = [ids.values.take(rows), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * count, n)), deviation.take(rows), shown, *fixed]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return fit.stored.mapInArrow(run, schema)


def op13_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the eight leading components of their covariance, at unit variance."""
    return whiten(read_table(spark, sf_dir, "embeddings"))

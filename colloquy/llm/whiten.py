"""Embedding whitening: leading eigenvectors of the covariance by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .work import saved

#: An entry c counts as floor(64 * c) + 1000000.
SCALE, SHIFT = 64, 1_000_000


@dataclass
class Moments:
    """n: vectors; sums: exact sums of their entries less the shift, for each dimension."""

    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


@dataclass
class Model:
    """vectors: a unit eigenvector in each column; values: their eigenvalues, falling; trace: that of the covariance;
    residuals: norms of V q - e q; passes: passes over the data that were taken."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part: x is a list of floor(64 * c), the shift left out.

    Vectors that are null, empty or hold a null or a component that is not finite are dropped, and so are those of
    another length than most have and entries beyond 2 ** 45, whose products with 64 doubles do not tell apart.
    """
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("size(v) > 0")
    own = own.filter(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(1 << 45)), F.lit(False))))
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return own.filter(F.size("v") == (sizes.d if sizes else 0)).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, task, groups: int = 16) -> np.ndarray:
    """The sum over all tasks of the matrix that ``task(batches)`` makes of its partition.

    A task sends its matrix as one row; with more tasks than ``groups``, as many tasks add them up first, so no more
    than ``groups`` matrices reach the driver. They are added in the order of their partitions.
    """

    def parts(batches):
        import pyspark

        own = task(batches)
        if own is not None:
            yield pa.record_batch([pa.array([pyspark.TaskContext.get().partitionId()], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([np.ascontiguousarray(own).tobytes()], pa.binary())], names=["part", "n", "y"])

    def whole(part, n, y) -> np.ndarray:
        return sum(np.frombuffer(x).reshape(n, -1) for _, x in sorted(zip(part, y, strict=True)))

    def add(table: pa.Table) -> pa.Table:
        part, n = table["part"].to_pylist(), table["n"][0].as_py()
        return pa.table({"part": pa.array([min(part)], pa.int32()), "n": pa.array([n], pa.int32()), "y": pa.array([whole(part, n, table["y"].to_pylist()).tobytes()], pa.binary())})

    made = rows.mapInArrow(parts, "part int, n int, y binary")
    if rows.rdd.getNumPartitions() > groups:
        made = made.groupBy(F.col("part") % groups).applyInArrow(add, made.schema)
    out = made.collect()
    return whole([r.part for r in out], out[0].n, [bytes(r.y) for r in out])


def moments(xs: DataFrame) -> Moments | None:
    """Number of vectors and exact sums, a row for each dimension to the driver."""

    def sums(batches):
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                n, own = n + len(x), x.sum(0) if np.abs(x).max() < 1 << 40 else x.astype(object).sum(0)
                total = own.astype(object) if total is None else total + own
        if n:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(s) for s in total], pa.string())], names=["i", "n", "s"])

    made = xs.mapInArrow(sums, "i int, n long, s string")
    out = made.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return Moments(out[0].n, [int(r.s) for r in out]) if out else None


class Covariance:
    """The covariance of the vectors as an operator: products with a matrix, each one pass over the data."""

    def __init__(self, xs: DataFrame, own: Moments):
        self.xs, self.own, self.size, self.passes = xs, own, len(own.sums), 0

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q: every task adds up X' (X q) over its centred rows."""
        mean, spark = self.own.mean, self.xs.sparkSession
        sent = spark.sparkContext.broadcast(np.ascontiguousarray(q))

        def task(batches):
            own, total = sent.value, None
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    x = _matrix(b.slice(i, 4096)) - mean
                    part = x.T @ (x @ own)
                    total = part if total is None else total + part
            return total

        self.passes += 1
        out = _summed(self.xs, task) / self.own.n
        sent.unpersist()
        return out

    def trace(self) -> float:
        mean = self.own.mean

        def task(batches):
            total, some = 0.0, False
            for b in batches:
                if b.num_rows:
                    total, some = total + float(((_matrix(b) - mean) ** 2).sum()), True
            return np.array([[total]]) if some else None

        return float(_summed(self.xs, task)[0, 0]) / self.own.n


def _lower(v: Covariance, rng, steps: int) -> float:
    """A lower bound of the spectrum from a few Lanczos steps: the smallest Ritz value less its residual."""
    q, basis, alpha, beta = rng.normal(size=v.size), [], [], []
    for _ in range(min(steps, v.size)):
        q = q / np.linalg.norm(q)
        basis.append(q)
        w = v.times(q[:, None])[:, 0]
        alpha.append(float(q @ w))
        b = np.array(basis)
        w = w - b.T @ (b @ w)
        w = w - b.T @ (b @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        q = w
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    values, vectors = np.linalg.eigh(t)
    return max(0.0, values[0] - beta[-1] * abs(vectors[-1, 0]))


def leading(v: Covariance, k: int = 32, spare: int = 16, degree: int = 10, lanczos: int = 8, tolerance: float = 1e-13, most: int = 60, seed: int = 11) -> Model:
    """The k leading eigenpairs, or as many as the covariance has above rounding.

    A block of k + ``spare`` orthonormal columns is filtered by the Chebyshev polynomial of the given degree that is small
    on the unwanted part of the spectrum, from a bound below it up to the block's last Ritz value; every step of its
    three-term recurrence is one pass. QR and Rayleigh-Ritz follow, until each wanted pair has a residual within
    ``tolerance`` of the largest eigenvalue. Rounding may stop it before that: a round that no longer halves the residuals
    ends the search if they are within a hundred times the tolerance. After ``most`` rounds without either it raises an error.
    """
    rng, size = np.random.default_rng(seed), v.size
    trace, wide = v.trace(), min(size, k + spare)
    k = min(k, size)
    if trace == 0:
        return Model(np.zeros((size, 0)), np.zeros(0), 0.0, np.zeros(0), v.passes)
    low = _lower(v, rng, lanczos) if wide < size else 0.0
    q = np.linalg.qr(rng.normal(size=(size, wide)))[0]
    best = np.inf
    for _ in range(most):
        y = v.times(q)
        values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        wanted = np.flatnonzero(values[:k] > 1e-12 * values[0])
        residuals = np.linalg.norm(y[:, wanted] - q[:, wanted] * values[wanted], axis=0)
        worst = residuals.max() / values[0]
        if worst <= tolerance or (worst <= 100 * tolerance and worst > best / 2):
            return Model(q[:, wanted], values[wanted], trace, residuals, v.passes)
        best = min(best, worst)
        # Filter: p(V) q by p[j + 1] = 2 s (V - c) p[j] / half - s s' p[j - 1], scaled to 1 at the largest Ritz value.
        high = max(values[-1], low)
        centre, half = (high + low) / 2, max((high - low) / 2, 1e-10 * values[0])
        sigma = first = half / (values[0] - centre)
        before, now = q, (y - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            nxt = 1 / (2 / first - sigma)
            before, now = now, (v.times(now) - centre * now) * (2 * nxt / half) - (sigma * nxt) * before
            sigma = nxt
        q = np.linalg.qr(now)[0]
    raise ValueError(f"eigenvectors are not certain after {v.passes} passes: relative residual {best:.1e}")


def _identity_error(xs: DataFrame, own: Moments, model: Model) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, by one more pass."""
    mean, to = own.mean, model.vectors / np.sqrt(model.values)

    def task(batches):
        total = None
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                w = (_matrix(b.slice(i, 4096)) - mean) @ to
                part = np.vstack([w.T @ w, w.sum(0)])
                total = part if total is None else total + part
        return total

    out = _summed(xs, task) / own.n
    return float(np.abs(out[:-1] - np.outer(out[-1], out[-1]) - np.eye(len(model.values))).max())


def whiten(vectors: DataFrame, k: int = 32, spare: int = 16) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    x = floor(64 * c) + 1000000 for each entry c. Components are the covariance's unit eigenvectors by falling eigenvalue,
    k at most; those whose eigenvalue is 0 to rounding have no whitened value and are left out, so equal vectors, or a single
    one, give no rows. deviation is the exact sum of (n x - S) ** 2 over the dimensions, null where no long holds it.
    Equal eigenvalues leave their eigenvectors open: any orthonormal choice of them, one for all rows.

    Vectors that integers() drops take no part and have no rows; a null vec_id stays null, repeated rows count each and
    give rows each; an empty table gives no rows. Other columns are not read. The integers are written once to the shared
    folder; every pass reads them and sends a matrix of dimensions by k + ``spare`` to each task and back.
    """
    spark, schema = vectors.sparkSession, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    xs = saved(integers(vectors), "whiten-integers")
    own = moments(xs)
    model = leading(Covariance(xs, own), k, spare) if own else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    error, explained = _identity_error(xs, own, model), model.values / model.trace
    mean, to, n, sums, m = own.mean, model.vectors / np.sqrt(model.values), own.n, np.array(own.sums, object), len(model.values)
    small = max(map(abs, own.sums)) < 1 << 62

    def project(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                some = b.slice(i, 2048)
                x = _matrix(some)
                w = (x - mean) @ to
                off = np.abs(x).max() * float(n) + max(map(abs, own.sums))
                if small and off * off * x.shape[1] < 1 << 62:
                    deviation = ((x * n - sums.astype(np.int64)) ** 2).sum(1).tolist()
                else:
                    exact = ((x.astype(object) * n - sums) ** 2).sum(1)
                    deviation = [int(s) if s < 1 << 63 else None for s in exact]
                rows = len(x)
                yield pa.record_batch(
                    [
                        some.column("vec_id").take(pa.array(np.repeat(np.arange(rows), m))),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * m, n)),
                        pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), m))),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(rows * m, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return xs.mapInArrow(project, schema)

"""Whitening of vectors on their principal components, found by incremental eigendecomposition.

Every task keeps the spectrum of the scatter of its rows about their mean. A row is a rank-one update, centred on the mean so far: the new
eigenvalues are the roots of a secular equation, after entries that don't take part are deflated. Spectra of tasks combine in a tree: one side's
eigenvectors, scaled by the roots of their eigenvalues, and the difference of means are further rank-one updates of the other. A last pass
over all rows measures the scatter in the basis found (Rayleigh-Ritz), which takes it to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import materialized

SCALE, OFFSET = 64, 1_000_000
#: Entries of this size or more are no numbers that can be coded (they count as non-finite).
LARGEST = float(1 << 40)
#: Spectra that one task combines.
COMBINED = 16
EPS = np.finfo(float).eps


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho z z', for d strictly ascending, z without zeros and rho > 0.

    Each root is sought between its poles, as a distance from the nearer one, by a rational function with both poles; a step that
    leaves the bracket is halved. Vectors come from a z that fits the roots exactly, so they are orthogonal.
    """
    m = len(d)
    weight, upper = rho * z * z, np.append(d[1:], d[-1] + rho * (z @ z))
    gap = upper - d
    from_low = d[None, :] - d[:, None]
    at_middle = 1 + (weight / (from_low - gap[:, None] / 2)).sum(axis=1)
    right = at_middle < 0
    right[-1] = False
    delta = np.where(right[:, None], d[None, :] - upper[:, None], from_low)  # poles as seen from a root's origin
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(at_middle < 0, gap, gap / 2))
    first, second = np.where(right, -gap, 0.0), np.where(right, 0.0, gap)  # the two poles of each root
    below = np.tri(m, dtype=bool)
    mu = (low + high) / 2
    for _ in range(60):
        parts = weight / (delta - mu[:, None])
        f = 1 + parts.sum(axis=1)
        slopes = parts * parts / weight
        psi = np.where(below, slopes, 0).sum(axis=1)
        phi = slopes.sum(axis=1) - psi
        low, high = np.where(f < 0, mu, low), np.where(f < 0, high, mu)
        p, q = first - mu, second - mu
        a, b, c = (p + q) * f - p * q * (psi + phi), p * q * f, f - p * psi - q * phi
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(all="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = mu + step
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        settled = (np.abs(new - mu) <= 2 * EPS * np.abs(new)) | (np.abs(f) <= 4 * EPS * (1 + np.abs(parts).sum(axis=1)))
        mu = np.where(settled, mu, new)
        if settled.all():
            break
    to_poles = mu[:, None] - delta  # root i less pole j
    i, j = np.indices((m - 1, m))
    ratio = to_poles.copy()
    ratio[:-1] /= np.where(i < j, d[i] - d[j], d[i + 1] - d[j])  # in pairs of alike size, so that the product keeps its digits
    z_fit = np.sqrt(np.maximum(ratio.prod(axis=0) / rho, 0)) * np.sign(z)
    vectors = -z_fit / to_poles
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.where(right, upper, d) + mu, vectors.T


class Spectrum:
    """n rows, their mean, and eigenvalues (ascending) and eigenvectors (columns) of their scatter about it."""

    def __init__(self, size: int, n: int = 0, mean: np.ndarray | None = None, values: np.ndarray | None = None, vectors: np.ndarray | None = None):
        self.n = n
        self.mean = np.zeros(size) if mean is None else mean
        self.values = np.zeros(size) if values is None else values
        self.vectors = np.eye(size) if vectors is None else vectors

    def update(self, x: np.ndarray, rho: float = 1.0) -> None:
        """Add rho x x' to the scatter."""
        z, d, q = x @ self.vectors, self.values, self.vectors
        size = rho * (z @ z)
        if not size > 0:
            return
        tolerance = 8 * EPS * max(d[-1], size)
        new_group = np.append(True, np.diff(d) > tolerance)
        if not new_group.all():  # equal eigenvalues: turn their vectors so that one alone takes part
            starts = np.flatnonzero(new_group)
            for a, b in zip(starts, np.append(starts[1:], len(d))):
                if b - a > 1:
                    norm = np.copysign(np.linalg.norm(z[a:b]), z[b - 1])
                    mirror = z[a:b].copy()
                    mirror[-1] += norm
                    square = mirror @ mirror
                    if square > 0:
                        q[:, a:b] -= np.outer(q[:, a:b] @ mirror, mirror * (2 / square))
                    z[a:b] = 0
                    z[b - 1] = -norm
        active = np.flatnonzero(rho * np.abs(z) * np.sqrt(z @ z) > tolerance)
        if not len(active):
            return
        roots, turned = secular(d[active], z[active], rho)
        d[active] = roots
        q[:, active] = q[:, active] @ turned
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], q[:, order]

    def add(self, x: np.ndarray) -> None:
        """One more row."""
        self.n += 1
        off = x - self.mean
        if self.n > 1:
            self.update(off, (self.n - 1) / self.n)
        self.mean = self.mean + off / self.n

    def combine(self, other: Spectrum) -> None:
        """All rows of other."""
        if other.n == 0:
            return
        if self.n == 0:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector, value)
        off, n = other.mean - self.mean, self.n + other.n
        self.update(off, self.n * other.n / n)
        self.mean, self.n = self.mean + off * (other.n / n), n


def coded(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (floor(64 entry) + 1000000) of the rows whose vector is not null or empty and has only finite entries."""
    entries = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), entries.alias("v")).where("v is not null and size(v) > 0")
    fine = rows.where(F.forall("v", lambda e: F.coalesce(F.abs(e) < LARGEST, F.lit(False))))  # NaN is larger than any number
    return fine.select("vec_id", F.transform("v", lambda e: F.floor(e * SCALE) + OFFSET).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of x less the offset, so that few digits are lost when they are centred."""
    return column.flatten().to_numpy().reshape(-1, size) - OFFSET


def _tree(parts: DataFrame, tasks: int, combine, schema: str) -> list:
    """Rows of tasks (numbered by `part`, one or none each) combined, COMBINED at a time, till one is left; that row, or none."""
    while tasks > 1:
        tasks = -(-tasks // COMBINED)
        parts = parts.withColumn("part", F.floor(F.col("part") / COMBINED).cast("int")).groupBy("part").applyInArrow(combine, schema)
    return parts.collect()


def spectrum(fit: DataFrame, size: int) -> tuple[Spectrum, list[int]]:
    """The spectrum of all rows x of fit (materialized), and the exact sums of each dimension of x less the offset."""
    schema = "part int, n long, sums array<string>, mean array<double>, spectral_values array<double>, vectors binary"
    names = ["part", "n", "sums", "mean", "spectral_values", "vectors"]

    def row(part: int, found: Spectrum, sums: list[int]) -> list:
        return [pa.array([part], pa.int32()), pa.array([found.n], pa.int64()), pa.array([[str(s) for s in sums]]), pa.array([found.mean.tolist()]), pa.array([found.values.tolist()]), pa.array([np.ascontiguousarray(found.vectors).tobytes()], pa.binary())]

    def of(r) -> tuple[Spectrum, list[int]]:
        return Spectrum(size, r["n"], np.array(r["mean"]), np.array(r["spectral_values"]), np.frombuffer(r["vectors"]).reshape(size, size).copy()), [int(s) for s in r["sums"]]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums = Spectrum(size), [0] * size
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), size)
                sums = [a + b for a, b in zip(sums, x.sum(axis=0).tolist())]
                for v in x.astype(float):
                    found.add(v)
        if found.n:
            yield pa.RecordBatch.from_arrays(row(TaskContext.get().partitionId(), found, sums), names)

    def combine(rows: pa.Table) -> pa.Table:
        found, sums = Spectrum(size), [0] * size
        for r in sorted(rows.to_pylist(), key=lambda r: r["part"]):
            other, own = of(r)
            found.combine(other)
            sums = [a + b for a, b in zip(sums, own)]
        return pa.table(row(rows["part"][0].as_py(), found, sums), names)

    last = _tree(fit.select("x").mapInArrow(gather, schema), fit.rdd.getNumPartitions(), combine, schema)
    return of(last[0]) if last else (Spectrum(size), [0] * size)


def products(fit: DataFrame, size: int, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over all rows y = (x - mean) basis of fit: the sum of y y', and the sum of y."""
    schema, k = "part int, total binary", basis.shape[1]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            y = (_matrix(batch.column(0), size) - mean) @ basis
            total[:k] += y.T @ y
            total[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def combine(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b) for b in rows["total"].to_pylist()], axis=0)
        return pa.table([rows["part"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    total = np.frombuffer(_tree(fit.select("x").mapInArrow(gather, schema), fit.rdd.getNumPartitions(), combine, schema)[0]["total"]).reshape(k + 1, k)
    return total[:k], total[k]


def whiten(df: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and each of the first components.

    Vectors that are null or empty, or hold a null or an entry that is not finite (or not below 2**40 in size), are left out. All others must have one
    length; where they don't, the most frequent one (of ties the longest) counts and vectors of another are left out like null ones. Copies count once in
    the fit and have a row each in the result, also under one id or none. Directions in which the vectors don't vary can't be whitened and have no
    component, so there may be fewer; a table without usable vectors, or of copies of one, gives no rows. A deviation that no long can hold is null.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = coded(df, id_col, vector_col)
    sizes = usable.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return df.sparkSession.createDataFrame([], schema)
    size = sizes[0]["size"]
    usable = usable.where(F.size("x") == size)
    fit = materialized(usable.select("x").distinct())
    found, sums = spectrum(fit, size)
    n = found.n
    mean = np.array([s / n for s in sums])
    basis = np.linalg.qr(found.vectors)[0]
    scatter, _ = products(fit, size, mean, basis)
    values, turned = np.linalg.eigh(scatter / n)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], (basis @ turned)[:, order]
    trace = float(values.sum())
    k = int(min(components, np.count_nonzero(values > max(trace, 0) * size * 16 * EPS)))
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    vectors = vectors[:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    weights, explained = vectors / np.sqrt(values[:k]), values[:k] / trace
    squares, ones = products(fit, size, mean, weights)
    identity_error = float(np.abs(squares / n - np.outer(ones / n, ones / n) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), size)
            y = (x - mean) @ weights
            far = n * max(int(x.max()), -int(x.min()), 1) + max(abs(s) for s in sums)
            if size * far * far < 1 << 62:
                deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [d if d < 1 << 63 else None for d in ((n * x.astype(object) - exact) ** 2).sum(axis=1).tolist()]
            rows = len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(rows), k)))
            each = pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
            columns = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), rows), np.full(rows * k, n), each, y.ravel(), np.tile(explained, rows), np.full(rows * k, identity_error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.mapInArrow(project, schema)

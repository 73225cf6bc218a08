"""Whitened principal components of vectors: the covariance's eigenvectors by contour integration.

Components become whole numbers, floor(SCALE * c) + OFFSET.  One pass adds them up, exactly; a second one adds up the products of what is
left of them after the nearest whole number to their mean is taken off, so that products are of centred numbers and stay
exact as long as they fit.  A task hands on one row for each row of that matrix, and rows of the same number meet in one task;
only the sum, a square of the vectors' length, goes to the driver.

The spectrum is cut into intervals at gaps, found by inertia counts.  Each interval is a task of its own: solves with the
covariance at complex shifts around it project a subspace onto its eigenvectors, Rayleigh-Ritz extracts them, and their number must be
what the inertia counts say.  A third pass measures the covariance of the whitened rows.

Cases: vectors that are null, empty, or hold a null or a number that isn't finite take no part.  Vectors of each length are
a fit of their own.  Rows that are repeated or share an id, also without one, are rows of their own.  Components whose eigenvalue is
nothing but rounding (under 1e-12 of the largest) can't be whitened and aren't returned: one row alone, equal rows and empty tables give no
rows.  Components of equal eigenvalue are any orthonormal base of theirs.  A deviation that doesn't fit 64 bits is null.  Further
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _contour
from ._common import named
from ._vectors import by_length, finite, whole

SCALE, OFFSET = 64, 1_000_000


class Fit:
    """Number, sums, components (columns) and eigenvalues for the vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.centre = np.array([round_half_down(s, n) for s in sums], np.int64)
        self.left = np.array([float(s - n * int(c)) for s, c in zip(sums, self.centre, strict=True)]) / n
        self.vectors, self.values, self.trace, self.identity_error = np.zeros((len(sums), 0)), np.zeros(0), 0.0, 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers, with the whole number next to the mean taken off."""
        return x - self.centre

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (z - self.left) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, z: np.ndarray) -> list[int | None]:
        """The sums of (n * x - S)**2."""
        off = [s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)]
        most = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, off), default=0)
        if most**2 * len(off) < 2**63:
            d = self.n * z - np.array(off, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = z.astype(object) * self.n - np.array(off, object)
        return [v if v < 2**63 else None for v in (d * d).sum(axis=1).tolist()]


def round_half_down(s: int, n: int) -> int:
    return (2 * s + n - 1) // (2 * n)


def numbers(x: np.ndarray) -> np.ndarray:
    return whole(x, SCALE) + OFFSET


def _sums(rows: DataFrame) -> dict[int, Fit]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in by_length(batch, 0):
                v = numbers(x)
                narrow = int(np.abs(v).max()) * len(v) < 2**63
                own = found.setdefault(v.shape[1], [0, np.zeros(v.shape[1], object)])
                own[0] += len(v)
                own[1] = own[1] + (v if narrow else v.astype(object)).sum(axis=0).astype(object)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found.values()], pa.int64()), pa.array([[Decimal(s) for s in f[1]] for f in found.values()], pa.list_(pa.decimal128(38, 0)))], ["n", "sums"])

    each = rows.select("vector").mapInArrow(run, "n long, sums array<decimal(38,0)>").select("n", F.size("sums").alias("dim"), F.posexplode("sums").alias("place", "s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in each.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect():  # one row for each length and place
        found.setdefault(r["dim"], (r["n"], [0] * r["dim"]))[1][r["place"]] = int(r["s"])
    return {dim: Fit(n, sums) for dim, (n, sums) in found.items()}


def _products(rows: DataFrame, fits: dict[int, Fit], kind: str) -> dict[int, np.ndarray]:
    """For each length the sum of the outer products of the rows' centred numbers, or of the whitened rows."""
    shared = rows.sparkSession.sparkContext.broadcast(fits)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch, 0):
                fit = shared.value[x.shape[1]]
                z = fit.centred(numbers(x)).astype(np.float64)
                z = fit.whitened(z) if kind == "whitened" else z
                found[x.shape[1]] = found.get(x.shape[1], 0) + z.T @ z
        yield from as_rows(found)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dim, place, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found[dim, place] = found.get((dim, place), 0) + np.frombuffer(blob)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["dim", "place", "blob"])

    def as_rows(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for dim, m in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array([v.tobytes() for v in m], pa.binary())], ["dim", "place", "blob"])

    schema = "dim int, place int, blob binary"
    total: dict[int, list] = {}
    for r in rows.select("vector").mapInArrow(own, schema).repartition("dim", "place").mapInArrow(added, schema).collect():  # as many as the vectors are long
        total.setdefault(r["dim"], []).append((r["place"], np.frombuffer(r["blob"])))
    return {dim: np.array([v for _, v in sorted(m, key=lambda t: t[0])]) for dim, m in total.items()}


def _components(spark: SparkSession, covariances: dict[int, np.ndarray], most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length eigenvalues and eigenvectors: a task for each interval of a spectrum."""
    cuts = [(dim, *i) for dim, v in covariances.items() for i in _contour.intervals(v, most)]
    if not cuts:
        return {}
    shared = spark.sparkContext.broadcast(covariances)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, low, high, count in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                _, vectors = _contour.in_interval(shared.value[dim], low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.ascontiguousarray(vectors.T).tobytes()], pa.binary())], ["dim", "blob"])

    found: dict[int, list[np.ndarray]] = {}
    asked = spark.createDataFrame(cuts, "dim int, low double, high double, count int").repartition(len(cuts))
    for r in asked.mapInArrow(solve, "dim int, blob binary").collect():  # ``most`` vectors and the rest of the last interval
        found.setdefault(r["dim"], []).append(np.frombuffer(r["blob"]).reshape(-1, r["dim"]))
    out = {}
    for dim, parts in found.items():
        values, vectors = _contour.together(covariances[dim], np.concatenate(parts).T, most)
        floor = _contour.NOTHING * float(np.abs(covariances[dim]).sum(axis=1).max())
        out[dim] = values[values > floor], vectors[:, values > floor]
    return out


def fitted(rows: DataFrame, components: int) -> dict[int, Fit]:
    """The fits of (vec_id, vector), by the vectors' length; those without any variance are left out."""
    fits = _sums(rows)
    if not fits:
        return {}
    covariances = {}
    for dim, products in _products(rows, fits, "centred").items():
        v = products / fits[dim].n - np.outer(fits[dim].left, fits[dim].left)
        covariances[dim] = (v + v.T) / 2
    for dim, (values, vectors) in _components(rows.sparkSession, covariances, components).items():
        fits[dim].values, fits[dim].vectors, fits[dim].trace = values, vectors, math.fsum(np.diag(covariances[dim]))
    fits = {dim: f for dim, f in fits.items() if len(f.values)}
    if fits:
        of_length = rows.filter(F.size("vector").isin([int(d) for d in fits]))
        for dim, products in _products(of_length, fits, "whitened").items():
            fits[dim].identity_error = float(np.abs(products / fits[dim].n - np.eye(len(products))).max())
    return fits


def whiten(vectors: DataFrame, *, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    spark = vectors.sparkSession
    rows = named(vectors, id_col, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.filter(finite(F.col("vector")))
    fits = fitted(rows, components)
    if not fits:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shared = spark.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch, 1):
                fit = shared.value[x.shape[1]]
                z = fit.centred(numbers(x))
                w = fit.whitened(z)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x.shape[1], np.int32)), batch.column(0).take(pa.array(at)), pa.array(fit.deviations(z), pa.int64()), lists], ["dim", "vec_id", "deviation", "values"])

    constant = spark.createDataFrame([(d, f.n, (f.values / f.trace).tolist(), f.identity_error) for d, f in fits.items()], "dim int, n long, shares array<double>, identity_error double")
    found = rows.filter(F.size("vector").isin([int(d) for d in fits])).mapInArrow(run, "dim int, vec_id long, deviation long, values array<double>")
    out = found.join(F.broadcast(constant), "dim").select("vec_id", "n", "deviation", "identity_error", "shares", F.posexplode("values").alias("place", "whitened"))  # one row for each length
    return out.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.expr("shares[place]").alias("explained"), "identity_error")

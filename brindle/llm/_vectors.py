"""What the operators on vectors share: which ones take part, their matrices, and whole numbers of their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & (F.size(vector) > 0), F.lit(False))


def matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lengths = np.asarray(pc.list_value_length(batch.column(column)))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, matrix(batch.column(column).take(pa.array(rows)))


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), with x as double; beyond 2**62 no whole number of 64 bits is left."""
    found = np.floor(x.astype(np.float64) * scale)
    if found.size and not np.abs(found).max() < 2.0**62:
        raise ValueError("a component is too large for whole numbers of 64 bits")
    return found.astype(np.int64)


def ranges(rows: DataFrame, scale: float, vector_col: str = "vector") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors: their number, and the least and largest whole number at each place.

    A task hands on one row for each length, and the driver gets one for each length and place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in by_length(batch, 0):
                v = whole(x, scale)
                n, low, high = len(v), v.min(axis=0), v.max(axis=0)
                old = found.get(v.shape[1])
                found[v.shape[1]] = [n, low, high] if old is None else [old[0] + n, np.minimum(old[1], low), np.maximum(old[2], high)]
        if found:
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found.values()], pa.int64()), pa.array([f[1] for f in found.values()], kind), pa.array([f[2] for f in found.values()], kind)], ["n", "low", "high"])

    parts = rows.select(vector_col).mapInArrow(run, "n long, low array<bigint>, high array<bigint>")
    each = parts.select("n", F.size("low").alias("dim"), F.posexplode(F.arrays_zip("low", "high")).alias("place", "ends"))
    out: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for r in each.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.min("ends.low").alias("low"), F.max("ends.high").alias("high")).collect():
        _, low, high = out.setdefault(r["dim"], (r["n"], np.zeros(r["dim"], np.int64), np.zeros(r["dim"], np.int64)))
        low[r["place"]], high[r["place"]] = r["low"], r["high"]
    return out


def narrow(low: int, high: int, *, signed: bool) -> np.dtype:
    """The narrowest type of whole numbers that holds both."""
    for kind in ("<i1", "<i2", "<i4", "<i8") if signed else ("<u1", "<u2", "<u4", "<u8"):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return np.dtype(kind)
    raise ValueError("too large for whole numbers of 64 bits")


def blobs(x: np.ndarray, kind: np.dtype) -> pa.Array:
    """Each row's bytes."""
    x = np.ascontiguousarray(x, kind)
    step = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64) * step), pa.py_buffer(x)]).cast(pa.binary())

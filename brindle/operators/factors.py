"""Non-negative factors of a sparse matrix, its zeros included, and the topics that they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ship
from ..sources.articles import stored
from .topics import tfidf

#: Terms in one row of the sums that tasks hand on, numbers that a task works on at once, which a core's cache holds, and rows that are solved together.
IN_BLOCK, AT_ONCE, ROWS_AT_ONCE = 2_048, 1 << 16, 2_048


def descend(targets: np.ndarray, gram: np.ndarray, start: np.ndarray, l1: float, l2: float, sweeps: int, tolerance: float = 1e-7) -> np.ndarray:
    """For each row t of targets the x >= 0 with the least x G x / 2 - x t + l1 |x| + l2 |x|**2 / 2, by coordinate descent.

    A row ends by its own changes, so it doesn't matter which others it is solved with.
    """
    out = start.copy()
    for a in range(0, len(out), ROWS_AT_ONCE):
        left = np.arange(a, min(len(out), a + ROWS_AT_ONCE))
        x, t = np.asfortranarray(out[left]), np.asfortranarray(targets[left] - l1)
        for _ in range(sweeps):
            most = np.zeros(len(left))
            for j in range(gram.shape[0]):
                new = np.maximum((t[:, j] - x @ gram[:, j] + x[:, j] * gram[j, j]) / max(gram[j, j] + l2, 1e-12), 0.0)
                np.maximum(most, np.abs(new - x[:, j]), out=most)
                x[:, j] = new
            going = most > tolerance * np.maximum(1e-12, np.abs(x).max(axis=1, initial=0))
            if not going.all():
                out[left[~going]] = x[~going]
                left, x, t = left[going], np.asfortranarray(x[going]), np.asfortranarray(t[going])
            if not len(left):
                break
        out[left] = x
    return out


@dataclass
class Factors:
    """The matrix (topics, terms) of a fit, what it was fitted with, and its loss after every pass."""

    terms: list[str]
    weights: np.ndarray
    l1: float
    l2: float
    losses: list[float]

    def shares_of(self, products: np.ndarray, *, sweeps: int = 200, tolerance: float = 1e-7) -> np.ndarray:
        """The factors of rows, given their products with the topics."""
        return descend(products, self.weights @ self.weights.T, np.zeros_like(products), self.l1, self.l2, sweeps, tolerance)


def topic_count(n: int, most: int = 100) -> int:
    """How many topics a corpus of n texts has: a tenth of a small one, 20 at least."""
    return most if n >= 10_000 else min(most, max(20, n // 10))


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, weights, first place of each row) of the rows of a batch."""
    numbers, weights = batch.column("numbers"), batch.column("weights")
    ends = np.asarray(numbers.offsets)
    return numbers.flatten().to_numpy(), weights.flatten().to_numpy(), ends[:-1] - ends[0]


def _products(terms: np.ndarray, values: np.ndarray, starts: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rows times a matrix (terms, k), some at a time; rows have a term at least."""
    out, ends, a = np.empty((len(starts), right.shape[1])), np.append(starts, len(terms)), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + AT_ONCE // right.shape[1], side="right")) - 1)
        t, v = terms[ends[a] : ends[b]], values[ends[a] : ends[b]]
        out[a:b] = np.add.reduceat(right[t] * v[:, None], starts[a:b] - ends[a], axis=0)
        a = b
    return out


def _add_turned(total: np.ndarray, terms: np.ndarray, values: np.ndarray, starts: np.ndarray, r: np.ndarray) -> None:
    """Adds the turned rows times r (rows, k) to (terms, k), some cells at a time, in order of their terms."""
    order = np.argsort(terms.astype(np.uint16) if len(total) <= 1 << 16 else terms, kind="stable")  # short numbers are sorted by digits
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))[order]
    t, v = terms[order], values[order]
    step = max(1, AT_ONCE // r.shape[1])
    for a in range(0, len(t), step):
        own = t[a : a + step]
        firsts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        total[own[firsts]] += np.add.reduceat(r[row[a : a + step]] * v[a : a + step, None], firsts, axis=0)


def _sums(rows: DataFrame, n_terms: int, k: int, left: Callable, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(X'R, e) for rows X: ``left`` makes from some rows their part of R (rows, k) and of the numbers e.

    Tasks hand on blocks of terms, which meet by block; the driver gets a matrix as large as the factors.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, more, seen = np.zeros((n_terms, k)), np.zeros(extra), False
        for batch in batches:
            if len(batch):
                terms, values, starts = _rows_of(batch)
                r, e = left(terms, values, starts)
                _add_turned(total, terms, values, starts, r)
                more, seen = more + e, True
        if seen:
            yield _blocks({-1: more} | {b: total[a : a + IN_BLOCK].ravel() for b, a in enumerate(range(0, n_terms, IN_BLOCK))})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(blob)
        if total:
            yield _blocks(total)

    schema = "block int, blob binary"
    found = {r["block"]: np.frombuffer(r["blob"]) for r in rows.select("numbers", "weights").mapInArrow(own, schema).repartition("block").mapInArrow(added, schema).toArrow().to_pylist()}
    if not found:
        return np.zeros((n_terms, k)), np.zeros(extra)
    return np.concatenate([found[b] for b in range(len(found) - 1)]).reshape(n_terms, k), found[-1]


def _blocks(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["block", "blob"])


def _started(rows: DataFrame, n_terms: int, k: int, seed: int) -> np.ndarray:
    """The first topics (terms, k): the non-negative halves of the leading singular vectors, found by subspace iteration."""
    width = min(n_terms, k + 8)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_terms, width)))
    values = np.zeros(width)
    for _ in range(4):
        product, _ = _sums(rows, n_terms, width, lambda t, v, s, b=basis: (_products(t, v, s, b), 0.0), 1)
        values, turn = np.linalg.eigh(basis.T @ product)
        basis, _ = np.linalg.qr(product @ turn[:, ::-1])
    kept = min(k, width)
    product, _ = _sums(rows, n_terms, width, lambda t, v, s: (_products(t, v, s, basis), 0.0), 1)
    values, turn = np.linalg.eigh(basis.T @ product)
    right, sizes = (basis @ turn)[:, ::-1][:, :kept], np.sqrt(np.maximum(values[::-1][:kept], 1e-300))

    def halves(t, v, s):
        u = _products(t, v, s, right) / sizes
        return np.zeros((len(u), kept)), np.concatenate([(np.maximum(u, 0) ** 2).sum(axis=0), (np.minimum(u, 0) ** 2).sum(axis=0)])

    _, norms = _sums(rows, n_terms, kept, halves, 2 * kept)
    out = np.zeros((n_terms, k))
    for j in range(kept):
        v, up, down = right[:, j], np.sqrt(norms[j]), np.sqrt(norms[kept + j])
        plus, minus = np.maximum(v, 0), np.maximum(-v, 0)
        a, b = up * np.linalg.norm(plus), down * np.linalg.norm(minus)
        half, size = (plus, a) if a >= b else (minus, b)
        out[:, j] = np.sqrt(sizes[j] * size) * half / max(np.linalg.norm(half), 1e-300)
    return out


def fit(rows: DataFrame, terms: list[str], *, k: int, l1: float = 0.05, l2: float = 0.05, passes: int = 60, tolerance: float = 1e-4, seed: int = 42) -> Factors:
    """Topics H of the rows (numbers, weights) X, W H ~ X, all of them non-negative; ``numbers`` are places in ``terms``.

    Half the squared error over all cells, plus l1 times the sum and l2 / 2 times the squares of both factors, is made small in
    turns.  A row's factors need its own terms and the k x k products of the topics only, and the topics need X'W and W'W only, so cells
    that are 0 count without being stored.  A pass solves all rows and adds these up; passes end when the loss falls by less than
    ``tolerance`` of itself.
    """
    ship(rows.sparkSession)
    if not terms:
        return Factors(terms, np.zeros((k, 0)), l1, l2, [])
    h, losses = _started(rows, len(terms), k, seed), []
    for _ in range(passes):
        gram = h.T @ h

        def solve(t, v, s, gram=gram, h=h):  # tasks get the topics once and not the names of the terms
            products = _products(t, v, s, h)
            w = descend(products, gram, np.zeros_like(products), l1, l2, 40, 1e-4)
            return w, np.concatenate([(w.T @ w).ravel(), [(v * v).sum(), w.sum(), (w * w).sum()]])

        xw, e = _sums(rows, len(terms), k, solve, k * k + 3)
        ww, (xx, w1, w2) = e[: k * k].reshape(k, k), e[k * k :]
        losses.append(float(0.5 * (xx - 2 * (xw * h).sum() + (ww * gram).sum()) + l1 * (w1 + h.sum()) + l2 / 2 * (w2 + (h * h).sum())))
        if len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * losses[-2]:
            break
        h = descend(xw, ww, h, l1, l2, 20)
    return Factors(terms, h.T, l1, l2, losses)


def topics(docs: DataFrame, *, key: str, text: str, k: int | None = None, terms: int = 50_000, least: int = 5, most: float = 0.9, top: int = 20, **more) -> tuple[DataFrame, DataFrame, Factors]:
    """(key, topic, share) of every document, (topic, place, term, weight) of each topic's first terms, and the fit.

    Rows are the TF-IDF weights of words and word pairs.  A document's shares sum to 1; one without any of the terms has shares of 0.
    """
    spark, k = docs.sparkSession, k or topic_count(docs.count())
    weights = stored(tfidf(docs, key=key, text=text, least=least, most=most, terms=terms), "weights")
    names = [r["term"] for r in weights.select("term").distinct().orderBy("term").collect()]  # ``terms`` at most
    numbers = spark.createDataFrame(list(enumerate(names)), "number int, term string")
    cells = F.array_sort(F.collect_list(F.struct("number", "weight")))
    rows = weights.join(F.broadcast(numbers), "term").groupBy(key).agg(cells.alias("c")).select(key, F.col("c.number").alias("numbers"), F.col("c.weight").alias("weights"))
    rows = stored(rows, "rows")
    found = fit(rows, names, k=k, **more)
    h = np.ascontiguousarray(found.weights.T)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                w = found.shares_of(_products(*_rows_of(batch), h))
                w = w / (w.sum(axis=1, keepdims=True) + 1e-10)
                ends = pa.array(np.arange(0, w.size + 1, k, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], [key, "shares"])

    solved = rows.mapInArrow(shares, f"{key} {dict(rows.dtypes)[key]}, shares array<double>")
    none = F.array_repeat(F.lit(0.0), k)
    every = docs.select(key).join(solved, key, "left").select(key, F.posexplode(F.coalesce("shares", none)).alias("topic", "share"))
    cells = [(int(j), names[i], float(found.weights[j, i])) for j in range(k) for i in np.argsort(-found.weights[j], kind="stable")[:top] if found.weights[j, i] > 0]
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))  # ``top`` rows for each topic
    return every, spark.createDataFrame(cells, "topic int, term string, weight double").select("topic", place.alias("place"), "term", "weight"), found


def tail_only_topics(docs: DataFrame, *, key: str, text: str, k: int = 20, score: float = 0.4, top: int = 10) -> DataFrame:
    """(topic, score, sign, place, term): topics of the texts of the tails alone, all with one score and sign."""
    _, words, _ = topics(docs, key=key, text=text, k=k, terms=10_000, least=2, most=0.95, top=top)
    return words.select(F.concat(F.lit("tail_"), F.col("topic").cast("string")).alias("topic"), F.lit(score).alias("score"), F.lit(1).alias("sign"), "place", "term")

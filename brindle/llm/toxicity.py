"""Toxicity: a convolutional text classifier with hashed word embeddings, trained in numpy.

A word is a run of letters and digits.  Its vector is the sum of the rows of three hashed tables, for the whole word and
for its first four and six bytes, so that inflected forms share.  Filters over one, two and three words, their maxima
over the whole text, and a logistic layer give the score.  Training starts the first columns of the tables at the
smoothed log-odds of a hash among toxic and other documents and the rest at small random numbers, and goes on by
mini-batches; only the words at the maxima have gradients.  The score is calibrated on labelled documents that were held
back from training, and a threshold is set for each language there.

Documents for training are a bounded sample: TOXIC and CLEAN documents at most, those with the least hash of their id, and
of them as many, in the order of another hash, as have SLOT_BYTES of words.  Every document is scored over its whole text.

Cases: a null or empty text has the score of a text without words; without labels of both kinds every score is 0; with
a single label of a kind nothing is held back, the score is not calibrated and the threshold is 0.5; rows that share an id, or have none, are scored and
judged row by row; a very long text is scored whole; a label that is null isn't used; a language never seen in calibration,
or null, has the common threshold; of rows that share a labelled id one is learned from; no rows give no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import column, under_plain_names, written
from ._shingles import chunks, term_hashes

SLOTS, PREFIXES, DIM, FILTERS, WIDTHS = 1 << 17, (4, 6), 12, 8, (1, 2, 3)
TOXIC, CLEAN, EPOCHS, BATCH = 3_000, 6_000, 4, 32
#: Bytes of words (twelve each) of either kind that are brought to the driver at most.
SLOT_BYTES = 96 << 20
#: Every HOLD-th document of either kind in the sample is held back for calibration.
HOLD = 5


@dataclass
class Network:
    tables: np.ndarray  # (kinds, SLOTS + 1, DIM); the last row is what stands behind a text, all zeros
    filters: list[np.ndarray]  # (width, DIM, FILTERS)
    bias: np.ndarray  # (widths, FILTERS)
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    empty: bool = False


def term_slots(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, words) slots, and where the words of each text begin."""
    hashes, at = term_hashes(raw, offsets, PREFIXES)
    return np.stack([(h % np.uint64(SLOTS)).astype(np.int32) for h in hashes]), at


def _padded(slots: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots with one row of zeros less than the widest filter (and one at least) behind each text, and the new places."""
    pad, n = max(WIDTHS) - 1, np.diff(at)
    begin = at[:-1] + pad * np.arange(len(n))
    out = np.full((len(slots), slots.shape[1] + pad * len(n)), SLOTS, np.int32)
    out[:, np.arange(slots.shape[1]) + np.repeat(pad * np.arange(len(n)), n)] = slots
    return out, begin


def _vectors(net: Network, slots: np.ndarray) -> np.ndarray:
    return sum(net.tables[k][slots[k]] for k in range(len(slots)))


def _convolved(net: Network, vectors: np.ndarray, k: int, behind: np.ndarray) -> np.ndarray:
    """What the filters of a width find at each place; ``behind`` a text they find zeros, whatever text comes next."""
    width = WIDTHS[k]
    n = len(vectors)
    out = np.zeros((n, FILTERS), np.float32)
    for j in range(width):
        out[: n - j] += vectors[j:] @ net.filters[k][j]
    out[behind] = 0
    return out + net.bias[k]


def scores(net: Network, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The uncalibrated log-odds of each text."""
    slots, begin = _padded(slots, at)
    vectors, behind = _vectors(net, slots), slots[0] == SLOTS
    pooled = np.concatenate([np.maximum.reduceat(_convolved(net, vectors, k, behind), begin, axis=0) for k in range(len(WIDTHS))], axis=1)
    return np.maximum(pooled, 0) @ net.out + net.out_bias


def train(texts: list[np.ndarray], labels: np.ndarray, *, seed: int = 9) -> Network:
    """texts: (kinds, words) slots of each document."""
    random, kinds = np.random.default_rng(seed), 1 + len(PREFIXES)
    net = Network(
        random.normal(0, 0.02, (kinds, SLOTS + 1, DIM)).astype(np.float32),
        [random.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros((len(WIDTHS), FILTERS), np.float32),
        random.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32),
        0.0,
    )
    totals = np.array([(labels == 0).sum(), (labels == 1).sum()])
    for k in range(kinds):
        seen = np.zeros((2, SLOTS))
        for t, y in zip(texts, labels, strict=True):
            seen[y, np.unique(t[k])] += 1
        smooth = 5 / totals.min()
        net.tables[k, :SLOTS, k] = np.log((seen[1] / totals[1] + smooth) / (seen[0] / totals[0] + smooth))
        for f in range(k, FILTERS, kinds):  # some filters begin by looking at one kind of evidence each
            for w in net.filters:
                w[0, k, f] = 1.0
    net.tables[:, SLOTS] = 0
    net.out[:] = np.abs(net.out)
    squares = [np.full_like(x, 1e-6) for x in (net.tables, *net.filters, net.bias, net.out)]
    out_bias_square, rate = 1e-6, 0.05
    for _ in range(EPOCHS):
        order = random.permutation(len(texts))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            slots, begin = _padded(np.concatenate([texts[r] for r in rows], axis=1), np.concatenate([[0], np.cumsum([texts[r].shape[1] for r in rows])]))
            ends = np.append(begin[1:], slots.shape[1])
            vectors, behind = _vectors(net, slots), slots[0] == SLOTS
            places, pooled = [], []
            for k in range(len(WIDTHS)):
                c = _convolved(net, vectors, k, behind)
                where = np.stack([b + c[b:e].argmax(axis=0) for b, e in zip(begin, ends, strict=True)])
                places.append(where)
                pooled.append(np.take_along_axis(c, where, axis=0))
            h = np.maximum(np.concatenate(pooled, axis=1), 0)
            p = 1 / (1 + np.exp(-(h @ net.out + net.out_bias)))
            d = ((p - labels[rows]) / len(rows)).astype(np.float32)
            dh = d[:, None] * net.out[None, :] * (h > 0)

            def step(x: np.ndarray, square: np.ndarray, gradient: np.ndarray) -> None:
                square += gradient * gradient
                x -= rate * gradient / np.sqrt(square)

            for k, width in enumerate(WIDTHS):
                dk, filters = dh[:, k * FILTERS : (k + 1) * FILTERS], net.filters[k].copy()
                gradient = np.zeros_like(filters)
                for j in range(width):
                    at = np.where(behind[places[k]], places[k], np.minimum(places[k] + j, len(vectors) - 1))
                    gradient[j] = np.einsum("nf,nfd->df", dk, vectors[at])
                    dv = (dk[:, :, None] * filters[j].T[None, :, :]).reshape(-1, DIM)
                    for kind in range(kinds):
                        used, back = np.unique(slots[kind][at.ravel()], return_inverse=True)
                        sums = np.zeros((len(used), DIM), np.float32)
                        np.add.at(sums, back, dv)
                        sums[used == SLOTS] = 0
                        squares[0][kind, used] += sums * sums
                        net.tables[kind, used] -= rate * sums / np.sqrt(squares[0][kind, used])
                step(net.filters[k], squares[1 + k], gradient)
                step(net.bias[k], squares[-2][k], dk.sum(axis=0))
            step(net.out, squares[-1], h.T @ d)
            out_bias_square += float(d.sum()) ** 2
            net.out_bias -= rate * float(d.sum()) / out_bias_square**0.5
    return net


def calibrated(net: Network, logits: np.ndarray, labels: np.ndarray) -> Network:
    """Fits a and b of 1 / (1 + exp(-(a * logit + b))) by Newton's method, with targets drawn in from 0 and 1."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(h, x.T @ (p - goal) + 1e-3 * (ab - [1.0, 0.0])), -1, 1)
    net.scale = (max(float(ab[0]), 1e-3), float(ab[1]))
    return net


def probability(net: Network, logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.scale[0] * logits + net.scale[1], -30, 30)))


def _sampled(labels: DataFrame, where: Column | None, label_col: str) -> DataFrame:
    """(_labelled, label): at most TOXIC + CLEAN rows, one for each id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("_labelled"), F.col(label_col).cast("int").alias("label")).filter("_labelled is not null and label in (0, 1)")
    rows = rows.filter(where) if where is not None else rows
    rows = rows.groupBy("_labelled").agg(F.max("label").alias("label"))
    parts = [rows.filter(F.col("label") == y).orderBy(F.xxhash64("_labelled"), "_labelled").limit(most) for y, most in ((1, TOXIC), (0, CLEAN))]
    return parts[0].unionByName(parts[1])


def fitting(sizes: np.ndarray, most: int) -> np.ndarray:
    """Places of the documents that are learned from: each that still fits, in order, or else the shortest one."""
    taken, found = 0, []
    for i, size in enumerate(sizes.tolist()):
        if taken + size <= most:
            taken += size
            found.append(i)
    return np.array(found or np.argsort(sizes, kind="stable")[:1].tolist(), np.int64)


def fit(docs: DataFrame, labels: DataFrame, *, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = None) -> tuple[Network, dict[str | None, float]]:
    """The network, and a threshold for each language (and for None, which holds for any other).

    ``where`` is a condition on ``_labelled``, the id of a labelled row that may be used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, raw, offsets in chunks(batch.column(0)):
                slots, at = term_slots(raw, offsets)
                found += [np.ascontiguousarray(slots[:, a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], ["slots", "label", "lang", "id"])

    sample = F.broadcast(_sampled(labels, where, label_col))  # TOXIC + CLEAN rows
    lang = column(docs, lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    known = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).alias("text"), lang.alias("lang")).join(sample, F.col("id") == F.col("_labelled"))
    known = known.groupBy("id").agg(F.min(F.struct("text", "label", "lang")).alias("one")).select("one.*", "id")  # however many rows share an id
    found = written(known.select("text", "label", "lang", "id").mapInArrow(run, "slots binary, label int, lang string, id long"), "toxicity-sample")
    found = found.withColumn("order", F.xxhash64("id", "slots"))
    sizes = found.select("label", "order", F.octet_length("slots").alias("size")).toPandas().sort_values(["label", "order"])  # TOXIC + CLEAN rows of three numbers
    chosen = [(int(y), int(o)) for y, own in sizes.groupby("label") for o in own["order"].to_numpy()[fitting(own["size"].to_numpy(), SLOT_BYTES)]]
    wanted = docs.sparkSession.createDataFrame(chosen, "label int, order long").distinct()
    rows = found.join(F.broadcast(wanted), ["label", "order"], "left_semi").select("slots", "label", "lang", "id", "order").toArrow().sort_by([("id", "ascending"), ("order", "ascending")])
    texts = [np.frombuffer(x.as_buffer(), np.int32).reshape(1 + len(PREFIXES), -1) for x in rows.column("slots")]
    labels_, langs = rows.column("label").to_numpy(), rows.column("lang").to_pylist()
    of_kind = [np.flatnonzero(labels_ == y) for y in (0, 1)]
    if not all(len(x) for x in of_kind):
        return Network(np.zeros((1 + len(PREFIXES), SLOTS + 1, DIM), np.float32), [], np.zeros((0, 0)), np.zeros(0), 0.0, empty=True), {None: 0.5}
    held = np.zeros(len(texts), bool)
    if all(len(x) > 1 for x in of_kind):
        held[np.concatenate([x[::HOLD] for x in of_kind])] = True
    net = train([t for t, h in zip(texts, held, strict=True) if not h], labels_[~held])
    if not held.any():
        return net, {None: 0.5}
    logits = np.array([scores(net, t, np.array([0, t.shape[1]]))[0] for t, h in zip(texts, held, strict=True) if h])
    calibrated(net, logits, labels_[held])
    return net, thresholds(probability(net, logits), labels_[held], [x for x, h in zip(langs, held, strict=True) if h])


def thresholds(p: np.ndarray, labels: np.ndarray, langs: list[str | None], *, least: int = 20) -> dict[str | None, float]:
    """The score that tells the labelled documents of each language apart with the fewest errors, for those with ``least`` of either kind."""

    def best(p: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(p, kind="stable")
        p, y = p[order], y[order]
        errors = np.concatenate([[0], np.cumsum(y == 1)]) + ((y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)]))
        at = np.flatnonzero(errors == errors.min())
        cut = int(at[len(at) // 2])
        return float((p[max(cut - 1, 0)] + p[min(cut, len(p) - 1)]) / 2)

    langs_ = np.array([x or "" for x in langs])
    found: dict[str | None, float] = {None: best(p, labels)}
    for x in {*langs} - {None}:
        own = langs_ == x
        if (labels[own] == 1).sum() >= least and (labels[own] == 0).sum() >= least:
            found[x] = best(p[own], labels[own])
    return found


def _scored(net: Network, texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts))
    if not net.empty:
        for first, raw, offsets in chunks(texts):
            out[first : first + len(offsets) - 1] = probability(net, scores(net, *term_slots(raw, offsets)))
    return out


def with_score(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document: the calibrated probability, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size, some 20 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scored(shared.value, batch.column(1)))], ["doc_id", "score"])

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the third of all ids that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def held_out_scores(docs: DataFrame, labels: DataFrame, *, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from the rows that aren't held out."""
    net, _ = fit(docs, labels, where=~held_out(F.col("_labelled")))
    rows = with_score(docs, net)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents below the threshold of their language, all columns as they were; each row is judged for itself."""
    net, cuts = fit(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast((net, cuts))  # a fixed size, some 20 MB
    at_text, at_lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, cuts = shared.value
        for batch in batches:
            langs = batch.column(at_lang).cast(pa.string()).to_pylist()
            cut = np.array([cuts.get(x, cuts[None]) for x in langs])
            yield batch.filter(pa.array(_scored(net, batch.column(at_text)) < cut))

    return under_plain_names(docs).mapInArrow(run, under_plain_names(docs).schema).toDF(*docs.columns)

"""Quality by importance resampling: hashed n-gram models of good and of raw text, and a Gumbel top-k draw.

Both models are distributions over SLOTS hashed places of byte n-grams of the lengths in GRAMS, and over pairs of words, of
which there are two kinds, equal and unlike: words are mostly unique, but bad text repeats them.  The raw model counts
every document; the target model counts a bounded, documented sample of the documents that are labelled good.  A
document's log-weight is the mean over its n-grams of log(target / raw): how much more likely good text makes it.  The
mean, rather than the sum, keeps the length of a document out of its quality.

k documents are drawn without replacement with probabilities in proportion to the importance weights: they are the ones
with the greatest log-weight + Gumbel noise, the noise seeded by the document's id.  The weight is that of a text of
LENGTH n-grams of the document's kind, the mean times LENGTH; a whole document's own sum would count its length, mostly
more than LENGTH, as quality.  k is the number of all documents times the share that is good, calibrated on the labelled
sample: the share of documents whose log-weight is above the level that tells the labelled good and bad apart best.  The
k-th key is found by histograms, each inside the bin of the one before that holds it, so nothing is sorted or collected.

Cases: a null or empty text has no n-grams, the log-weight of the worst and is rejected; a very long text is read whole; without
labels of both kinds every document with text is kept; ties of the key are all kept; no rows give no rows; rows that share
an id, or have none, are judged one by one, and of those that share a labelled id one is learned from; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import column, few, keyed, named, wider, written
from ._shingles import chunks, mixed, word_hashes

GRAMS, SLOTS = (1, 2, 3), 1 << 14
#: Most labelled rows that are used: the ones with the least hash of their id.
LABELLED = 20_000
#: Length, in n-grams, of the text whose importance weight is taken: every document is weighed as so many of its n-grams.
LENGTH = 400.0
#: How much more the share of good documents that are lost counts than the share of bad ones that stay.
KEEP = 5
_WORST = -1e6


def _events(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram the slots of all texts, and where those of each text begin (and the last end).

    The kinds are the byte n-grams of each length and the pairs of words, of which only counts whether both are equal.
    """
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = (h[:-1] if n > 1 else h) * np.uint64(0x100000001B3) + (raw[n - 1 :].astype(np.uint64) + np.uint64(1))
        if n in GRAMS:
            slots = (mixed(h + np.uint64(n)) & np.uint64(SLOTS - 1)).astype(np.int32)
            yield _inside(slots, offsets, n)
    words, at = word_hashes(raw, offsets)
    yield _inside(SLOTS + (words[1:] == words[:-1]).astype(np.int32), at, 2)


def _inside(slots: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of n-grams that don't run over the edge of a text, and where those of each text begin."""
    sizes = np.maximum(np.diff(at) - n + 1, 0)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return slots[np.repeat(at[:-1] - begin[:-1], sizes) + np.arange(begin[-1])], begin


def _counts(texts: pa.Array) -> np.ndarray:
    total = np.zeros(SLOTS + 2, np.int64)
    for _, raw, offsets in chunks(texts):
        for slots, _ in _events(raw, offsets):
            total += np.bincount(slots, minlength=SLOTS + 2)
    return total


def corpus_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each slot occurs in all the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 2, np.int64)
        for batch in batches:
            total += _counts(batch.column(0))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["slot", "n"])

    out = np.zeros(SLOTS + 2)
    for part in named(docs, text_col).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out


def with_weight(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", out: str = "weight") -> DataFrame:
    """The documents with a further column, the mean of ``ratio`` over their n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.full(batch.num_rows, _WORST)
            for first, raw, offsets in chunks(batch.column(at)):
                sizes = np.diff(offsets)
                n_grams, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
                for slots, begin in _events(raw, offsets):
                    sums = np.concatenate([[0.0], np.cumsum(shared.value[slots], dtype=np.float64)])
                    total += sums[begin[1:]] - sums[begin[:-1]]
                    n_grams += np.diff(begin)
                weight[first : first + len(sizes)] = np.where(n_grams > 0, total / np.maximum(n_grams, 1), _WORST)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], [*batch.schema.names, out])

    return docs.mapInArrow(run, wider(docs, **{out: "double"}))


def labelled_sample(labels: DataFrame, column: str, *, most: int = LABELLED, where=None) -> DataFrame:
    """(doc_id, label): at most ``most`` labelled documents, those with the least hash of their id; one row for each id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    rows = rows.filter(where) if where is not None else rows
    return rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _level(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight from which on the labelled documents are told apart best."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order].astype(bool)
    right = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum() + KEEP * (g.sum() - np.concatenate([[0], np.cumsum(g)])) / g.sum()
    best = int(np.argmax(right))
    low, high = w[max(best - 1, 0)], w[min(best, len(w) - 1)]
    return float((low + high) / 2)


def _log_shares(counts: np.ndarray) -> np.ndarray:
    """The smoothed log-probability of each slot, of the byte n-grams and of the word pairs apart."""
    parts = [x + 0.5 for x in (counts[:SLOTS], counts[SLOTS:])]
    return np.concatenate([np.log(x / x.sum()) for x in parts])


def model(docs: DataFrame, labels: DataFrame, *, most: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """The log-ratio of target and raw text for each slot, and the log-weight that tells good documents from bad."""
    sample = F.broadcast(labelled_sample(labels, label_col, most=most).withColumnRenamed("doc_id", "_labelled"))  # ``most`` rows
    texts = docs.select(column(docs, id_col).cast("long").alias("_id"), column(docs, text_col).alias("text"))
    known = texts.join(sample, F.col("_id") == F.col("_labelled")).groupBy("_id").agg(F.min(F.struct("text", "label")).alias("one"))  # however many rows share an id
    known = written(known.select("one.*"), "labelled")  # read twice
    raw, target = corpus_counts(docs, text_col), corpus_counts(known.filter("label = 1"), "text")
    ratio = _log_shares(target) - _log_shares(raw)
    seen = with_weight(known, ratio).select("weight", "label").toArrow()  # ``most`` pairs of numbers
    w, label = seen.column("weight").to_numpy(), seen.column("label").to_numpy()
    return ratio, _level(w, label == 1) if (label == 1).any() and (label == 0).any() else _WORST / 2


def resampling(docs: DataFrame, labels: DataFrame, *, seed: int = 8, most: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", key_col: str | None = None) -> DataFrame:
    """(doc_id, weight, key, kept) of every document: whether it is among the k drawn.

    The noise of a row comes from ``key_col``, by default its id, and is handed on as ``row``.
    """
    ratio, level = model(docs, labels, most=most, id_col=id_col, text_col=text_col, label_col=label_col)
    id_ = column(docs, id_col).cast("long")
    rows = docs.select(id_.alias("doc_id"), column(docs, text_col).alias("text"), (docs[key_col] if key_col else id_).alias("row"))
    rows = _keyed(with_weight(rows, ratio), seed)
    scored = written(rows.select("doc_id", "weight", "key", "row"), "quality")  # a few numbers for each document
    least = _draw(scored, level)
    return scored.withColumn("kept", (F.col("key") >= F.lit(least)) & (F.col("weight") > _WORST))


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = F.when(F.col("weight") > _WORST, F.col("weight") * LENGTH - F.log(-F.log(uniform)))
    return rows.withColumn("key", F.coalesce(key, F.lit(float("-inf"))))


def resampled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that are drawn, all columns as they were; rows may share an id or have none, each is drawn for itself."""
    rows, key = keyed(docs, id_col)
    gone = resampling(rows, labels, id_col=id_col, key_col=key, **options).filter(~F.col("kept")).select(F.col("row").alias("_gone"))
    return rows.join(few(gone), rows[key] == gone["_gone"], "left_anti").drop(key)


def _draw(rows: DataFrame, level: float) -> float:
    """The k-th greatest key: histograms of 4096 bins, each inside the bin that holds it, until that has one key only."""
    rows = rows.filter(F.col("weight") > _WORST)
    found = rows.agg(F.count_if(F.col("weight") >= level).alias("k"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).first()
    left, low, high = found["k"], found["low"], found["high"]
    if not left or left >= found["n"]:
        return float("-inf") if left else float("inf")
    while low < high:
        place = F.least(F.floor((F.col("key") - low) / (high - low) * 4096), F.lit(4095))
        inside = rows.filter(F.col("key").between(low, high))
        bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if r["n"] >= left:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
    return low

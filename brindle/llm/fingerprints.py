"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle is hashed once.  The top bits of the hash choose one of BINS bins, and a bin keeps the least of the rest.
An empty bin takes over the value of a bin that is not: it tries bins in an order that depends on its own number only, so
two documents that fill it from the same source agree in it as often as they agree in that source.  Of each value the
BITS low-order bits are stored.  Two unlike values agree in them once in 2 ** BITS, for which the likeness is corrected.

Cases: a null or empty text, or one of white space, has no shingles: its fingerprint is all zeros and of the length of
any other; its likeness to another document without shingles is 1 and to any other 0, whatever their bits.  A text of
fewer words than a shingle is one shingle.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_name, named, ranges_for, under_plain_names, wider, written
from ._shingles import mixed, shingle_hashes, word_hashes

WIDTH, BINS, BITS = 5, 256, 4
_EMPTY = np.iinfo(np.uint64).max


def bin_values(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The least value of each bin; empty bins are filled from others, unless there are no shingles at all."""
    place, rest = (shingles >> np.uint64(40)) % np.uint64(bins), mixed(shingles)
    values = np.full(bins, _EMPTY)
    np.minimum.at(values, place.astype(np.int64), rest)
    empty = np.flatnonzero(values == _EMPTY)
    if not len(empty) or len(empty) == bins:
        return values
    full, attempt, left = values != _EMPTY, 0, empty
    while len(left):  # each empty bin's own sequence of bins, the same in every document
        attempt += 1
        source = (mixed(left.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = full[source]
        values[left[hit]] = values[source[hit]]
        left = left[~hit]
    return values


def packed(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low-order bits of the values, as bytes.

    A value is mixed with the number of its bin first: bins that were filled from the same source then don't agree by
    chance all at once.
    """
    values = mixed(values ^ mixed(np.arange(1, len(values) + 1, dtype=np.uint64)))
    low = (values[:, None] >> np.arange(bits, dtype=np.uint64)[None, :]) & np.uint64(1)
    return np.packbits(low.astype(np.uint8), axis=None)


def likeness(a: np.ndarray, b: np.ndarray, *, empty: tuple[bool, bool] = (False, False), bits: int = BITS) -> float:
    """The estimated Jaccard similarity of two packed fingerprints, corrected for chance agreement, from 0 to 1."""
    if any(empty):
        return float(all(empty))
    x, y = (np.unpackbits(v).reshape(-1, bits) for v in (a, b))
    agree, chance = float((x == y).all(axis=1).mean()), 0.5**bits
    return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


class _Print:
    __slots__ = ("bits", "empty")

    def __init__(self, words: np.ndarray, width: int):
        shingles = shingle_hashes(words, width)
        self.empty = not len(shingles)
        values = bin_values(shingles)
        self.bits = np.zeros(BINS * BITS // 8, np.uint8) if self.empty else packed(values)

    def like(self, other: _Print) -> float:
        return likeness(self.bits, other.bits, empty=(self.empty, other.empty))


def _prints(texts: list[str], width: int) -> list[_Print]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    words, at = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return [_Print(words[a:b], width) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def fingerprint(text: str | None, *, width: int = WIDTH) -> str:
    """The fingerprint of one text, in hexadecimal digits."""
    return _prints([text or ""], width)[0].bits.tobytes().hex()


def with_fingerprint(docs: DataFrame, *, width: int = WIDTH, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """The documents with their fingerprints as a further column, whose name gets underscores in front if there is one of it."""
    out, at = free_name(docs, out), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _all_prints(batch.column(at).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.bits.tobytes().hex() for p in found])], [*batch.schema.names, out])

    plain = under_plain_names(docs)
    return plain.mapInArrow(run, wider(plain, **{out: "string"})).toDF(*docs.columns, out)


def _by_bytes(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters each, so that a batch of long texts needs no more memory than another."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _all_prints(texts: list[str | None], width: int) -> list[_Print]:
    found, held, size = [], [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size > 1 << 20:
            found, held, size = found + _prints(held, width), [], 0
    return found + _prints(held, width) if held else found


def edited_text(text: str, following: str) -> str:
    """The text whose last half is replaced by as much of the beginning of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _report(pairs: list[tuple], width: int) -> pa.RecordBatch:
    """The rows of pairs ((doc_id, text, print), (text, print)) of a document and the one that follows."""
    edited = [edited_text(a[1], b[0]) for a, b in pairs]
    prints = _all_prints(edited, width)
    columns = (
        [a[0] for a, _ in pairs],
        [len(a[1]) for a, _ in pairs],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        [a[2].bits.tobytes().hex() for a, _ in pairs],
        [p.bits.tobytes().hex() for p in prints],
        [a[2].like(p) for (a, _), p in zip(pairs, prints, strict=True)],
        [a[2].like(b[1]) for a, b in pairs],
    )
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in REPORT.split(", ")])


def edit_report(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside its edited text and the document that follows in ascending id; after the last comes the first.

    Documents are dealt out by ranges of ids and sorted, which is the only shuffle; each is fingerprinted once, and so is
    its edited text.  The last document of a range waits for the first of the next range: the first and last text of each
    range are kept, and these pairs, one for each range, are reported in a second, small pass.  Rows that share an id
    follow each other, ordered by text; a null id comes first.  A single document follows itself.
    """
    rows = named(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(ranges_for(rows, F.octet_length("text")), F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("text"))
    blank = [pa.nulls(0, k) for k in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
    names = [x.split()[0] for x in REPORT.split(", ")] + ["edge", "range", "edge_id", "edge_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, waiting = TaskContext.get().partitionId(), None

        def edge(kind, doc_id, text):
            nulls = [pa.nulls(1, x.type) for x in blank]
            return pa.RecordBatch.from_arrays([*nulls, pa.array([kind]), pa.array([span]), pa.array([doc_id], pa.int64()), pa.array([text])], names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in _by_bytes(texts, 1 << 20):
                found = list(zip(ids[start:stop], texts[start:stop], _prints(texts[start:stop], width), strict=True))
                if waiting is None:
                    yield edge("first", *found[0][:2])
                run_of = found if waiting is None else [waiting, *found]
                waiting = found[-1]
                if len(run_of) > 1:
                    out = _report([(x, y[1:]) for x, y in zip(run_of, run_of[1:], strict=False)], width)
                    n = out.num_rows
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names)
        if waiting is not None:
            yield edge("last", *waiting[:2])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, following in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield _report([((doc_id, text, _prints([text], width)[0]), (following, _prints([following], width)[0]))], width)

    inner = written(dealt.mapInArrow(run, REPORT + ", edge string, range long, edge_id long, edge_text string"), "fingerprints")
    first = inner.filter("edge = 'first'").select("range", F.col("edge_text").alias("head"))
    # the range that follows a range, by number only; texts are joined to it
    order = Window.orderBy("range")
    ranges = first.select("range").withColumn("next", F.lead("range").over(order))
    ranges = ranges.withColumn("next", F.coalesce("next", F.min("range").over(Window.partitionBy())))
    last = inner.filter("edge = 'last'").select("range", "edge_id", "edge_text")
    closing = last.join(ranges, "range").join(first.withColumnRenamed("range", "next"), "next").select("edge_id", "edge_text", "head")
    report = [x.split()[0] for x in REPORT.split(", ")]
    return inner.filter("edge is null").select(*report).unionByName(closing.mapInArrow(close, REPORT))

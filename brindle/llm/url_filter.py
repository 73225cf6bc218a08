"""URL filter: rules first, and for URLs without a rule the ratio of two character language models.

Each model is a smoothed Markov chain of variable order over the bytes of a URL: the estimate at a context of k bytes is
drawn towards the one at k - 1 bytes, the less often the context was seen, the more.  One model is of the URLs that rules
allow, the other of those that rules block; all of them count, except one in CALIBRATE that is held back.  A URL's score
is the difference of its log-likelihoods divided by its length.  The threshold is the one that tells the held-back URLs
apart best, by the mean of the two classes' shares judged rightly.

The model is a table with a row for each context and each context with its next byte that occurs, known by a hash of 64
bits; it grows with the corpus and is never brought together in one place.  URLs are put into chunks of a bounded number of
bytes.  A chunk asks for the counts of the distinct contexts in it, once each, by a join, and is scored with what comes
back.  So a context that every URL has is asked for once a chunk.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule; a null or empty url has the score 0; a
very long url is a chunk of its own; where either kind of URL was never seen, every URL without a rule is allowed; repeated
rows count each time, and so do rows without an id or with a shared one; no rows give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import column, written
from ._shingles import mixed, text_bytes

ORDER, STRENGTH, CALIBRATE = 5, 2.0, 5
#: URLs of a chunk, and their bytes, of which each has some ORDER + 1 contexts.
CHUNK_URLS, CHUNK_BYTES = 4_096, 1 << 18
#: Steps between the least and the greatest held-back score in which the threshold is searched.
STEPS = 4_096

#: (verdict, host, path), the rules of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """A struct (length, rule, verdict) of the longest rule that fits, or null; of equally long rules the greater text."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length: int, rule: string, verdict: string>")


def _contexts(urls: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of each URL and its end: the keys of (context, byte) and of (context) for each order, and the URL's row."""
    raw, offsets = text_bytes(urls)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes + 1)
    first = offsets[:-1] + np.arange(len(sizes))  # of each URL, with one end sign after each URL before it
    signs = np.zeros(len(row), np.uint64)
    inside = np.ones(len(row), bool)
    inside[first + sizes] = False
    signs[inside] = raw.astype(np.uint64) + np.uint64(2)
    at = np.arange(len(row)) - first[row]
    context = np.zeros(len(row), np.uint64)
    joint, alone = [], []
    for k in range(ORDER + 1):
        if k:
            before = np.ones(len(row), np.uint64)  # before the first byte
            before[k:] = np.where(at[k:] >= k, signs[:-k], 1)
            context = mixed(context * np.uint64(257) + before + np.uint64(k))
        alone.append(mixed(context + np.uint64(k)).astype(np.int64))
        joint.append(mixed(context ^ (signs + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64))
    return np.stack(joint), np.stack(alone), row


def _in_chunks(rows: DataFrame) -> DataFrame:
    """(chunk, place, url, allowed, held): the rows with the number of their chunk and their place in it, in the order of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n, size = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            numbers, places = [], []
            for m in np.diff(text_bytes(batch.column(0))[1]).tolist():
                if n and (n == CHUNK_URLS or size + m > CHUNK_BYTES):
                    chunk, n, size = chunk + 1, 0, 0
                numbers.append(chunk)
                places.append(n)
                n, size = n + 1, size + m
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(places, pa.int64()), *batch.columns], ["chunk", "place", *batch.schema.names])

    return rows.mapInArrow(run, "chunk long, place long, url string, allowed boolean, held boolean, page_id long, host string, path string, rule string, verdict string")


def learn(urls: DataFrame) -> DataFrame:
    """(key, allowed, blocked): how often each context, and each context with its next byte, occurs in (url, allowed boolean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK_URLS):
                part = batch.slice(first, CHUNK_URLS)
                joint, alone, row = _contexts(part.column(0))
                kind = part.column(1).to_numpy(zero_copy_only=False).astype(bool)[row]
                keys, place = np.unique(np.concatenate([joint, alone]), return_inverse=True)
                kinds = np.tile(kind, (2 * (ORDER + 1), 1)).ravel()
                counts = [np.bincount(place.ravel()[kinds == k], minlength=len(keys)) for k in (True, False)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, counts)], ["key", "allowed", "blocked"])

    return urls.select("url", "allowed").mapInArrow(run, "key long, allowed long, blocked long").groupBy("key").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))


def likelihoods(counts: np.ndarray, joint: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """The log-probability of each sign, from the counts of a model at (context, byte) and at (context) of each order."""
    p = np.full(joint.shape[1], 1 / 257)
    for k in range(ORDER + 1):
        p = (counts[joint[k]] + STRENGTH * p) / (counts[alone[k]] + STRENGTH)
    return np.log(p)


def with_score(chunked: DataFrame, model: DataFrame) -> DataFrame:
    """(chunk, place, score): the log-likelihood difference of the allowed and the blocked model for each sign of the URL."""
    packed = chunked.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("url", F.lit("")).alias("url")))).alias("urls"))  # CHUNK_BYTES at most
    packed = written(packed, "url-chunks")

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                joint, alone, _ = _contexts(batch.column(1)[k].values.field("url"))
                keys = np.unique(np.concatenate([joint, alone]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), batch.column(0)[k].as_py())), pa.array(keys)], ["chunk", "key"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                urls, known = batch.column(1)[k].values, batch.column(2)[k].values
                joint, alone, row = _contexts(urls.field("url"))
                keys = known.field("key").to_numpy() if known is not None else np.zeros(0, np.int64)
                order = np.argsort(keys)
                keys, n = keys[order], len(keys)

                def place(x):
                    at = np.minimum(np.searchsorted(keys, x), max(n - 1, 0))
                    return np.where(keys[at] == x, at, n) if n else np.zeros(x.shape, np.int64)

                joint, alone = place(joint), place(alone)
                models = [np.append(known.field(c).to_numpy()[order] if n else np.zeros(0), 0.0) for c in ("allowed", "blocked")]
                gain = likelihoods(models[0], joint, alone) - likelihoods(models[1], joint, alone)
                size = np.bincount(row, minlength=len(urls))
                scores = np.where(size > 1, np.bincount(row, gain, minlength=len(urls)) / np.maximum(size, 1), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(urls), batch.column(0)[k].as_py())), urls.field("place"), pa.array(scores)], ["chunk", "place", "score"])

    asked = packed.mapInArrow(needs, "chunk long, key long").join(model, "key")
    answers = asked.groupBy("chunk").agg(F.collect_list(F.struct("key", "allowed", "blocked")).alias("known"))  # the distinct contexts of a chunk
    return packed.join(answers, "chunk", "left").select("chunk", "urls", "known").mapInArrow(score, "chunk long, place long, score double")


def threshold(scored: DataFrame) -> float:
    """The score from which on the URLs of (score, allowed) are judged best; minus infinity without URLs of both kinds."""
    ends = scored.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count_if("allowed").alias("good"), F.count_if(~F.col("allowed")).alias("bad")).first()
    if not ends["good"] or not ends["bad"]:
        return float("-inf")
    width = (ends["high"] - ends["low"]) / STEPS
    step = F.floor((F.col("score") - ends["low"]) / width).cast("int") if width > 0 else F.lit(0)
    rows = scored.groupBy(step.alias("step")).agg(F.count_if("allowed").alias("good"), F.count_if(~F.col("allowed")).alias("bad")).collect()  # STEPS + 1 rows
    good, bad = np.zeros((2, STEPS + 1))
    for r in rows:
        good[r["step"]], bad[r["step"]] = r["good"], r["bad"]
    right = good[::-1].cumsum()[::-1] / good.sum() + (bad.cumsum() - bad) / bad.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return ends["low"] + float(best[len(best) // 2]) * width


def judge(pages: DataFrame, *, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the rule that decides, or null, and ``allow`` or ``block``."""
    rows = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("url", (F.col("fit.verdict") == "allow").alias("allowed"), (F.crc32("url") % CALIBRATE == 0).alias("held"), "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))
    rows = written(_in_chunks(rows), "urls")
    model = written(learn(rows.filter("allowed is not null and not held")), "url-model")
    scores = written(with_score(rows.select("chunk", "place", "url"), model), "url-scores")
    rows = rows.drop("url").join(scores, ["chunk", "place"])
    both = model.agg(F.max("allowed").alias("a"), F.max("blocked").alias("b")).first()
    least = threshold(rows.filter("held and allowed is not null").select("score", "allowed")) if both["a"] and both["b"] else float("-inf")
    verdict = F.coalesce("verdict", F.when(F.col("score") >= F.lit(least), "allow").otherwise("block"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

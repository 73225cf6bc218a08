"""How components and topics go together: many small probes fitted at once, and the alignment of each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..sources.articles import stored
from .topics import average_ranks

#: Products of a row, a component and a topic that a task works on at once.
AT_ONCE = 1 << 19


def _soft(x: np.ndarray, least: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - least, 0.0)


def _direction(point: np.ndarray, slope: np.ndarray, bend: np.ndarray, price: float) -> np.ndarray:
    """The step to the minimum of the quadratic model plus ``price`` times the absolute values, by turns in both coordinates."""
    new, bend = point.copy(), bend + 1e-12 * np.eye(2)
    for _ in range(500):
        before = new.copy()
        for i in (0, 1):
            j = 1 - i
            free = bend[..., i, i] * point[..., i] - slope[..., i] - bend[..., i, j] * (new[..., j] - point[..., j])
            new[..., i] = _soft(free, price) / bend[..., i, i]
        if np.abs(new - before).max(initial=0) < 1e-12:
            break
    return new - point


def fit(rows: DataFrame, n_components: int, n_topics: int, *, strength: float = 0.1, passes: int = 60) -> np.ndarray:
    """(components, topics, 2): weight and constant of a logistic regression of each flag on each share.

    rows (shares, flags): the shares of all topics, and the numbers of the components whose flag is set.  The sum of the absolute values of
    weight and constant plus ``strength`` times the log-loss is least.  Every pass adds up loss, slopes and curvature of all pairs over the
    rows; the driver then takes a step for each pair, and halves one that did not lower its loss.
    """
    ship(rows.sparkSession)
    shape, price = (n_components, n_topics), 1 / strength
    base, step, size = np.zeros((*shape, 2)), np.zeros((*shape, 2)), np.ones(shape)
    best = np.full(shape, np.inf)
    slope, bend = np.zeros((*shape, 2)), np.zeros((*shape, 2, 2))
    for _ in range(passes):
        trial = base + size[..., None] * step
        loss, slopes, bends = _sums(rows, trial)
        loss = loss + price * np.abs(trial).sum(axis=-1)
        better = loss <= best
        base, best = np.where(better[..., None], trial, base), np.where(better, loss, best)
        slope, bend = np.where(better[..., None], slopes, slope), np.where(better[..., None, None], bends, bend)
        found = _direction(base, slope, bend, price)
        step, size = np.where(better[..., None], found, step), np.where(better, 1.0, size / 2)
        if (np.abs(size[..., None] * step) < 1e-10).all():
            break
    return base


def _sums(rows: DataFrame, point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-loss, slopes and curvature of all pairs at a point: one row from each task."""
    c, k, _ = point.shape

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((6, c, k)), False
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            flags = batch.column(1)
            y = np.zeros((len(x), c))
            y[np.repeat(np.arange(len(x)), np.diff(np.asarray(flags.offsets))), flags.flatten().to_numpy()] = 1
            for a in range(0, len(x), max(1, AT_ONCE // (c * k))):
                xs, ys = x[a : a + max(1, AT_ONCE // (c * k)), None, :], y[a : a + max(1, AT_ONCE // (c * k)), :, None]
                z = xs * point[..., 0] + point[..., 1]
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                off, w = p - ys, p * (1 - p)
                total += np.stack([(np.logaddexp(0, z) - ys * z).sum(0), (off * xs).sum(0), off.sum(0), (w * xs * xs).sum(0), (w * xs).sum(0), w.sum(0)])
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["one", "blob"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [np.frombuffer(b.as_py()) for batch in batches for b in batch.column(1)]
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([sum(blobs).tobytes()], pa.binary())], ["one", "blob"])

    schema = "one int, blob binary"
    parts = rows.select("shares", "flags").mapInArrow(own, schema).withColumn("one", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int"))
    found = [np.frombuffer(r["blob"]) for r in parts.repartition(16, "one").mapInArrow(added, schema).collect()]  # 16 at most
    s = sum(found, np.zeros(6 * c * k)).reshape(6, c, k)
    return s[0], np.stack([s[1], s[2]], axis=-1), np.stack([np.stack([s[3], s[4]], axis=-1), np.stack([s[4], s[5]], axis=-1)], axis=-1)


def topic_probes(tail_rows: DataFrame, shares: DataFrame, *, key: str = "id", strength: float = 0.1) -> DataFrame:
    """(component, topic, beta): the weight of each topic's share alone in a probe of each component's high tail among all rows.

    shares (key, topic, share) of all rows.  Topics that a row lacks are 0 there; components and topics are few.
    """
    spark = shares.sparkSession
    names = [r[0] for r in tail_rows.select("component").distinct().orderBy("component").collect()]
    kinds = [r[0] for r in shares.select("topic").distinct().orderBy("topic").collect()]
    if not names or not kinds:
        return tail_rows.select("component").limit(0).crossJoin(shares.select("topic").limit(0)).withColumn("beta", F.lit(0.0))
    place = {c: i for i, c in enumerate(names)}
    number = F.element_at(F.create_map(*[F.lit(v) for pair in place.items() for v in pair]), F.col("component"))
    cells = F.map_from_entries(F.collect_list(F.struct("topic", F.col("share").cast("double").alias("share"))))
    wide = shares.filter(F.col("topic").isNotNull()).groupBy(key).agg(cells.alias("m")).select(key, F.array(*[F.coalesce(F.col("m")[F.lit(t)], F.lit(0.0)) for t in kinds]).alias("shares"))
    flags = tail_rows.filter("tail = 'high'").groupBy(key).agg(F.collect_set(number).alias("flags"))
    rows = stored(wide.join(flags, key, "left").select("shares", F.coalesce("flags", F.array().cast("array<int>")).alias("flags")), "probes")
    beta = fit(rows, len(names), len(kinds), strength=strength)
    kind, name = dict(shares.dtypes)["topic"], dict(tail_rows.dtypes)["component"]
    return spark.createDataFrame([(c, t, float(beta[i, j, 0])) for i, c in enumerate(names) for j, t in enumerate(kinds)], f"component {name}, topic {kind}, beta double")


def odds(mean: Column, alpha: float) -> Column:
    return F.ln((mean + alpha) / (1 - mean + alpha))


def squashed(x: Column) -> Column:
    return F.abs(x) / (F.abs(x) + 1)


def topic_alignment(scores: DataFrame, tail_rows: DataFrame, shares: DataFrame, *, key: str = "id", alpha: float = 0.01, strength: float = 0.1) -> DataFrame:
    """(component, topic, correlation, log_odds, beta, alignment, sign, high_mean, low_mean) of each pair.

    The absolute rank correlation of scores and shares, the squashed difference of the log-odds of the tails' mean shares, the squashed weight of
    the probe, and the mean of the three.  A correlation of constants counts as 0.  The sign is 1 where the high tail has the greater mean, else -1.
    """
    ranked_scores = average_ranks(scores.select("component", key, "score"), "score", "component", "_x")
    ranked_shares = average_ranks(shares.select("topic", key, "share"), "share", "topic", "_y")
    rho = ranked_scores.join(ranked_shares, key).groupBy("component", "topic").agg(F.corr("_x", "_y").alias("rho"))
    mean = lambda tail: F.coalesce(F.avg(F.when(F.col("tail") == tail, F.col("share"))), F.lit(0.0))
    ends = tail_rows.select("component", "tail", key).join(shares, key).groupBy("component", "topic").agg(mean("high").alias("high_mean"), mean("low").alias("low_mean"))
    rows = ends.join(rho, ["component", "topic"], "left").join(topic_probes(tail_rows, shares, key=key, strength=strength), ["component", "topic"])
    correlation = F.when(F.isnan("rho"), 0.0).otherwise(F.coalesce(F.abs("rho"), F.lit(0.0)))
    rows = rows.withColumn("correlation", correlation).withColumn("log_odds", squashed(odds(F.col("high_mean"), alpha) - odds(F.col("low_mean"), alpha))).withColumn("beta", squashed(F.col("beta")))
    alignment = (F.col("correlation") + F.col("log_odds") + F.col("beta")) / 3
    return rows.select("component", "topic", "correlation", "log_odds", "beta", alignment.alias("alignment"), F.when(F.col("high_mean") > F.col("low_mean"), 1).otherwise(-1).alias("sign"), "high_mean", "low_mean")

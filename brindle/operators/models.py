"""Models on feature tables: components, topics, probes, forests, folds, evaluation and explanation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, CountVectorizerModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ship
from ..sources.articles import stored
from .quality import with_position
from .topics import _chosen, words_of  # noqa: F401  (words_of: a test counts what it cuts)
from .topics import dealt as dealt_texts
from .words import Terms, cut, slabs

#: Different rows of features up to which learners work on their sums, how many rows each must stand for, and rows that are drawn for at once.
CELLS, ROWS_A_CELL, AT_ONCE = 200_000, 10, 10_000

#: Trees that share a table.
TREES = 6


def components(vectors: DataFrame, *, k: int = 10) -> tuple[DataFrame, list[float]]:
    """(id, component, score) on centred vectors, and the share of variance of each component.

    The sign of a component is the one that makes its largest loading positive.
    """
    rows = vectors.select("id", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]
    scores = model.transform(centred).select("id", F.posexplode(vector_to_array("p")).alias("component", "score"))
    sign = F.element_at(F.array(*[F.lit(s) for s in signs]), F.col("component") + 1)
    return scores.select("id", "component", (F.col("score") * sign).alias("score")), [float(x) for x in model.explainedVariance]


def topic_count(n: int) -> int:
    return 5 if n < 100 else 10 if n < 200 else 15 if n < 500 else 20


def _counted(docs: DataFrame, *, key: str, text: str, terms: int = 500):
    """(key, counts) of every row, and the vocabulary: the ``terms`` most frequent words that are in two rows at least and in no more than 0.8 of them, ties by name.

    Tasks count words in the texts themselves and hand on those of the vocabulary; no table of all words is made.
    """
    ship(docs.sparkSession)
    rows = dealt_texts(docs.select(F.col(key).alias("key"), F.array(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("texts")))  # dealt to all cores, a file may be one partition
    rows = stored(rows, "texts")
    vocabulary = [t for t, _ in _chosen(rows, rows.count(), (), 1, least=2, most=0.8, terms=terms)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = Terms(vocabulary), pa.array(vocabulary, pa.string())
        for batch in batches:
            at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for slab, row in slabs(batch.column("texts")):
                c = cut(slab, grams=1)
                i, found = known.found(c, 1)
                at.append(row[c.text[i]])
                which.append(found)
            at, which = np.concatenate(at), np.concatenate(which)
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(batch.num_rows + 1))
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(which[order], pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("key"), words], [key, "words"])

    words = rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, words array<string>")
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="counts")
    return model.transform(words), vocabulary


def lda_topics(docs: DataFrame, *, key: str, text: str, k: int | None = None, iterations: int = 50, seed: int = 42, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, topic, share) of every document, or of those whose key is in ``only``, and (topic, place, term, weight) of the ten first terms of every topic."""
    rows, vocabulary = _counted(docs, key=key, text=text)
    rows = stored(rows.select(key, "counts"), "counted")  # as every iteration reads a part of the rows anew
    model = LDA(k=k or topic_count(docs.count()), maxIter=iterations, seed=seed, featuresCol="counts").fit(rows)
    asked = rows if only is None else rows.join(only.select(key).distinct(), key, "left_semi")
    shares = model.transform(asked).select(key, F.posexplode(vector_to_array("topicDistribution")).alias("topic", "share"))
    words = F.array(*[F.lit(w) for w in vocabulary])
    top = model.describeTopics(10).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "t"))
    return shares, top.select("topic", "place", F.element_at(words, F.col("t.termIndices") + 1).alias("term"), F.col("t.termWeights").alias("weight"))


def tail_topics(tail_rows: DataFrame, shares: DataFrame, *, key: str = "id", k: int = 5, least: float = 0.01) -> DataFrame:
    """(component, tail, topic, share, place): the topics with the greatest mean share over a tail."""
    rows = tail_rows.join(shares, key).groupBy("component", "tail", "topic").agg(F.avg("share").alias("share")).filter(F.col("share") > least)
    place = F.row_number().over(Window.partitionBy("component", "tail").orderBy(F.desc("share"), "topic"))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def assembled(df: DataFrame, features: tuple[str, ...], *, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def probe(df: DataFrame, features: tuple[str, ...], label: Column, *, c: float = 0.1) -> DataFrame:
    """(feature, coefficient): what an L1 logistic probe on standardised features keeps."""
    n = df.count()
    rows = assembled(df.withColumn("label", label.cast("double")), features, out="raw")
    model = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * n), maxIter=100)]).fit(rows)
    found = [(f, float(x)) for f, x in zip(features, model.stages[-1].coefficients.toArray(), strict=True) if x]
    return df.sparkSession.createDataFrame(found, "feature string, coefficient double")


def regressor(kind: str = "forest", *, seed: int = 42):
    """A random forest of 100 trees, or boosted trees, both of depth 10 and 5."""
    if kind == "forest":
        return RandomForestRegressor(numTrees=100, maxDepth=10, seed=seed, labelCol="target")
    if kind == "boosted":
        return GBTRegressor(maxIter=50, maxDepth=5, seed=seed, labelCol="target")
    raise ValueError(f"unknown model: {kind}")


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt to a partition for each core at least: tree learners keep the partitions of their input for every level, and a small file is one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fit(df: DataFrame, features: tuple[str, ...], *, kind: str = "forest", model=None) -> PipelineModel:
    """A model of ``target``.  Where many rows have the same features, trees grow on sums of such rows.

    Rows of equal features are never split, so their weight and their mean target give every split the gain, and every leaf the mean, that the rows
    themselves give.  A forest draws rows, so each of its trees has its own sums.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    df = df.select(*features, "target")
    if model is None:
        whole = F.count("*") == F.count("target")  # a null target is an error as it is for rows
        cells = stored(df.groupBy(*features).agg(F.when(whole, F.avg("target")).alias("target"), F.count("*").cast("double").alias("weight")), "cells")
        n = cells.agg(F.count("*").alias("cells"), F.sum("weight").alias("rows")).first()
        if 0 < n["cells"] <= min(CELLS, n["rows"] / ROWS_A_CELL):
            learner = regressor(kind)
            if kind == "forest":
                return PipelineModel([assembler, _forests(df, features, learner)[0]])
            return Pipeline(stages=[assembler, learner.setWeightCol("weight")]).fit(dealt(cells))
    return Pipeline(stages=[assembler, model or regressor(kind)]).fit(dealt(df))


def predicted(model: PipelineModel, df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """The rows with their ``prediction``, asked for once for each row of features where these are few."""
    cells = stored(df.select(*features).distinct(), "asked")
    if not 0 < cells.count() <= CELLS:
        return model.transform(df)
    return df.join(F.broadcast(model.transform(cells).select(*features, "prediction")), list(features))


def drawn(df: DataFrame, features: tuple[str, ...], *, trees: int, seed: int = 42, forests: dict[int, list[int]] | None = None) -> DataFrame:
    """(features…, w0, y0, w1, …): how often the rows of equal features are drawn for each tree, and the mean target of what is drawn.

    ``forests`` names the folds on which each of several forests is trained; the rows begin with the forest's number then.  A row is drawn
    once for a place of a tree, in whatever forests it is.

    Every row is drawn as often as a Poisson number of mean 1 says, by a generator for each row of features, over the targets in order: neither the
    partitions nor the order of the rows matter.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, draws, total, width = None, None, None, len(features)
        trained = np.zeros((len(forests), max(map(max, forests.values()), default=0) + 1)) if forests else np.ones((1, 1))
        for i, folds in enumerate((forests or {}).values()):
            trained[i, folds] = 1

        def done(keys: list, totals: list) -> pa.RecordBatch:
            k, (w, s) = np.array(keys), np.moveaxis(np.tensordot(np.stack(totals), trained, (1, 1)), 3, 1).reshape(-1, 2, trees).swapaxes(0, 1)
            k = np.repeat(k, len(trained), axis=0)
            if forests:
                k = np.column_stack([np.tile(list(forests), len(keys)), k])
            y = np.divide(s, w, out=np.zeros_like(s), where=w > 0)
            return pa.RecordBatch.from_arrays([*[pa.array(c) for c in k.T], *[pa.array(c) for pair in zip(w.T, y.T, strict=True) for c in pair]], names)

        keys, totals = [], []
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if not len(x):
                continue
            fold = x[:, width].astype(int) if forests else np.zeros(len(x), int)
            starts = np.flatnonzero(np.append(True, (x[1:, :-1] != x[:-1, :-1]).any(axis=1)))
            for a, b in zip(starts, np.append(starts[1:], len(x)), strict=True):
                if key is None or (x[a, :width] != key).any():
                    if key is not None:
                        keys.append(key)
                        totals.append(total)
                    key, total = x[a, :width].copy(), np.zeros((trained.shape[1], 2, trees))
                    draws = np.random.default_rng([seed, zlib.crc32(key.tobytes()), zlib.adler32(key.tobytes())])
                for i in range(a, b, AT_ONCE):
                    y = x[i : min(b, i + AT_ONCE), -1]
                    n = draws.poisson(1.0, (len(y), trees))
                    if fold[a] < len(total):  # the last fold of all may train none
                        total[fold[a]] += np.stack([n.sum(axis=0), y @ n])
            if len(keys) >= 1_000:
                yield done(keys, totals)
                keys, totals = [], []
        if key is not None:
            yield done([*keys, key], [*totals, total])

    names = [*["forest"][: bool(forests)], *features, *[f"{c}{t}" for t in range(trees) for c in "wy"]]
    by = (*features, "fold") if forests else features
    rows = df.select(*[(F.col(c).cast("double") + 0.0).alias(c) for c in (*by, "target")])
    return rows.repartition(*features).sortWithinPartitions(*by, "target").mapInArrow(sums, ", ".join(f"`{c}` double" for c in names))


def _forests(df: DataFrame, features: tuple[str, ...], learner: RandomForestRegressor, forests: dict[int, list[int]] | None = None) -> list[RandomForestRegressionModel]:
    """The learner's forest, or one for each of ``forests``, each tree grown on its own draw of rows.

    A tree's table has CELLS rows at most.  A few trees share one, so that tables and trees lie on all executors, and those of all forests grow beside each other.
    """
    spark, trees, seed = df.sparkSession, learner.getNumTrees(), learner.getSeed()
    table = stored(drawn(df, features, trees=trees, seed=seed, forests=forests), "drawn")
    subset = learner.getFeatureSubsetStrategy()
    one = learner.copy().setNumTrees(1).setBootstrap(False).setFeatureSubsetStrategy("onethird" if subset == "auto" else subset).setWeightCol("weight").setLabelCol("target")

    def grown(part: tuple[int | None, range]) -> list[RandomForestRegressionModel]:
        f, places = part
        own = table if f is None else table.filter(F.col("forest") == f)
        own = assembled(own.select(*features, *[f"{c}{t}" for t in places for c in "wy"]), features).drop(*features).coalesce(1).persist()  # every tree reads it a few times
        rows = [own.filter(F.col(f"w{t}") > 0).select("features", F.col(f"w{t}").alias("weight"), F.col(f"y{t}").alias("target")) for t in places]
        models = [one.copy().setSeed(seed + t).fit(r) for t, r in zip(places, rows, strict=True)]
        own.unpersist()
        return models

    cores = spark.sparkContext.defaultParallelism
    parts = [(f, range(a, min(trees, a + TREES))) for f in (forests or [None]) for a in range(0, trees, TREES)]
    with ThreadPool(min(32, 2 * cores, len(parts))) as pool:
        found = pool.map(grown, parts, chunksize=1)
    jvm = spark.sparkContext._jvm.org.apache.spark.ml.regression
    out = []
    for f in forests or [None]:
        models = [m for (g, _), some in zip(parts, found, strict=True) if g == f for m in some]
        array = spark.sparkContext._gateway.new_array(jvm.DecisionTreeRegressionModel, trees)
        for t, model in enumerate(models):
            array[t] = model._java_obj.trees()[0]
        out.append(learner._copyValues(RandomForestRegressionModel(jvm.RandomForestRegressionModel(array, len(features)))))
    return out


def regression_metrics(predicted: DataFrame, *, actual: str = "target", prediction: str = "prediction", epsilon: float = 1e-10) -> DataFrame:
    """One row: root mean squared and mean absolute error, R² and the mean absolute error in per cent."""
    e = F.col(prediction) - F.col(actual)
    return predicted.agg(
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.round(1 - F.try_divide(F.sum(e * e), F.var_pop(actual) * F.count(actual)), 6).alias("r2"),
        F.round(F.avg(F.abs(e) / (F.abs(actual) + epsilon)) * 100, 6).alias("mape"),
    )


def evaluate(predicted: DataFrame, *, kind: str = "regression") -> dict[str, float]:
    if kind == "regression":
        return {m: RegressionEvaluator(labelCol="target", metricName=m).evaluate(predicted) for m in ("mse", "mae", "r2")}
    return {m: MulticlassClassificationEvaluator(labelCol="target", metricName=m).evaluate(predicted) for m in ("accuracy", "f1")}


def label_metrics(predicted: DataFrame, *, actual: str = "target", prediction: str = "prediction") -> DataFrame:
    """One row: the share of right labels, and the mean F1 of the labels weighted by their rows; null labels are left out."""
    rows = predicted.select(F.col(actual).cast("string").alias("a"), F.col(prediction).cast("string").alias("p")).filter("a is not null")
    cells = rows.groupBy("a", "p").agg(F.count("*").alias("n"))  # pairs of labels
    sums = cells.groupBy("a").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    said = cells.filter("p is not null").groupBy(F.col("p").alias("a")).agg(F.sum("n").alias("said"))
    each = sums.join(said, "a", "left").withColumn("f1", 2 * F.col("hits") / (F.col("rows") + F.coalesce("said", F.lit(0))))
    return each.agg(F.round(F.sum("hits") / F.sum("rows"), 6).alias("accuracy"), F.round(F.sum(F.col("f1") * F.col("rows")) / F.sum("rows"), 6).alias("f1"))


def time_folds(df: DataFrame, *order: str, k: int = 5) -> DataFrame:
    """The rows with ``fold``: the last k blocks of ⌊n / (k + 1)⌋ rows in order are tested in turn, on all rows before; the first block is 0."""
    n = df.count()
    size = n // (k + 1)
    first = n - k * size
    fold = F.when(F.col("position") < first, 0).otherwise(F.floor((F.col("position") - first) / max(size, 1)) + 1)
    return with_position(df, *order).withColumn("fold", fold.cast("int")).drop("position")


def shuffled_folds(df: DataFrame, key: str, *, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds 1 … k by a seeded hash of the key."""
    return df.withColumn("fold", (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)) + 1).cast("int"))


def stratified_folds(df: DataFrame, label: str, key: str, *, k: int = 5) -> DataFrame:
    """Folds 1 … k in turn within each label; a label's rows are dealt in groups, so that no task holds all of a common one."""
    group = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 64
    w = Window.partitionBy(label, group).orderBy(key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1 + group) % k + 1).cast("int"))


def cross_validated(df: DataFrame, features: tuple[str, ...], *, expanding: bool, kind: str = "forest", model=None) -> DataFrame:
    """(fold, rmse, mae, r2, mape) of a frame with folds: trained on earlier folds (expanding) or on all others.

    Where many rows have the same features, forests of all folds are drawn in one pass and grow beside each other, as ``fit`` grows one.
    """
    df = stored(dealt(df.select("fold", *features, "target")), "folds")
    every = sorted(r["fold"] for r in df.select("fold").distinct().collect())  # k numbers, and 0
    trained = {f: [x for x in every if (x < f if expanding else x != f)] for f in every if f > 0}
    grown = {}
    if kind == "forest" and model is None and trained and all(trained.values()):
        n = df.agg(F.count("*").alias("rows"), F.count("target").alias("targets"), F.count_distinct(F.struct(*features)).alias("cells")).first()
        if n["rows"] == n["targets"] and n["cells"] <= min(CELLS, n["rows"] / ROWS_A_CELL):
            assembler = VectorAssembler(inputCols=list(features), outputCol="features")
            grown = {f: PipelineModel([assembler, m]) for f, m in zip(trained, _forests(df, features, regressor(kind), trained), strict=True)}
    out = None
    for f in trained:
        tested = df.filter(F.col("fold") == f)
        found = grown.get(f) or fit(df.filter(F.col("fold") < f) if expanding else df.filter(F.col("fold") != f), features, kind=kind, model=model)
        row = regression_metrics(predicted(found, tested, features)).select(F.lit(f).alias("fold"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def importances(model: PipelineModel, features: tuple[str, ...], spark, *, k: int = 20) -> DataFrame:
    """(feature, importance), the k greatest."""
    pairs = [(f, float(x)) for f, x in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)


def partial_dependence(model: PipelineModel, df: DataFrame, features: tuple[str, ...], *, key: str, k: int = 10, points: int = 50, rows: int = 100) -> DataFrame:
    """(feature, grid, prediction) for the k features of the greatest importance: the mean prediction when one is set to each point
    between its extremes, on one sample of rows."""
    wanted = [r["feature"] for r in importances(model, features, df.sparkSession, k=k).collect()]  # k names
    bounds = df.agg(F.array(*[F.struct(F.lit(f).alias("feature"), F.min(f).cast("double").alias("lo"), F.max(f).cast("double").alias("hi")) for f in wanted]).alias("b")).select(F.inline("b"))
    step = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    grid = bounds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select("feature", step.alias("grid"))
    sample = df.orderBy(F.xxhash64(key), key).limit(rows).select(*features)
    spread = sample.crossJoin(F.broadcast(grid))  # rows times points times features
    spread = spread.select("feature", "grid", *[F.when(F.col("feature") == f, F.col("grid")).otherwise(F.col(f)).alias(f) for f in features])
    return model.transform(spread).groupBy("feature", "grid").agg(F.avg("prediction").alias("prediction"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)

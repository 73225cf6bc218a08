"""Text statistics for labelling components: TF-IDF, tails of scores, keywords, style, effects and association."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ship
from ..sources.articles import few, stored
from .quality import value_counts
from .words import Terms, counted, cut, slabs

# Common English words, and the word lists of the style features.
STOP_WORDS = ("a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "could", "do", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "into", "is", "it", "its", "more", "no", "not", "of", "on", "one", "or", "our", "out", "she", "so", "some", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "up", "was", "we", "were", "what", "when", "which", "who", "will", "with", "would", "you")
PRONOUNS = ("i", "we", "me", "us", "my", "our", "mine", "ours")
SECOND_PERSON = ("you", "your", "yours")
MODALS = ("can", "could", "may", "might", "must", "shall", "should", "will", "would")
NEGATIONS = ("no", "not", "never", "none", "nothing", "neither", "nor", "cannot")


#: Counters of the summary of frequent terms, 64 for each term that is wanted at least; terms that a task holds before it hands them on.
COUNTERS, HELD = 1 << 18, 200_000


def words_of(text: Column, stop: tuple[str, ...] = ()) -> Column:
    ok = lambda w: (F.length(w) > 1) & ~w.isin(*stop) if stop else F.length(w) > 1
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), ok)


def _terms(docs: DataFrame, key: str, text: str, stop: tuple[str, ...], grams: int) -> DataFrame:
    """(key, terms): the words of each text, and its word pairs if ``grams`` is 2."""
    w = docs.select(key, words_of(F.col(text), stop).alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return w.select(key, (F.concat("w", pairs) if grams == 2 else F.col("w")).alias("terms"))


def frequent_terms(rows: DataFrame, *, least: int, most: float, terms: int) -> DataFrame:
    """(term, df, n): the ``terms`` most frequent of all terms that are in ``least`` rows at least and in no more than a share ``most``, ties by name.

    Tasks hand on a counter for each hash of a term, whose number is fixed; a term can't be more frequent than its counter.  Terms of
    the greatest counters are counted exactly, and if fewer than ``terms`` of them reach the greatest counter left out, more
    counters are opened.  No table of all terms is made.
    """
    n = rows.count()
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(COUNTERS))
    counters = stored(rows.select(F.explode("terms").alias("t")).groupBy(place(F.col("t")).alias("counter")).agg(F.count("*").alias("upper")), "counters")
    opened = 4 * terms
    while True:
        best = counters.orderBy(F.desc("upper"), "counter").limit(opened + 1).collect()  # a few for each term
        closed = best[opened]["upper"] if len(best) > opened else 0
        known = [r["counter"] for r in best if r["upper"] > closed]
        hit = F.filter("terms", lambda t: place(t).isin(known)) if closed else F.col("terms")
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        cells = F.concat(F.transform("hit", lambda t: F.struct(t.alias("term"), one.alias("tf"), zero.alias("df"))), F.transform(F.array_distinct("hit"), lambda t: F.struct(t.alias("term"), zero.alias("tf"), one.alias("df"))))
        exact = rows.select(hit.alias("hit")).select(F.inline(cells)).groupBy("term").agg(F.sum("tf").alias("all"), F.sum("df").alias("df"))
        found = stored(exact.filter((F.col("df") >= least) & (F.col("df") <= F.lit(n) * most)).orderBy(F.desc("all"), "term").limit(terms), "frequent")
        if not closed or found.filter(F.col("all") > closed).count() == terms:
            return found.select("term", "df", F.lit(n).cast("long").alias("n"))
        opened *= 8


def dealt(docs: DataFrame) -> DataFrame:
    """The rows dealt to a few partitions for each core: a file of one row group is one task."""
    return docs.repartition(max(docs.rdd.getNumPartitions(), 4 * docs.sparkSession.sparkContext.defaultParallelism))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, texts) in lower case, dealt to all cores; rows that share a key are one document."""
    rows = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    n = docs.agg(F.count("*").alias("n"), F.count_distinct(F.struct(key)).alias("keys")).first()
    if n["n"] > n["keys"]:
        rows = rows.groupBy("key").agg(F.collect_list("text").alias("texts"))
    else:
        rows = dealt(rows.select("key", F.array("text").alias("texts")))
    return stored(rows, "texts")  # as three passes read them


def _counters(texts: DataFrame, stop: tuple[str, ...], grams: int, size: int) -> np.ndarray:
    """How many words and pairs have each hash: ``size`` numbers from every task, which meet by block."""
    block = 1 << 16

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for slab, _ in slabs(batch.column("texts")):
                c = cut(slab, stop, grams)
                total += np.bincount((np.concatenate([c.one, c.two]) & np.uint64(size - 1)).view(np.int64), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(range(0, size, block), pa.int32()), pa.array([total[a : a + block].tobytes() for a in range(0, size, block)], pa.binary())], ["block", "blob"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found[at] = found.get(at, 0) + np.frombuffer(blob, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["block", "blob"])

    out, schema = np.zeros(size, np.int64), "block int, blob binary"
    for r in texts.select("texts").mapInArrow(own, schema).repartition("block").mapInArrow(added, schema).collect():
        out[r["block"] : r["block"] + block] = np.frombuffer(r["blob"], np.int64)
    return out


def _chosen(texts: DataFrame, n: int, stop: tuple[str, ...], grams: int, *, least: int, most: float, terms: int) -> list[tuple[str, int]]:
    """(term, df) of the ``terms`` most frequent of all that ``tfidf`` may use, as ``frequent_terms`` finds them, from the texts themselves."""
    size = max(COUNTERS, 64 << max(0, terms - 1).bit_length())
    counters, opened = _counters(texts, stop, grams, size), 4 * terms
    while True:
        order = np.argsort(-counters, kind="stable")
        closed = int(counters[order[opened]]) if opened < size else 0
        known = counters > closed

        def exact(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            tf, df = Counter(), Counter()
            for batch in batches:
                for slab, row in slabs(batch.column("texts")):
                    c = cut(slab, stop, grams)
                    for n_words in range(1, grams + 1):
                        names, often, rows = counted(c, row, known, n_words)
                        tf.update(dict(zip(names, often.tolist(), strict=True)))
                        df.update(dict(zip(names, rows.tolist(), strict=True)))
                    if len(tf) >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(list(tf)), pa.array(list(tf.values())), pa.array([df[t] for t in tf])], ["term", "all", "df"])
                        tf, df = Counter(), Counter()
            yield pa.RecordBatch.from_arrays([pa.array(list(tf), pa.string()), pa.array(list(tf.values()), pa.int64()), pa.array([df[t] for t in tf], pa.int64())], ["term", "all", "df"])

        rows = texts.select("texts").mapInArrow(exact, "term string, all long, df long").groupBy("term").agg(F.sum("all").alias("all"), F.sum("df").alias("df"))
        found = rows.filter((F.col("df") >= least) & (F.col("df") <= F.lit(n) * most)).orderBy(F.desc("all"), "term").limit(terms).collect()  # ``terms`` at most
        if not closed or sum(r["all"] > closed for r in found) == terms:
            return [(r["term"], r["df"]) for r in found]
        opened *= 8


def tfidf(docs: DataFrame, *, key: str, text: str, stop: tuple[str, ...] = STOP_WORDS, least: int = 2, most: float = 0.8, terms: int = 500, grams: int = 2, only: DataFrame | None = None) -> DataFrame:
    """(key, term, weight): smoothed TF-IDF of words and word pairs, scaled to unit length for each document.

    Terms are in ``least`` documents at least and in no more than a share ``most`` of them; the ``terms`` most frequent
    count, ties by name.  Weights are made for all documents, or for those whose key is in ``only``.  Tasks look for terms in the texts: once
    for the sizes of counters, once for terms of great ones, and once for the weights; no table of all terms is made.
    """
    ship(docs.sparkSession)
    texts, n = _texts(docs, key, text), docs.count()
    idf = {t: float(np.log((n + 1) / (df + 1)) + 1) for t, df in _chosen(texts, n, stop, grams, least=least, most=most, terms=terms)}

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, factor, names = Terms(idf, max(COUNTERS, 64 << len(idf).bit_length())), np.array(list(idf.values())), pa.array(list(idf), pa.string())
        for batch in batches:
            for slab, row in slabs(batch.column("texts")):
                c = cut(slab, stop, grams)
                hits = [known.found(c, k) for k in range(1, grams + 1)]
                cell, tf = np.unique(np.concatenate([row[c.text[i]] * len(idf) + which for i, which in hits]), return_counts=True)
                if not len(cell):
                    continue
                at, which = np.divmod(cell, len(idf))
                raw = factor[which] * tf
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), names.take(pa.array(which)), pa.array(raw / np.sqrt(np.bincount(at, raw * raw)[at]))], [key, "term", "weight"])

    if only is not None:
        texts = texts.join(only.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    return texts.mapInArrow(weights, f"`{key}` {dict(docs.dtypes)[key]}, term string, weight double")


def tail_size(n: int, share: float, *, least: int = 10, small: int = 300, raised: float = 0.2) -> int:
    """How many rows a tail has: a share of all, raised for small inputs, and ``least`` at least."""
    return max(least, int(n * (max(share, raised) if n < small else share)))


def tails(scores: DataFrame, size: int, *, key: str = "id") -> DataFrame:
    """(component, id, score, tail): the ``size`` rows with the greatest and with the least score of each component."""
    high = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("score"), key))
    low = F.row_number().over(Window.partitionBy("component").orderBy("score", key))
    first = scores.withColumn("_p", high).filter(F.col("_p") <= size).drop("_p").withColumn("tail", F.lit("high"))
    return first.unionByName(scores.withColumn("_p", low).filter(F.col("_p") <= size).drop("_p").withColumn("tail", F.lit("low")))


def tail_keywords(tail_rows: DataFrame, weights: DataFrame, *, key: str = "id", k: int = 15) -> DataFrame:
    """(component, tail, term, weight, place): the terms with the greatest mean weight over a tail, terms that a document lacks as 0."""
    sizes = tail_rows.groupBy("component", "tail").agg(F.count("*").alias("n"))
    sums = tail_rows.select("component", "tail", key).join(weights, key).groupBy("component", "tail", "term").agg(F.sum("weight").alias("s"))
    mean = sums.join(sizes, ["component", "tail"]).select("component", "tail", "term", F.round(F.col("s") / F.col("n"), 6).alias("weight")).filter("weight > 0")
    place = F.row_number().over(Window.partitionBy("component", "tail").orderBy(F.desc("weight"), "term"))
    return mean.withColumn("place", place).filter(F.col("place") <= k)


def unique_keywords(keywords: DataFrame, *, k: int = 10) -> DataFrame:
    """The first k keywords of a tail that the other tail of the component doesn't have."""
    other = keywords.select("component", "term", F.when(F.col("tail") == "high", "low").otherwise("high").alias("tail"))
    own = keywords.join(other, ["component", "tail", "term"], "left_anti")
    place = F.row_number().over(Window.partitionBy("component", "tail").orderBy("place"))
    return own.withColumn("rank", place).filter(F.col("rank") <= k).drop("place")


def uniqueness(keywords: DataFrame) -> DataFrame:
    """(component, uniqueness): 1 less the mean share of a component's terms that each other component has."""
    own = keywords.select("component", "term").distinct()
    sizes = own.groupBy("component").agg(F.count("*").alias("n"))
    others = own.select("component").distinct().count() - 1
    shared = own.join(own.select(F.col("component").alias("other"), "term"), "term").filter("component <> other").groupBy("component").agg(F.count("*").alias("s"))
    rows = sizes.join(shared, "component", "left")
    return rows.select("component", F.round(1 - F.coalesce(F.try_divide(F.col("s"), F.col("n") * others), F.lit(0.0)), 6).alias("uniqueness"))


def component_confidence(variance: Column, keyword: Column, topic: Column, unique: Column) -> Column:
    return F.least(variance * 0.3 + F.least(keyword * 2, F.lit(1.0)) * 0.3 + F.least(topic * 3, F.lit(1.0)) * 0.2 + unique * 0.2, F.lit(1.0))


def component_labels(unique: DataFrame, *, k: int = 3) -> DataFrame:
    """(component, label, subtitle): the first unique terms of both tails in words."""
    def first(tail: str) -> Column:
        found = F.array_sort(F.collect_list(F.when((F.col("tail") == tail) & (F.col("rank") <= k), F.struct("rank", "term"))))
        return F.array_join(F.transform(found, lambda x: x["term"]), ", ")

    rows = unique.groupBy("component").agg(first("high").alias("h"), first("low").alias("l"))
    return rows.select("component", F.concat_ws(" versus ", F.nullif("h", F.lit("")), F.nullif("l", F.lit(""))).alias("label"), F.concat(F.lit("high: "), "h", F.lit("; low: "), "l").alias("subtitle"))


def _pieces(text: Column) -> list[Column]:
    """The text, its words, and the lengths of its sentences."""
    t = F.coalesce(text, F.lit(""))
    sentences = F.filter(F.split(t, r"[.!?]+"), lambda s: F.trim(s) != "")
    return [t.alias("_t"), F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}_]+"), lambda w: w != "").alias("_words"), F.transform(sentences, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))).alias("_lengths")]


def _style(t: Column, words: Column, lengths: Column) -> list[Column]:
    chars, n, m = F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(words), F.lit(1)), F.greatest(F.size(lengths), F.lit(1))

    def rate(pattern: str) -> Column:
        return F.round(F.regexp_count(t, F.lit(pattern)) / chars, 6)

    def share(items: tuple[str, ...]) -> Column:
        return F.round(F.size(F.filter(words, lambda w: w.isin(*items))) / n, 6)

    return [
        F.length(t).alias("chars"), F.size(words).alias("words"), F.round(F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / n, 6).alias("word_length"), F.round(F.size(F.array_distinct(words)) / n, 6).alias("type_token"),
        rate(r"[^\p{L}\p{N}_\s]").alias("punctuation"), rate("!").alias("exclamations"), rate(r"\?").alias("questions"), rate(r"\d").alias("digits"), rate(r"\p{Lu}").alias("upper"),
        F.size(lengths).alias("sentences"), F.round(F.aggregate(lengths, F.lit(0), lambda s, x: s + x) / m, 6).alias("sentence_length"), F.coalesce(F.array_max(lengths), F.lit(0)).alias("longest_sentence"),
        share(PRONOUNS).alias("first_person"), share(SECOND_PERSON).alias("second_person"), share(MODALS).alias("modals"), share(NEGATIONS).alias("negations"),
    ]


def style_features(text: Column) -> list[Column]:
    """Sixteen rates and lengths of a text."""
    return _style(*_pieces(text))


def with_style(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, the sixteen style features): a text is cut into words and sentences once for all of them."""
    cut = docs.select(F.col(key).alias("_key"), *_pieces(F.col(text)))
    once = cut.select(F.explode(F.array(F.struct("*"))).alias("_x")).select("_x.*")  # keeps the cuts from being put into each feature
    return once.select(F.col("_key").alias(key), *_style(F.col("_t"), F.col("_words"), F.col("_lengths")))


def effects(rows: DataFrame, features: tuple[str, ...], *, tail: Column) -> DataFrame:
    """(feature, difference, cohens_d): mean difference of the tail and the rest, also over the pooled deviation."""
    kinds = rows.withColumn("_in", tail)
    parts = []
    for f in features:
        a, b = F.when(F.col("_in"), F.col(f)), F.when(~F.col("_in"), F.col(f))
        pooled = F.sqrt(((F.count(a) - 1) * F.var_samp(a) + (F.count(b) - 1) * F.var_samp(b)) / (F.count(a) + F.count(b) - 2))
        parts.append(F.struct(F.lit(f).alias("feature"), F.round(F.avg(a) - F.avg(b), 6).alias("difference"), F.round(F.try_divide(F.avg(a) - F.avg(b), pooled), 6).alias("cohens_d")))
    return kinds.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def mutual_information(rows: DataFrame, bin_col: str, flag: Column) -> DataFrame:
    """The plug-in mutual information of a bin and a flag."""
    cells = rows.groupBy(bin_col, flag.alias("flag")).agg(F.count("*").alias("n"))
    every, by_bin, by_flag = Window.partitionBy(), Window.partitionBy(bin_col), Window.partitionBy("flag")  # a few cells
    n = F.sum("n").over(every)
    value = F.col("n") / n * F.ln(F.col("n") * n / (F.sum("n").over(by_bin) * F.sum("n").over(by_flag)))
    return cells.select(value.alias("v")).agg(F.round(F.sum("v"), 6).alias("mutual_information"))


def oriented(scores: DataFrame, tail_rows: DataFrame, reference: DataFrame, *, key: str = "id") -> DataFrame:
    """The scores, their sign turned for components whose high tail has the lower mean of a reference value."""
    means = tail_rows.select("component", key, "tail").join(reference.select(key, "value"), key).groupBy("component").agg(F.avg(F.when(F.col("tail") == "high", F.col("value"))).alias("h"), F.avg(F.when(F.col("tail") == "low", F.col("value"))).alias("l"))
    sign = F.when(F.col("h") < F.col("l"), -1).otherwise(1)
    return scores.join(means.select("component", sign.alias("sign")), "component").withColumn("score", F.col("score") * F.col("sign"))


def average_ranks(df: DataFrame, column: str, group: str, out: str) -> DataFrame:
    """Ranks from 1 within a group; equal values share their mean rank.  Distinct values are ranked, so no task holds a group."""
    ranks = value_counts(df, column, group)
    return df.join(few(ranks.select(group, column, (F.col("_less") + (F.col("_rows") + 1) / 2).alias(out))), [group, column])


def correlation(rows: DataFrame, *, group: str, x: str, y: str) -> DataFrame:
    """(group, rho): rank correlation."""
    ranked = average_ranks(average_ranks(rows, x, group, "_x"), y, group, "_y")
    return ranked.groupBy(group).agg(F.corr("_x", "_y").alias("rho"))


def spearman(rows: DataFrame, *, group: str, x: str, y: str) -> DataFrame:
    """(group, rho): rank correlation, absolute."""
    return correlation(rows, group=group, x=x, y=y).select(group, F.round(F.abs("rho"), 6).alias("rho"))


def taxonomy_facets(scores: DataFrame, counts: DataFrame, tail_rows: DataFrame, *, least: float = 0.15, enrichment: float = 2.0, floor: float = 0.4, k: int = 3, key: str = "id") -> DataFrame:
    """(component, facet, side, score, rank): the k categories of each side that go with a component.

    scores (component, id, score), counts (id, facet, count).  A category counts if its rank correlation with the scores is
    ``least`` or more and the means of the two tails differ by ``enrichment`` deviations; its side is the correlation's sign.
    """
    rows = stored(scores.select("component", key, "score").join(counts, key).withColumn("_g", F.struct("component", "facet").cast("string")), "facets")
    rho = correlation(rows, group="_g", x="score", y="count")
    ends = tail_rows.select("component", key, "tail").join(counts, key).groupBy("component", "facet").agg(F.abs(F.avg(F.when(F.col("tail") == "high", F.col("count"))) - F.avg(F.when(F.col("tail") == "low", F.col("count")))).alias("gap"))
    spread = rows.groupBy("component", "facet", "_g").agg(F.stddev_pop("count").alias("sd"))
    found = spread.join(rho, "_g").join(ends, ["component", "facet"]).filter((F.abs("rho") >= least) & (F.col("gap") / (F.col("sd") + 1e-10) >= enrichment))
    found = found.select("component", "facet", F.when(F.col("rho") > 0, "high").otherwise("low").alias("side"), F.round(F.greatest(F.abs("rho"), F.lit(floor)), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("component", "side").orderBy(F.desc("score"), "facet"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def log_odds(high: Column, low: Column, alpha: float = 0.01) -> Column:
    """The log-odds of two proportions, squashed to 0 … 1."""
    raw = F.abs(F.ln((high + alpha) / (low + alpha)))
    return raw / (1 + raw)


def facets(rows: DataFrame, *, least: float = 0.25, k: int = 5) -> DataFrame:
    """(component, side, facet, score, rank, weak): the best facets of a side, and whether there are fewer than two."""
    place = F.row_number().over(Window.partitionBy("component", "side").orderBy(F.desc("score"), "facet"))
    kept = rows.filter(F.col("score") >= least).withColumn("rank", place).filter(F.col("rank") <= k)
    return kept.withColumn("weak", F.count("*").over(Window.partitionBy("component", "side")) < 2)


def style_facets(rows: DataFrame, features: tuple[str, ...], *, least: float = 0.1, k: int = 5) -> DataFrame:
    """(component, side, facet, rank): the first k features, in their order, whose means of the two tails differ by more than ``least``, on the side of the greater one.

    rows (component, tail, features…) of the tails.
    """
    mean = lambda f, t: F.coalesce(F.avg(F.when(F.col("tail") == t, F.col(f))), F.lit(0.0))
    cells = [F.struct(F.lit(i).alias("place"), F.lit(f).alias("facet"), mean(f, "high").alias("h"), mean(f, "low").alias("l")) for i, f in enumerate(features)]
    long = rows.groupBy("component").agg(F.array(*cells).alias("c")).select("component", F.inline("c")).filter(F.abs(F.col("h") - F.col("l")) > least)
    long = long.withColumn("side", F.when(F.col("h") > F.col("l"), "high").otherwise("low"))
    rank = F.row_number().over(Window.partitionBy("component", "side").orderBy("place"))
    return long.select("component", "side", "facet", rank.alias("rank")).filter(F.col("rank") <= k)


def diversity_index(pairs: DataFrame) -> DataFrame:
    """One row: the mean of 1 less the similarity over all pairs of labels; 1 where there is no pair."""
    return pairs.agg(F.round(F.coalesce(F.avg(1 - F.col("similarity")), F.lit(1.0)), 6).alias("diversity"))


def label_similarity(cos: Column, a: Column, b: Column) -> Column:
    """Half the cosine and half the Jaccard similarity of topic lists."""
    return cos * 0.5 + F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)) * 0.5


def evidence_pack(tail_rows: DataFrame, texts: DataFrame, *, key: str = "id", k: int = 30, most: int = 200) -> DataFrame:
    """(component, tail, place, id, score, snippet): the k most extreme texts of each tail."""
    extreme = F.when(F.col("tail") == "high", -F.col("score")).otherwise(F.col("score"))
    place = F.row_number().over(Window.partitionBy("component", "tail").orderBy(extreme, key))
    best = tail_rows.withColumn("place", place).filter(F.col("place") <= k)
    return best.join(texts.select(key, F.substring("text", 1, most).alias("snippet")), key).select("component", "tail", "place", key, "score", "snippet")

"""Tagged events: parsing of tag lists, counts and means for each tag, and association between tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The strengths of a relation.
STRENGTHS = ("High", "Medium", "Immaterial")
#: A tag text that stands for no tag.
NO_TAG = ("", "none", "no applicable categories")


def split_tags(text: Column) -> Column:
    """The tags of a ';' list, trimmed, without empty ones and those that say there is none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: ~F.lower(x).isin(*NO_TAG))


def append_tag(text: Column, flag: Column, tag: str) -> Column:
    """The list with one more tag where the flag is set and the tag is not there yet."""
    missing = flag & ~F.contains(F.coalesce(text, F.lit("")), F.lit(tag))
    return F.when(missing, F.concat_ws("; ", F.nullif(text, F.lit("")), F.lit(tag))).otherwise(text)


def exploded(events: DataFrame, *, key: str = "event_key", text: str = "categories", value: str = "magnitude") -> DataFrame:
    return events.select(key, value, F.explode(split_tags(F.col(text))).alias("tag"))


def tag_means(events: DataFrame) -> DataFrame:
    """Number of events and mean absolute magnitude for each tag; a tag that an event repeats counts again."""
    return exploded(events).groupBy("tag").agg(F.count("*").alias("events"), F.round(F.avg(F.abs("magnitude")), 4).alias("mean_magnitude"))


def tag_means_over_all(events: DataFrame) -> DataFrame:
    """Mean absolute magnitude for each tag over all events, those without the tag as 0; a repeated tag counts once."""
    once = exploded(events).groupBy("tag", "event_key").agg(F.max(F.abs("magnitude")).alias("m"))
    total = events.agg(F.count("*").alias("n"))
    return once.groupBy("tag").agg(F.sum("m").alias("s")).crossJoin(F.broadcast(total)).select("tag", F.round(F.try_divide("s", "n"), 4).alias("mean_magnitude"))


def cooccurrence(events: DataFrame, known: tuple[str, ...] | None = None) -> DataFrame:
    """(a, b, n, share): in how many events two tags stand together, and that over the largest such number."""
    sets = events.select("event_key", F.array_sort(F.array_distinct(split_tags(F.col("categories")))).alias("t"))
    if known is not None:
        sets = sets.withColumn("t", F.array_intersect("t", F.array(*[F.lit(x) for x in known])))
    # a tag list is short; its pairs are made in the row, without a join
    pairs = sets.select(F.explode(F.expr("flatten(transform(t, (x, i) -> transform(slice(t, i + 2, size(t)), y -> struct(x as a, y as b))))")).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 4))


def relation_table(rows: DataFrame) -> DataFrame:
    """(cause, effect, strength): trimmed, in title case, only the known strengths, the last row of a pair wins."""
    clean = rows.select("row_no", F.trim("cause").alias("cause"), F.trim("effect").alias("effect"), F.initcap(F.trim("strength")).alias("strength"))
    return clean.filter(F.col("strength").isin(*STRENGTHS)).groupBy("cause", "effect").agg(F.max_by("strength", "row_no").alias("strength"))


def _both_ways(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    forward = relations.select(F.col("cause").alias("a"), F.col("effect").alias("b"), F.col("strength").alias("ab"))
    back = relations.select(F.col("cause").alias("b"), F.col("effect").alias("a"), F.col("strength").alias("ba"))
    return pairs.join(forward, ["a", "b"], "left").join(back, ["a", "b"], "left")


def _rank(strength: Column) -> Column:
    return F.when(strength == "High", 2).when(strength == "Medium", 1).otherwise(0)


def association(events: DataFrame, relations: DataFrame, *, k: int = 10) -> DataFrame:
    """The k strongest directed associations of tags that stand together.

    The direction is the one that the relation table holds to be stronger (a to b on a tie, none where both are
    immaterial or unknown); the score is the conditional probability of the effect given the cause, times the lift, over
    the largest score.
    """
    sets = events.select("event_key", F.array_distinct(split_tags(F.col("categories"))).alias("t"))
    total = sets.agg(F.count("*").alias("total"))
    alone = sets.select(F.explode("t").alias("tag")).groupBy("tag").agg(F.count("*").alias("n_tag"))
    pairs = _both_ways(cooccurrence(events).select("a", "b", "n"), relations)
    pairs = pairs.join(alone.select(F.col("tag").alias("a"), F.col("n_tag").alias("na")), "a").join(alone.select(F.col("tag").alias("b"), F.col("n_tag").alias("nb")), "b").crossJoin(F.broadcast(total))
    forward = _rank(F.col("ab")) >= _rank(F.col("ba"))
    pairs = pairs.filter((_rank(F.col("ab")) > 0) | (_rank(F.col("ba")) > 0))
    given = F.when(forward, F.col("n") / F.col("na")).otherwise(F.col("n") / F.col("nb"))
    lift = F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))
    pairs = pairs.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("cause"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("effect"), "n", given.alias("given"), lift.alias("lift"))
    scored = pairs.withColumn("raw", F.col("given") * F.col("lift"))
    scored = scored.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy()))
    rounded = [F.round(c, 4).alias(c) for c in ("given", "lift", "score")]
    return scored.select("cause", "effect", "n", *rounded).orderBy(F.desc("score"), "cause", "effect").limit(k)


def relation_matrix(tags: DataFrame, relations: DataFrame, *, high_only: bool = False) -> DataFrame:
    """For each pair of tags with a valid relation the stronger direction and its strength."""
    left, right = tags.select(F.col("tag").alias("a")), tags.select(F.col("tag").alias("b"))
    pairs = _both_ways(left.join(right, F.col("a") < F.col("b")), relations)
    least = 2 if high_only else 1
    ab, ba = _rank(F.col("ab")), _rank(F.col("ba"))
    forward = ab >= ba
    kept = pairs.filter(F.greatest(ab, ba) >= least)
    return kept.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("cause"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("effect"), F.when(forward, F.col("ab")).otherwise(F.col("ba")).alias("strength"))

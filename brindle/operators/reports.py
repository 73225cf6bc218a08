"""Reporting aggregates over events, articles, reactions and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)


def kpi_summary(events: DataFrame, *, damaging: Column, damage: str, response: str, articles: str) -> DataFrame:
    """One row: events, damaging ones and their share, mean scores and articles of the damaging ones."""
    return events.agg(
        F.count("*").alias("events"),
        F.count_if(damaging).alias("damage_events"),
        share(F.count_if(damaging), F.count("*")).alias("damage_share"),
        F.round(F.avg(F.when(damaging, F.col(damage))), 4).alias("mean_damage"),
        F.round(F.avg(F.when(damaging, F.col(response))), 4).alias("mean_response"),
        F.round(F.avg(F.when(damaging, F.col(articles))), 4).alias("articles_per_event"),
    )


def severity_distribution(events: DataFrame, score: str, *, low: int = 1, high: int = 5) -> DataFrame:
    """(bucket, n) for every bucket, also those without events; scores are rounded half to even."""
    buckets = events.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("bucket"))
    counts = events.groupBy(F.bround(score, 0).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def frequencies(events: DataFrame, values: Column, *, without: tuple[str, ...] = (), name: str = "value") -> DataFrame:
    """(value, n) of a list column, some values left out."""
    rows = events.select(F.explode(values).alias(name))
    return rows.filter(~F.col(name).isin(*without)).groupBy(name).agg(F.count("*").alias("n")) if without else rows.groupBy(name).agg(F.count("*").alias("n"))


def top(rows: DataFrame, k: int, value: str = "n", *tie: str) -> DataFrame:
    return rows.orderBy(F.desc(value), *tie).limit(k)


def article_summary(articles: DataFrame, *, score: str, relevance: str, month: Column) -> DataFrame:
    """By month: articles, mean of the scores that aren't 0, number of high scores and of low relevance."""
    return articles.groupBy(month.alias("month")).agg(
        F.count("*").alias("articles"), F.round(F.avg(F.when(F.col(score) != 0, F.col(score))), 4).alias("mean_score"), F.count_if(F.col(score) >= 4).alias("high_impact"), F.count_if(F.col(relevance) <= 3).alias("low_relevance")
    )


def analysis_lists(rows: DataFrame, *, key: str, damage: str, response: str, sincerity: str, facts: str) -> DataFrame:
    """(list, key, facts): severe, poorly answered and insincere articles with the beginning of their facts; unknown sincerity is 3."""
    s = F.coalesce(F.col(sincerity), F.lit(3))
    flags = F.array(F.when(F.col(damage) >= 4, "severe"), F.when(F.col(response) <= 2, "poor response"), F.when(s <= 2, "insincere"))
    named = rows.select(key, F.substring(facts, 1, 200).alias("facts"), F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("list"))
    return named.select("list", key, "facts")


def month_timeline(events: DataFrame, *, date: str, damage: str, categories: Column, stakeholders: Column) -> DataFrame:
    """By month: events, total and mean damage, and the sets of categories and stakeholders in order."""
    return events.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("events"),
        F.round(F.sum(damage), 2).alias("total_damage"),
        F.round(F.avg(damage), 4).alias("mean_damage"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(categories)))).alias("categories"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(stakeholders)))).alias("stakeholders"),
    )


def event_markers(events: DataFrame, *, date: str, key: str, damage: str, first: int = 100, least: float = 3.0) -> DataFrame:
    """The first events by date, and of these the ones with enough damage: the limit comes before the filter."""
    return events.orderBy(date, key).limit(first).filter(F.col(damage) >= least)


def severity_timeline(results: DataFrame, events: DataFrame) -> DataFrame:
    """Graded results of relevant events: results have name, grade and date text, events have name and relevant."""
    rows = results.join(events.select("name", "relevant"), "name", "left")
    rows = rows.filter(F.col("relevant") & (F.length("date_text") >= 10) & F.col("grade").isNotNull())
    return rows.select("name", F.substring("date_text", 1, 10).alias("date"), "grade")


def enriched_top(results: DataFrame, events: DataFrame, *, least: int = 4, k: int = 6) -> DataFrame:
    """The k most severe results with what the event table says of them; of rows with the same name the last counts."""
    best = results.filter(F.col("grade") >= least).orderBy(F.desc("grade"), F.desc("probability"), "name").limit(k)
    last = events.groupBy("name").agg(F.max_by("info", "place").alias("info"))
    return best.join(last, "name", "left")


def classed_top(counts: DataFrame, classes: DataFrame, *, k: int = 8) -> DataFrame:
    """The k most frequent responses with their class, 'unclassified' where there is none."""
    slug = F.regexp_replace(F.lower("value"), r"[^a-z0-9]+", "-")
    best = top(counts, k, "n", "value").withColumn("slug", slug)
    return best.join(classes.select("slug", "class"), "slug", "left").select("value", "n", F.coalesce("class", F.lit("unclassified")).alias("class"))


def drill_down(events: DataFrame, value: str, *, column: str, damage: str, key: str, k: int = 50) -> DataFrame:
    """The k events with the greatest damage that have a value in a list column."""
    return events.filter(F.array_contains(column, value)).orderBy(F.desc(damage), key).limit(k)


def drill_down_categories(events: DataFrame, value: str, *, column: str) -> DataFrame:
    """(category, n): how many of the events that have a value in a list column have each other one."""
    rows = events.filter(F.array_contains(column, value)).select(F.explode(F.array_distinct(column)).alias("category"))
    return rows.filter(F.col("category") != value).groupBy("category").agg(F.count("*").alias("n"))


def trajectory(rows: DataFrame, *, reactions: str, without: tuple[str, ...]) -> DataFrame:
    """(event, date, stakeholder, score): a map of reactions as rows, without null scores and some stakeholders."""
    long = rows.select("event", "date", F.explode(reactions).alias("stakeholder", "score"))
    return long.filter(F.col("score").isNotNull() & ~F.col("stakeholder").isin(*without))


def score_band(score: Column) -> Column:
    return F.when(score >= 2, "positive").when(score <= -2, "negative").otherwise("neutral")


def prediction_summary(predictions: DataFrame, *, label: str, confidence: str) -> DataFrame:
    """(label, n, percent, mean confidence)."""
    rows = predictions.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 4).alias("mean_confidence"))
    return rows.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


def cost_ledger(requests: DataFrame, rates: DataFrame, *, default: tuple[float, float]) -> DataFrame:
    """(model, requests, tokens_in, tokens_out, cost): prices are for 1,000 tokens; a model without a rate has the default."""
    rows = requests.join(rates.select("model", "rate_in", "rate_out"), "model", "left")
    cost = F.col("tokens_in") / 1000 * F.coalesce("rate_in", F.lit(default[0])) + F.col("tokens_out") / 1000 * F.coalesce("rate_out", F.lit(default[1]))
    return rows.groupBy("model").agg(F.count("*").alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum(cost), 6).alias("cost"))


def cost_forecast(texts: DataFrame, column: str, *, rate_in: float, rate_out: float, tokens_out: int) -> DataFrame:
    """One row: texts, tokens of a mean text (4 characters each) and the cost of all."""
    rows = texts.agg(F.count("*").alias("texts"), F.avg(F.length(column)).alias("mean"))
    tokens = F.floor(F.floor("mean") / 4).cast("long")
    return rows.select("texts", tokens.alias("tokens_in"), F.round((tokens / 1000 * rate_in + tokens_out / 1000 * rate_out) * F.col("texts"), 6).alias("cost"))


def compared(metrics: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Metrics (model, metric, value) side by side."""
    return metrics.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))


def residuals(predictions: DataFrame, *, key: str, actual: str, predicted: str, k: int = 3) -> DataFrame:
    """The k least and the k greatest movements with their residual."""
    rows = predictions.select(key, actual, predicted, (F.col(predicted) - F.col(actual)).alias("residual"))
    low = rows.orderBy(actual, key).limit(k).withColumn("side", F.lit("bottom"))
    return low.unionAll(rows.orderBy(F.desc(actual), key).limit(k).withColumn("side", F.lit("top")))

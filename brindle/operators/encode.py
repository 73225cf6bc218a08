"""Encoding of extracted features into numbers: blocks of columns, their assembly and scaling, and factor features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.articles import few, stored

# The categories that have a column each, and the factor names with their synonyms and weights.
SENTIMENTS = ("positive", "negative", "neutral")
CAUSES = ("internal_operations", "market_conditions", "regulatory", "external_events", "unknown")
TONES = ("factual", "speculative", "urgent", "neutral", "optimistic", "pessimistic")
CENTRALITY = {"primary": 1.0, "secondary": 0.6, "peripheral": 0.3}
FACTORS = {
    "fuel_prices": ("fuel", "jet fuel", "oil", "brent", "energy prices", "fuel cost", "oil price"),
    "labor_union": ("union", "strike", "industrial action", "wage", "pilot union", "cabin crew"),
    "route_network": ("route", "capacity", "load factor", "network", "frequencies", "slot"),
    "regulatory": ("regulator", "regulatory", "accc", "acma", "apra", "casa", "approval", "block", "fine"),
    "covid": ("covid", "pandemic", "reopening", "lockdown", "travel restrictions"),
    "executive_comp": ("executive comp", "ceo pay", "bonus", "remuneration", "exec compensation"),
    "competition": ("competitor", "competition", "virgin", "rex", "airline rivalry", "price war"),
    "technical_flow": ("ex-dividend", "technical", "profit-taking", "rebalancing", "index inclusion", "ftse", "asx"),
    "reputation": ("reputation", "brand", "customer service", "scandal", "shonky", "trust"),
    "agm_vote": ("agm", "remuneration vote", "two-strikes", "shareholder meeting"),
    "analyst_action": ("analyst", "broker", "downgrade", "upgrade", "target price", "recommendation"),
    "earnings_guidance": ("earnings", "guidance", "profit", "ebit", "revenue", "forecast"),
    "operations_safety": ("safety", "incident", "engine", "maintenance", "delay", "cancellation"),
    "partnership_mna": ("code share", "partnership", "alliance", "merger", "acquisition", "joint venture"),
    "macro_fx": ("macro", "inflation", "interest rate", "fx", "australian dollar", "aud"),
}


def indicators(value: Column, names: tuple[str, ...], prefix: str) -> list[Column]:
    return [F.coalesce((value == n).cast("int"), F.lit(0)).alias(f"{prefix}_{n}") for n in names]


def sentiment_block(label: Column, confidence: Column, score: Column) -> list[Column]:
    return indicators(label, SENTIMENTS, "sentiment") + [F.coalesce(confidence.cast("string").try_cast("double"), F.lit(0.5)).alias("sentiment_confidence"), F.coalesce(score.cast("string").try_cast("double"), F.lit(0.0)).alias("sentiment_score")]


def fit_topics(df: DataFrame, column: str, *, k: int = 5) -> list[str]:
    """The k most frequent topics, ties by name: what transform needs, and all it needs."""
    rows = df.groupBy(F.col(column).cast("string").alias("topic")).agg(F.count("*").alias("n")).filter("topic is not null").orderBy(F.desc("n"), "topic").limit(k)
    return [r["topic"] for r in rows.collect()]  # k names


def topic_block(topic: Column, scores: Column | None, topics: list[str], *, k: int = 5) -> list[Column]:
    """A column for each fitted topic, k in all, and the scores of the first k topics in order of their names."""
    out = [F.coalesce((topic == t).cast("int"), F.lit(0)).alias(f"topic_{t}") for t in topics]
    out += [F.lit(0).alias(f"topic_other_{i}") for i in range(len(topics), k)]
    if scores is not None:
        out += [F.coalesce(F.try_element_at(scores, F.lit(t)), F.lit(0.0)).alias(f"topic_score_{t}") for t in sorted(topics)[:k]]
    return out


def _n(c: Column) -> Column:
    return F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))


def entity_block(companies: Column, people: Column, metrics: Column) -> list[Column]:
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce(companies, none), F.coalesce(people, none)))
    return [_n(companies).alias("company_count"), _n(people).alias("people_count"), _n(metrics).alias("metric_count"), F.size(both).alias("entity_diversity"), (_n(companies) + _n(people) + _n(metrics)).alias("entity_importance")]


def causal_block(confidences: Column, chain: Column, cause: Column) -> list[Column]:
    """``confidences`` holds one number for each causal factor, null where it is unknown."""
    n = _n(confidences)
    filled = F.transform(confidences, lambda x: F.coalesce(x, F.lit(0.5)))
    mean = F.coalesce(F.when(n > 0, F.aggregate(filled, F.lit(0.0), lambda s, x: s + x) / n), F.lit(0.5))
    return [n.alias("causal_factor_count"), F.coalesce(chain, F.lit(0)).alias("causal_chain_length"), *indicators(cause, CAUSES, "cause_category"), F.round(mean, 6).alias("causal_confidence_avg"), F.round(n * mean, 6).alias("causal_strength")]


def risk_block(level: Column, uncertainty: Column, forward: Column) -> list[Column]:
    return [F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(level, F.lit(5)))).alias("risk_level"), _n(uncertainty).alias("uncertainty_count"), F.coalesce(forward.cast("int"), F.lit(0)).alias("forward_looking_flag")]


def text_block(phrases: Column, tone: Column) -> list[Column]:
    n = _n(phrases)
    return [n.alias("key_phrase_count"), *indicators(tone, TONES, "tone"), n.alias("text_length_proxy"), F.round(n / (n + 1), 6).alias("readability_score"), F.coalesce((tone == "urgent").cast("int"), F.lit(0)).alias("urgency_score")]


@dataclass
class Scaler:
    """Means and population standard deviations of columns, fitted once."""

    means: dict[str, float] | None = None
    deviations: dict[str, float] | None = None

    def fit(self, df: DataFrame, columns: tuple[str, ...]) -> Scaler:
        row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
        self.means = {c: row[f"m_{c}"] for c in columns}
        self.deviations = {c: row[f"s_{c}"] or 1.0 for c in columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.means is None:
            raise ValueError("fit the scaler first")
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(self.deviations[c]) for c, m in self.means.items()})


def canonical_factors(df: DataFrame, column: str, *, factors: dict[str, tuple[str, ...]] = FACTORS, out: str = "canonical") -> DataFrame:
    """The factor whose key is the name, or else the first one of whose synonyms holds the name or is held by it.

    A name without one is tried again with "price" for "prices" and "cost" for "costs", for the first factor whose key or
    one of whose synonyms it holds.  Case and white space around the name don't count.  Names repeat, so the small table of
    synonyms is searched once for each different name.  The empty name is held by every synonym and so gets the first factor.
    """
    spark = df.sparkSession
    rows = [(n, key, s) for n, (key, names) in enumerate(factors.items()) for s in names]
    table = F.broadcast(spark.createDataFrame(rows, "_order int, _key string, _synonym string"))
    names = df.select(column).distinct().filter(F.col(column).isNotNull()).withColumn("_raw", F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")))
    again = F.replace(F.replace("_raw", F.lit("prices"), F.lit("price")), F.lit("costs"), F.lit("cost"))
    holds = F.contains("_raw", "_synonym") | F.contains("_synonym", "_raw")
    place = F.when(F.col("_raw") == F.col("_key"), -1).when(holds, F.col("_order")).when(F.contains(again, F.col("_key")) | F.contains(again, F.col("_synonym")), F.col("_order") + len(factors))
    found = names.join(table, place.isNotNull()).groupBy(F.col(column).alias("_name")).agg(F.min_by("_key", place).alias(out))
    return df.join(few(stored(found, "canonical")), F.col(column) == F.col("_name"), "left").drop("_name")


def factor_rows(df: DataFrame, key: str, factors: str) -> DataFrame:
    """(key, place, name, canonical, direction, centrality, causal, confidence): one row for each factor."""
    return df.select(key, F.posexplode(factors).alias("place", "_f")).select(key, "place", "_f.*")


def factor_features(docs: DataFrame | None, factors: DataFrame, key: str, *, names: tuple[str, ...], neutral: bool = False) -> DataFrame:
    """For each document and factor name the sums of weight times confidence by direction, and of the causal ones; 0 where there are none.

    Without ``docs`` the documents are those of the factors, which are passed over once then.  Factors have key, canonical, direction, centrality, causal and confidence.  The columns are fixed by ``names``.
    """
    weight = F.lit(0.5)
    for c, w in CENTRALITY.items():
        weight = F.when(F.col("centrality") == c, w).otherwise(weight)
    w = weight * F.col("confidence")
    channels = [("pos", F.col("direction") == "positive"), ("neg", F.col("direction") == "negative")]
    if neutral:
        channels.append(("neu", ~F.col("direction").isin("positive", "negative")))
    channels.append(("causal", F.col("causal")))
    sums = [F.round(F.sum(F.when((F.col("canonical") == n) & when, w)), 6).alias(f"{n}__{c}") for n in names for c, when in channels]
    if docs is None:
        found = factors.groupBy(key).agg(*sums)
    else:
        found = docs.select(key).join(factors.filter(F.col("canonical").isin(*names)).groupBy(key).agg(*sums), key, "left")
    return found.fillna(0.0, subset=[f"{n}__{c}" for n in names for c, _ in channels])


def feature_matrix(key: str, *blocks: DataFrame) -> DataFrame:
    """Blocks of columns side by side, by key."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, key)
    return out


def rank_code(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """The place of a value among the distinct values in order, from 0: a small table, joined back."""
    codes = df.select(column).distinct().withColumn(out, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(codes, column)

"""Text functions on columns: keywords, scores, normal forms, chunks, and passages that patterns find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases, words and weights of the relevance rules.
REPUTATION_PHRASES = (
    "fraud", "scandal", "illegal", "labour practices", "labor practices", "delayed", "late flights", "cancellation", "cancelled", "poor service", "complaint", "court case", "lawsuit", "legal action",
    "greedy", "executive pay", "bonus controversy", "shareholder revolt", "safety concerns", "incident", "accident", "investigation", "strike", "industrial action", "union dispute", "data breach", "privacy breach",
    "fine", "penalty", "discrimination", "harassment", "misconduct", "baggage", "lost luggage", "compensation", "refund", "regulatory breach", "violation", "price gouging", "ghost flights", "slot hoarding",
)
DAMAGE_WORDS = ("scandal", "fraud", "illegal", "fine", "penalty", "lawsuit", "strike", "breach", "investigation", "controversy", "crisis", "allegation", "accusation", "violation", "misconduct")
INDUSTRY_WORDS = ("airline", "flight", "aviation", "airport", "passenger", "customer", "service", "delay", "cancellation", "aircraft", "pilot", "crew", "baggage", "luggage", "booking")
EXECUTIVE_WORDS = ("ceo", "executive", "board", "director", "management", "chairman", "chief")
PROFIT_WORDS = ("profit", "earnings", "revenue", "results", "guidance", "loss", "dividend")


def words(items: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def matched(text: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases that occur in the lower-cased text, in their own order."""
    low = F.lower(text)
    return F.filter(words(phrases), lambda k: F.contains(low, F.lower(k)))


def any_word(text: Column, items: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for x in items:
        found = found | F.contains(text, F.lit(x))
    return found


def relevance(text: Column, trusted: Column, *, name: str, short: str, damage: tuple[str, ...] = DAMAGE_WORDS, industry: tuple[str, ...] = INDUSTRY_WORDS, executive: tuple[str, ...] = EXECUTIVE_WORDS) -> Column:
    """5 points for the name, else 3 for the short one; 2, 1 and 1.5 for each damage, industry and executive word; 2 for a trusted source beside a name; 10 at most."""
    low = F.lower(text)
    long_name, short_name = F.contains(low, F.lit(name)), F.contains(low, F.lit(short))
    points = F.when(long_name, 5.0).when(short_name, 3.0).otherwise(0.0)
    for items, weight in ((damage, 2.0), (industry, 1.0), (executive, 1.5)):
        points = points + F.size(F.filter(words(items), lambda k: F.contains(low, k))) * F.lit(weight)
    points = points + F.when((long_name | short_name) & F.coalesce(trusted, F.lit(False)), 2.0).otherwise(0.0)
    return F.least(points, F.lit(10.0))


def clean_for_embedding(text: Column, *, placeholder: str = "empty", most: int = 8000) -> Column:
    """White space collapsed, an empty text replaced, the rest cut."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.substring(F.coalesce(F.nullif(flat, F.lit("")), F.lit(placeholder)), 1, most)


def normal_form(text: Column) -> Column:
    """Lower case, repeated marks and white space collapsed."""
    out = F.lower(text)
    for mark in ("!", "?", ".", ","):
        out = F.regexp_replace(out, f"[{mark}]+", mark)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def dataset_text(df: DataFrame, column: str, *, lowercase: bool = True, remove_special: bool = False, least: int = 10) -> DataFrame:
    """Optional lower case and removal of all but letters, digits and spaces; shorter texts go."""
    text = F.lower(column) if lowercase else F.col(column)
    if remove_special:
        text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", "")
    return df.withColumn(column, text).filter(F.length(column) >= least)


def title_case(text: Column) -> Column:
    """Each word with a capital first letter."""
    return F.initcap(text)


def canonical(df: DataFrame, column: str, synonyms: dict[str, tuple[str, ...]], *, out: str, strip_period: bool = False) -> DataFrame:
    """The group of the lower-cased value, the first that has it; title case where none has.

    The synonyms are a small fixed table, so they are joined as one.
    """
    spark = df.sparkSession
    value = F.lower(F.trim(F.col(column)))
    value = F.regexp_replace(value, r"\.+$", "") if strip_period else value
    rows: dict[str, str] = {}
    for group, names in synonyms.items():
        for n in names:
            rows.setdefault(n, group)
    small = F.broadcast(spark.createDataFrame(list(rows.items()), "_synonym string, _group string"))
    joined = df.withColumn("_value", value).join(small, F.col("_value") == F.col("_synonym"), "left")
    return joined.withColumn(out, F.coalesce("_group", title_case(F.col("_value")))).drop("_value", "_synonym", "_group")


def chunked(df: DataFrame, key: str, text: str, *, size: int = 500) -> DataFrame:
    """(key, chunk, start, end, text): windows of ``size`` words with the numbers of their first word and of the one after the last."""
    w = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    rows = df.select(key, w.alias("_w")).filter(F.size("_w") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size)), lambda i: F.struct(i.alias("start"), F.least(i + size, F.size("_w")).alias("end"), F.array_join(F.slice("_w", i + 1, size), " ").alias("text")))
    return rows.select(key, F.posexplode(cut).alias("chunk", "_c")).select(key, "chunk", "_c.start", "_c.end", "_c.text")


def bullet_lines(df: DataFrame, key: str, text: str, *, least: int = 20, title: int = 200, most: int = 10) -> DataFrame:
    """(key, place, title): lines that begin with a number or a bullet, without it, longer than ``least``; the first ``most`` of each text."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    marked = F.filter(lines, lambda x: x.rlike(r"^(\d+[.)]|[-*•])\s*"))
    bare = F.filter(F.transform(marked, lambda x: F.trim(F.regexp_replace(x, r"^(\d+[.)]|[-*•])\s*", ""))), lambda x: F.length(x) > least)
    return df.select(key, F.posexplode(F.slice(bare, 1, most)).alias("place", "_t")).select(key, "place", F.substring("_t", 1, title).alias("title"))


def resolutions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, type, number, title, votes_for, votes_against): numbered, ordinary and special resolutions, and voting results."""

    def found(pattern: str, *groups: int) -> list[Column]:
        return [F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g)) for g in groups]

    def rows(columns: list[Column], names: list[str]) -> DataFrame:
        arrays = df.select(key, *[c.alias(n) for c, n in zip(columns, names, strict=True)])
        return arrays.select(key, F.explode(F.arrays_zip(*names)).alias("_r")).select(key, "_r.*")

    numbered = rows(found(r"(?i)Resolution\s+(\d+)[:\s]+([^\n]+)", 1, 2), ["number", "title"])
    numbered = numbered.select(key, F.lit("numbered_resolution").alias("type"), "number", F.trim("title").alias("title"))
    kinds = rows(found(r"(?i)(ORDINARY|SPECIAL)\s+RESOLUTION[:\s]+([^\n]+)", 1, 2), ["kind", "title"])
    kinds = kinds.select(key, F.concat(F.lower("kind"), F.lit("_resolution")).alias("type"), F.trim("title").alias("title"))
    votes = rows(found(r"(?is)(Resolution\s+\d+|Item\s+\d+)[^\n]*?(\d+\.?\d*)%\s+for.*?(\d+\.?\d*)%\s+against", 1, 2, 3), ["item", "f", "a"])
    votes = votes.select(key, F.lit("voting_result").alias("type"), F.col("item").alias("title"), F.col("f").cast("double").alias("votes_for"), F.col("a").cast("double").alias("votes_against"))
    return numbered.unionByName(kinds, allowMissingColumns=True).unionByName(votes, allowMissingColumns=True)


def json_in(text: Column) -> Column:
    """The JSON of a text: what stands in the first fence, else from the first brace to the last; null without either."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))

"""Dates out of fields, urls and snippets; spines of months and quarters; hosts of urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def host(url: Column) -> Column:
    """The host of a url in lower case, '' where there is none."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def article_date(field: Column, url: Column, snippet: Column) -> Column:
    """The date field if there is one (null where it is malformed), else the date in the url, else 'Mon D, YYYY' in the snippet."""
    from_url = F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(url, r"/(\d{4}-\d{2}-\d{2})/", 1), F.lit("")), F.lit("yyyy-MM-dd")))
    words = F.nullif(F.regexp_replace(F.regexp_extract(snippet, rf"\b((?:{_MONTHS})[a-z]* \d{{1,2}},? \d{{4}})", 1), r"^([A-Z][a-z]{2})[a-z]* (\d+),? (\d{4})$", "$1 $2 $3"), F.lit(""))
    from_text = F.to_date(F.try_to_timestamp(words, F.lit("MMM d yyyy")))
    own = F.nullif(field, F.lit(""))
    return F.when(own.isNotNull(), F.to_date(F.try_to_timestamp(F.substring(own, 1, 10), F.lit("yyyy-MM-dd")))).otherwise(F.coalesce(from_url, from_text))


def is_date(text: Column) -> Column:
    """Whether a text is YYYY-MM-DD and a day of the calendar."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_spine(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """(start_date, end_date) of each month from ``start`` to ``end``, both days included, the last month cut at ``end``."""
    rows = bounds.select(F.col(end).alias("_end"), F.explode(F.sequence(F.trunc(start, "month"), F.col(end), F.expr("interval 1 month"))).alias("_m"), F.col(start).alias("_start"))
    return rows.select(F.greatest("_m", "_start").alias("start_date"), F.least(F.last_day("_m"), F.col("_end")).alias("end_date"))


def quarter_spine(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """(year, quarter) of every quarter from one date to another."""
    rows = bounds.select(F.explode(F.sequence(F.trunc(start, "quarter"), F.col(end), F.expr("interval 3 months"))).alias("q"))
    return rows.select(F.year("q").alias("year"), F.quarter("q").alias("quarter"))


def corrected(df: DataFrame, name: str, date: str, known: tuple[tuple[str, str], ...]) -> DataFrame:
    """The date that is known for the first pattern in the name, else the one given."""
    out = F.col(date)
    for pattern, right in reversed(known):
        out = F.when(F.contains(F.lower(name), F.lit(pattern.lower())), F.lit(right).cast("date")).otherwise(out)
    return df.withColumn(date, out)

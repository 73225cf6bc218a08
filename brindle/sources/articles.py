"""Sources and sinks of articles: JSON trees, CSV, partitioned files, keys of content, and skipping what is known."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors see, below ``spark.checkpoint.dir``; where that is unset, a session on one machine has a temporary one and any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = context._brindle_folder = getattr(context, "_brindle_folder", None) or "file://" + tempfile.mkdtemp(prefix="brindle-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The frame, of a few short columns, marked for a broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scan_articles(spark: SparkSession, path: str, schema: str, *, skip_prefix: str = "scrape_", glob: str = "*.json", multi_line: bool = False) -> DataFrame:
    """Articles of a tree of JSON files that have key issues, without the files whose name begins with ``skip_prefix``."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", multi_line).json(path)
    return rows.filter(~F.col("_metadata.file_name").startswith(skip_prefix)).filter("ai_analysis.key_issues is not null").withColumn("full_content", F.coalesce("description", F.lit("")))


def scan_price_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The bars of documents {metadata, statistics, significant_drops, data: [...]}."""
    return spark.read.schema(schema).json(path).select(F.inline("data"))


def flattened(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns in order, lists as one text joined by ', ', for a CSV sink."""
    kinds = dict(df.dtypes)
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), ", ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns])


def slug(title: Column, most: int = 50) -> Column:
    """Letters, digits, spaces and hyphens of the title, cut, with runs of spaces and hyphens as one hyphen."""
    bare = F.substring(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s-]", ""), 1, most)
    return F.regexp_replace(F.trim(bare), r"[-\s]+", "-")


def file_key(url: Column, title: Column) -> Column:
    return F.concat(F.substring(F.md5(url), 1, 8), F.lit("_"), slug(title))


def unseen(new: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return new.join(seen.select(key), key, "left_anti")


def first_of(df: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The first row of each key; rows with an empty key go."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def recent(df: DataFrame, date: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``."""
    return df.filter(F.col(date) >= F.date_sub(as_of, days))


def content_keys(title: Column, url: Column, date: Column, text: Column) -> dict[str, Column]:
    """The keys under which results are stored."""
    return {
        "article_key": F.md5(F.concat_ws("_", title, url)),
        "snippet_key": F.md5(F.concat_ws("_", title, F.substring(text, 1, 200))),
        "event_key": F.concat_ws("|", title, date.cast("string"), F.substring(F.md5(text), 1, 8)),
        "url_key": F.substring(F.sha2(url, 256), 1, 16),
    }


def set_key(urls: Column) -> Column:
    """A key of a set of urls that doesn't depend on their order."""
    return F.md5(F.array_join(F.array_sort(urls), "|"))


def pair_key(a: Column, b: Column) -> Column:
    """A key of two contents that doesn't depend on their order."""
    x, y = F.md5(F.substring(a, 1, 1000)), F.md5(F.substring(b, 1, 1000))
    return F.concat_ws("_", F.least(x, y), F.greatest(x, y))


def memoized(requests: DataFrame, memo: DataFrame, key: str, compute) -> DataFrame:
    """All results: those of the memo, and what ``compute`` gives for the requests that it lacks."""
    known = requests.select(key).join(memo, key)
    return known.unionByName(compute(unseen(requests, memo, key)))


def coverage(spine: DataFrame, facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: how many of the spine's keys have facts and how many don't."""
    have = facts.select(*keys).distinct().withColumn("_found", F.lit(True))
    found = F.coalesce("_found", F.lit(False))
    return spine.join(have, list(keys), "left").agg(F.count_if(found).alias("found"), F.count_if(~found).alias("missing"))

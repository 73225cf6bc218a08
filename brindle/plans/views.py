"""Views over the star-schema tables that stand for prices, tagged events, articles, votes and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str) -> Column:
    return F.col(column).cast("date")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, open, high, low, close, volume): a day's first, greatest, least and last price of ``lineitem``."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    price = "l_extendedprice"
    return table(spark, sf_dir, "lineitem").groupBy(day("l_shipdate").alias("date")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.sum("l_quantity").cast("long").alias("volume")
    )


def raw_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, index_open, index_close) from ``orders``."""
    return table(spark, sf_dir, "orders").groupBy(day("o_orderdate").alias("date")).agg(F.min_by("o_totalprice", "o_orderkey").alias("index_open"), F.max_by("o_totalprice", "o_orderkey").alias("index_close"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_key, user_id, date, categories, magnitude): a user's day with its event types joined by '; '."""
    days = table(spark, sf_dir, "events").groupBy("user_id", day("ts").alias("date")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("categories"), F.max("value").alias("magnitude"))
    return days.withColumn("event_key", F.concat_ws("-", F.col("user_id").cast("string"), F.col("date").cast("string")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, description, date, lang, source) from ``documents``."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.col("doc_id").alias("id"), F.substring(text, 1, 60).alias("title"), text.alias("description"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 730).cast("int")).alias("date"), "lang", "source"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, date, label) from ``embeddings``."""
    shift = (F.col("vec_id") * 7 % 400).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.date_add(F.lit("2024-01-01").cast("date"), shift).alias("date"), "label")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, topic, against_pct, n): orders by year and priority stand for resolutions."""
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("topic"))
    return o.agg((F.lit(100.0) * F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("against_pct"), F.count("*").alias("n"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, company, date, category, stage, probability, amount) from ``orders``: events for rule scoring."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("name"),
        F.col("o_custkey").alias("company"),
        day("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("category"),
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("stage"),
        ((F.floor("o_totalprice") % 100) / F.lit(100.0)).alias("probability"),
        F.col("o_totalprice").alias("amount"),
    )


#: Lines that one task puts together by order.
LINES = 500_000


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, run, label, topic, confidence, score, quantity) from ``lineitem``: repeated extractions of a document.

    The lines are dealt by order, to more partitions the more there are, so that what one task sorts and sums doesn't grow with them.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.repartition(max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES)), "l_orderkey")
    return lines.select(
        F.col("l_orderkey").alias("doc_id"),
        F.row_number().over(order).alias("run"),
        F.col("l_returnflag").alias("label"),
        F.col("l_linestatus").alias("topic"),
        F.col("l_discount").alias("confidence"),
        F.col("l_tax").alias("score"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
    )


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, date, stakeholder, score, user_id) from ``events``."""
    score = F.floor("value").cast("int") % 11 - 5
    return table(spark, sf_dir, "events").select("event_id", day("ts").alias("date"), F.col("event_type").alias("stakeholder"), score.alias("score"), "user_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lang, source, n_chars, quality, toxic): documents that have labels."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


_ROW = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey)"

#: The same views in DuckDB's SQL; a later one may use an earlier one.
SQL_VIEWS = {
    "raw_bars": f"select cast(l_shipdate as date) as date, arg_min(l_extendedprice, {_ROW}) as open, max(l_extendedprice) as high, min(l_extendedprice) as low, arg_max(l_extendedprice, {_ROW}) as close, cast(sum(l_quantity) as bigint) as volume from lineitem group by 1",
    "raw_bench": "select cast(o_orderdate as date) as date, arg_min(o_totalprice, o_orderkey) as index_open, arg_max(o_totalprice, o_orderkey) as index_close from orders group by 1",
    "bars": "select date, round(open, 3) as open, round(high, 3) as high, round(low, 3) as low, round(close, 3) as close, volume, round(close - open, 3) as daily_change, round((close - open) / nullif(open, 0) * 100, 2) as daily_change_percent from raw_bars",
    "bench": "select date, index_open, index_close, round((index_close - index_open) / nullif(index_open, 0) * 100, 2) as index_change_percent from raw_bench",
    "joined": "select b.*, index_open, index_close, index_change_percent from bars b left join bench using (date)",
    "tags": "select user_id || '-' || date as event_key, * from (select user_id, cast(ts as date) as date, array_to_string(list_sort(list(distinct event_type)), '; ') as categories, max(value) as magnitude from events group by 1, 2)",
    "exploded": "select event_key, magnitude, tag from (select event_key, magnitude, unnest(string_split(categories, '; ')) as tag from tags)",
    "articles": "select doc_id as id, substr(coalesce(text, ''), 1, 60) as title, coalesce(text, '') as description, date '2023-01-01' + cast(doc_id % 730 as int) as date, lang, source from documents",
    "r": "select id, regexp_split_to_array(title, '[\\s.,]+')[1] || ' one' as a, lower(regexp_split_to_array(title, '[\\s.,]+')[1]) || ' two' as b from articles",
    "vectors": "select vec_id as id, embedding as vector, date '2024-01-01' + cast(vec_id * 7 % 400 as int) as date, label from embeddings",
    "votes": "select year(o_orderdate) as year, o_orderpriority as topic, 100.0::double * count(*) filter (o_orderstatus = 'F') / count(*) as against_pct, count(*) as n from orders group by 1, 2",
    "cases": "select o_orderkey as name, o_custkey as company, cast(o_orderdate as date) as date, o_orderpriority as category, cast(o_orderkey % 4 + 1 as int) as stage, (floor(o_totalprice)::bigint % 100) / 100.0::double as probability, o_totalprice as amount from orders",
    "runs": "select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as run, l_returnflag as label, l_linestatus as topic, l_discount as confidence, l_tax as score, l_quantity as quantity, l_partkey as part, l_suppkey as supplier from lineitem",
    "reactions": "select event_id, cast(ts as date) as date, event_type as stakeholder, cast(floor(value) as int) % 11 - 5 as score, user_id from events",
    "labelled": "select d.*, quality, toxic from documents d join labels using (doc_id)",
}

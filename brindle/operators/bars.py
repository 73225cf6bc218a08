"""Price bars: daily figures, a benchmark beside them, rolling means, extremes, and joins of events to prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.articles import few, stored
from .quality import with_position

#: Rows of a series that one task averages over, besides those that it gets from the range before.
IN_RANGE = 100_000


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def daily_bars(raw: DataFrame) -> DataFrame:
    """Rounded prices with the change over the day, absolute and in per cent; null where the opening price is 0."""
    prices = [F.round(c, 3).alias(c) for c in ("open", "high", "low", "close")]
    change = F.col("close") - F.col("open")
    return raw.select("date", *prices, "volume", F.round(change, 3).alias("daily_change"), F.round(percent(change, F.col("open")), 2).alias("daily_change_percent"))


def with_benchmark(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Adds the benchmark's bar of the same day and its change in per cent; null on days that it does not have."""
    change = F.round(percent(F.col("index_close") - F.col("index_open"), F.col("index_open")), 2)
    return bars.join(benchmark.select("date", "index_open", "index_close", change.alias("index_change_percent")), "date", "left")


def moving_averages(bars: DataFrame, windows: tuple[int, ...] = (7, 30, 90), *, series: str | None = None) -> DataFrame:
    """ma_n for each n: the mean close of the last n rows, of the same ``series`` where there are several; null until there are n.

    Rows in order are cut into ranges, and a range gets the last rows of the one before it, so that a long series is many tasks.
    """
    key = [series] if series else []
    length = max(IN_RANGE, *windows)
    placed = with_position(bars, *key, "date", out="_place")
    own, border = F.floor(F.col("_place") / length), F.pmod("_place", F.lit(length)) > length - max(windows)
    rows = placed.withColumn("_range", F.explode(F.array_compact(F.array(own, F.when(border, own + 1)))))
    for n in windows:
        w = Window.partitionBy("_range", *key).orderBy("_place").rowsBetween(1 - n, 0)
        rows = rows.withColumn(f"ma_{n}", F.when(F.count("close").over(w) == n, F.round(F.avg("close").over(w), 3)))
    return rows.filter(F.col("_range") == F.floor(F.col("_place") / length)).drop("_range", "_place")


def series_statistics(bars: DataFrame) -> DataFrame:
    """One row: days, first and last close, extremes, mean close and total return, and the same for the benchmark where it has rows."""
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    has = F.col("index_close").isNotNull()
    i_first, i_last = F.min_by(F.col("index_close"), F.when(has, F.col("date"))), F.max_by(F.col("index_close"), F.when(has, F.col("date")))
    return bars.agg(
        F.count("*").alias("days"),
        first.alias("first_close"),
        last.alias("last_close"),
        F.min("low").alias("min_low"),
        F.max("high").alias("max_high"),
        F.round(F.avg("close"), 3).alias("mean_close"),
        F.round(percent(last - first, first), 2).alias("total_return"),
        F.count("index_close").alias("index_days"),
        F.round(percent(i_last - i_first, i_first), 2).alias("index_return"),
    )


def worst_days(bars: DataFrame, *, below: float = -5.0, k: int = 20) -> DataFrame:
    """The k most negative days under a change in per cent; ties by date."""
    return bars.filter(F.col("daily_change_percent") < below).orderBy("daily_change_percent", "date").limit(k)


def significant_drops(bars: DataFrame, *, below: float = -3.0, k: int = 100) -> DataFrame:
    """The drops under a threshold with their rank from 1, the k largest."""
    drops = bars.filter(F.col("daily_change_percent") < below).orderBy("daily_change_percent", "date").limit(k)  # k rows are ranked
    return drops.withColumn("rank", F.row_number().over(Window.orderBy("daily_change_percent", "date")))


def market_context(change: Column, index_change: Column, *, market: float = -2.0, gap: float = 3.0) -> Column:
    """Whether a move goes with the market, is the stock's own, or is alike; Unknown without a benchmark."""
    return F.when(index_change.isNull(), "Unknown").when(index_change < market, "Market-wide").when(change < index_change - gap, "Stock-specific").otherwise("Similar to market")


def excess_movements(bars: DataFrame) -> DataFrame:
    """Days with a benchmark and the difference of both changes."""
    rows = bars.filter(F.col("index_change_percent").isNotNull() & F.col("daily_change_percent").isNotNull())
    return rows.select("date", "daily_change_percent", "index_change_percent", (F.col("daily_change_percent") - F.col("index_change_percent")).alias("excess"))


def both_tails(rows: DataFrame, column: str, n: int, *, tie: str = "date") -> DataFrame:
    """The n least and the n greatest rows, one after the other; a row may be in both when there are fewer than 2n."""
    low = rows.orderBy(column, tie).limit(n).withColumn("tail", F.lit("low"))
    high = rows.orderBy(F.desc(column), tie).limit(n).withColumn("tail", F.lit("high"))
    return low.unionAll(high)


def price_movement(events: DataFrame, bars: DataFrame, *, horizon: int, reach: int = 9, key: str = "event") -> DataFrame:
    """For each event the last bar within ``reach`` days up to its date, the first within ``reach`` days from ``horizon`` days on, and the change.

    Bars, not events, are spread over the days that they may serve: the nearest bar of each day is a row, which the events look up.
    Events without both bars are left out.
    """
    prices = bars.select(F.col("date").alias("bar"), F.col("close").alias("price"))
    spread = prices.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(reach))))

    def nearest(side: str, date: str) -> DataFrame:
        return spread.groupBy(F.expr(date).alias("date")).agg(F.min_by("bar", "step").alias(f"{side}_date"), F.min_by("price", "step").alias(f"{side}_price"))

    days = stored(nearest("start", "date_add(bar, step)").join(nearest("end", f"date_sub(bar, step + {int(horizon)})"), "date"), "nearest-bars")
    both = events.select(key, "date").join(few(days), "date")
    change = F.col("end_price") - F.col("start_price")
    return both.select(key, "date", "start_date", "end_date", "start_price", "end_price", F.round(change, 3).alias("change"), F.round(percent(change, F.col("start_price")), 2).alias("change_percent"))


def news_window(drops: DataFrame, articles: DataFrame, *, days: int = 10) -> DataFrame:
    """(drop date, article id): the articles of the days before a drop and of its day, joined on exploded days."""
    spread = drops.select(F.col("date").alias("drop_date"), F.explode(F.sequence(F.date_sub("date", days), F.col("date"))).alias("date"))
    return spread.join(articles.select("id", "date"), "date").select("drop_date", "id", "date")


def quarterly_drops(bars: DataFrame, *, below: float = -3.0) -> DataFrame:
    """Number of drop days in each quarter."""
    label = F.concat(F.year("date").cast("string"), F.lit(" Q"), F.quarter("date").cast("string"))
    return bars.filter(F.col("daily_change_percent") < below).groupBy(label.alias("quarter")).agg(F.count("*").alias("drops"))


def drop_summary(drops: DataFrame) -> DataFrame:
    """One row of counts by context and the five worst days; drops have date, market_context and n_articles."""
    five = drops.orderBy("daily_change_percent", "date").limit(5).withColumn("_rank", F.row_number().over(Window.orderBy("daily_change_percent", "date")))  # five rows
    day = F.struct("_rank", F.concat_ws(" ", F.col("date").cast("string"), F.col("daily_change_percent").cast("string")).alias("text"))
    worst = five.agg(F.transform(F.array_sort(F.collect_list(day)), lambda x: x["text"]).alias("worst_five"))
    return drops.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("market_context") == "Market-wide").alias("market_wide"),
        F.count_if(F.col("market_context") == "Stock-specific").alias("stock_specific"),
        F.count_if(F.col("n_articles") > 0).alias("with_news"),
        F.min("daily_change_percent").alias("worst"),
    ).crossJoin(worst)  # one row each

"""Queries over price bars and tagged events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bars as B
from ..operators import tags as T
from . import views as V
from .registry import query

BARS = "raw_bars bars"
JOINED = "raw_bars raw_bench bars bench joined"
CONTEXT = "case when index_change_percent is null then 'Unknown' when index_change_percent < -2 then 'Market-wide' when daily_change_percent < index_change_percent - 3 then 'Stock-specific' else 'Similar to market' end"


def bars(spark, d):
    return B.daily_bars(V.raw_bars(spark, d))


def joined(spark, d):
    return B.with_benchmark(bars(spark, d), V.raw_bench(spark, d))


@query("P0_worst_days_in_context", f"""
, ma as (select *, {', '.join(f"case when count(close) over w{n} = {n} then round(avg(close) over w{n}, 3) end as ma_{n}" for n in (7, 30, 90))}
  from joined window {', '.join(f'w{n} as (order by date rows between {n - 1} preceding and current row)' for n in (7, 30, 90))})
select date, close, daily_change_percent, index_change_percent, ma_7, ma_30, ma_90, {CONTEXT} as market_context from ma where daily_change_percent < -5 order by daily_change_percent, date limit 20""", JOINED)
def worst_in_context(spark, d):
    rows = B.worst_days(B.moving_averages(joined(spark, d)))
    context = B.market_context(F.col("daily_change_percent"), F.col("index_change_percent"))
    return rows.select("date", "close", "daily_change_percent", "index_change_percent", "ma_7", "ma_30", "ma_90", context.alias("market_context"))


@query("P1_daily_bars", "select * from bars", BARS)
def p1(spark, d):
    return bars(spark, d)


@query("P2_benchmark", "select * from joined", JOINED)
def p2(spark, d):
    return joined(spark, d)


@query("P3_moving_average", f"select date, close, {', '.join(f'case when count(close) over w{n} = {n} then round(avg(close) over w{n}, 3) end as ma_{n}' for n in (7, 30, 90))} from bars window {', '.join(f'w{n} as (order by date rows between {n - 1} preceding and current row)' for n in (7, 30, 90))}", BARS)
def p3(spark, d):
    return B.moving_averages(bars(spark, d).select("date", "close"))


SERIES = "s as (select l_returnflag || l_linestatus || case when l_suppkey % 5 < 3 then '' else '-' || l_suppkey % 50 end as series, l_shipdate::date as date, l_extendedprice as price, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem), daily as (select series, date, round(arg_max(price, row(l_orderkey, l_linenumber, l_partkey, l_suppkey)), 3) as close from s group by 1, 2)"


@query("P3_series_moving_average", f"with {SERIES} select series, date, close, {', '.join(f'case when count(close) over w{n} = {n} then round(avg(close) over w{n}, 3) end as ma_{n}' for n in (7, 30, 90))} from daily window {', '.join(f'w{n} as (partition by series order by date rows between {n - 1} preceding and current row)' for n in (7, 30, 90))}")
def p3_series(spark, d):
    """Many short series and a few long ones."""
    name = F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.when(F.col("l_suppkey") % 5 < 3, "").otherwise(F.concat(F.lit("-"), (F.col("l_suppkey") % 50).cast("string"))))
    last = F.max_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    daily = V.table(spark, d, "lineitem").groupBy(name.alias("series"), V.day("l_shipdate").alias("date")).agg(F.round(last, 3).alias("close"))
    return B.moving_averages(daily, series="series")


@query("P4_series_statistics", """, s as (select count(*) as days, arg_min(close, date) as first_close, arg_max(close, date) as last_close, min(low) as min_low, max(high) as max_high, round(avg(close), 3) as mean_close,
  count(index_close) as index_days, arg_min(index_close, date) filter (index_close is not null) as i1, arg_max(index_close, date) filter (index_close is not null) as i2 from joined)
select days, first_close, last_close, min_low, max_high, mean_close, round((last_close - first_close) / nullif(first_close, 0) * 100, 2) as total_return, index_days, round((i2 - i1) / nullif(i1, 0) * 100, 2) as index_return from s""", JOINED)
def p4(spark, d):
    return B.series_statistics(joined(spark, d))


@query("P5_worst_days", "select date, close, daily_change_percent from bars where daily_change_percent < -5 order by daily_change_percent, date limit 20", BARS)
def p5(spark, d):
    return B.worst_days(bars(spark, d)).select("date", "close", "daily_change_percent")


@query("P6_significant_drops", "select row_number() over (order by daily_change_percent, date) as rank, date, close, daily_change_percent from bars where daily_change_percent < -3 order by daily_change_percent, date limit 100", BARS)
def p6(spark, d):
    return B.significant_drops(bars(spark, d)).select("rank", "date", "close", "daily_change_percent")


@query("P7_market_context", f"select date, daily_change_percent, index_change_percent, {CONTEXT} as market_context from joined", JOINED)
def p7(spark, d):
    return joined(spark, d).select("date", "daily_change_percent", "index_change_percent", B.market_context(F.col("daily_change_percent"), F.col("index_change_percent")).alias("market_context"))


EXCESS = "select date, daily_change_percent, index_change_percent, daily_change_percent - index_change_percent as excess from joined where index_change_percent is not null and daily_change_percent is not null"


@query("P8_excess_movement", EXCESS, JOINED)
def p8(spark, d):
    return B.excess_movements(joined(spark, d))


@query("P9_both_tails", f", e as ({EXCESS}) select *, 'low' as tail from (select * from e order by excess, date limit 100) union all select *, 'high' as tail from (select * from e order by excess desc, date limit 100)", JOINED)
def p9(spark, d):
    return B.both_tails(B.excess_movements(joined(spark, d)), "excess", 100)


def _movement_sql(h: int) -> str:
    return f"""select event, date, start_date, end_date, start_price, end_price, round(end_price - start_price, 3) as change, round((end_price - start_price) / nullif(start_price, 0) * 100, 2) as change_percent from (
select name as event, c.date, b.date as start_date, b.close as start_price, a.date as end_date, a.close as end_price from cases c asof join bars b on c.date >= b.date asof join bars a on a.date >= c.date + {h})
where start_date >= date - 9 and end_date <= date + {h + 9}"""


for _h in (1, 7):

    @query(f"P10_price_movement_{_h}d", _movement_sql(_h), BARS + " cases")
    def p10(spark, d, h=_h):
        return B.price_movement(V.cases(spark, d).select(F.col("name").alias("event"), "date"), bars(spark, d), horizon=h)


@query("P11_news_window", ", drops as (select date + 9000 as date from bars where daily_change_percent < -5 order by daily_change_percent, date limit 20) select d.date as drop_date, a.id, a.date from drops d join articles a on a.date between d.date - 10 and d.date", BARS + " articles")
def p11(spark, d):
    drops = B.worst_days(bars(spark, d)).select(F.date_add("date", 9000).alias("date"))
    return B.news_window(drops, V.articles(spark, d))


@query("P12_profit_news", "select id, " + " or ".join(f"contains(lower(description), '{w}')" for w in ("the", "queux")) + " as flag from articles", "articles")
def p12(spark, d):
    return V.articles(spark, d).select("id", X.any_word(F.lower("description"), ("the", "queux")).alias("flag"))


@query("P13_conditional_tag", "select event_key, case when magnitude > 40 and not contains(categories, 'error') then categories || '; error' else categories end as categories from tags", "tags")
def p13(spark, d):
    t = V.tags(spark, d)
    return t.select("event_key", T.append_tag(F.col("categories"), F.col("magnitude") > 40, "error").alias("categories"))


@query("P14_quarterly_drops", "select year(date) || ' Q' || quarter(date) as quarter, count(*) as drops from bars where daily_change_percent < -3 group by 1", BARS)
def p14(spark, d):
    return B.quarterly_drops(bars(spark, d))


@query("P15_tag_means", "select tag, count(*) as events, round(avg(abs(magnitude)), 4) as mean_magnitude from exploded group by 1", "tags exploded")
def p15(spark, d):
    return T.tag_means(V.tags(spark, d))


@query("P16_tag_means_over_all", "select tag, round(sum(abs(magnitude)) / (select count(*) from tags), 4) as mean_magnitude from exploded group by 1", "tags exploded")
def p16(spark, d):
    return T.tag_means_over_all(V.tags(spark, d))


@query("P17_drop_summary", f", drops as (select date, daily_change_percent, {CONTEXT} as market_context, volume % 3 as n_articles from joined where daily_change_percent < -3) select count(*) as total, count(*) filter (market_context = 'Market-wide') as market_wide, count(*) filter (market_context = 'Stock-specific') as stock_specific, count(*) filter (n_articles > 0) as with_news, min(daily_change_percent) as worst, (select list(date || ' ' || daily_change_percent order by daily_change_percent, date) from (select * from drops order by daily_change_percent, date limit 5)) as worst_five from drops", JOINED)
def p17(spark, d):
    rows = joined(spark, d).filter("daily_change_percent < -3")
    context = B.market_context(F.col("daily_change_percent"), F.col("index_change_percent"))
    return B.drop_summary(rows.select("date", "daily_change_percent", context.alias("market_context"), (F.col("volume") % 3).alias("n_articles")))


PAIRS = "pairs as (select x.tag as a, y.tag as b, count(*) as n from exploded x join exploded y on x.event_key = y.event_key and x.tag < y.tag group by 1, 2)"
#: A relation for each pair of tags that the events table has: its strength goes by how often the second follows the first.
RELATIONS = """relations as (select a.tag as cause, b.tag as effect, case (length(a.tag) * 3 + length(b.tag)) % 3 when 0 then 'High' when 1 then 'Medium' else 'Immaterial' end as strength
from (select distinct tag from exploded) a, (select distinct tag from exploded) b where a.tag <> b.tag)"""
WAYS = """ways as (select p.*, coalesce(case f.strength when 'High' then 2 when 'Medium' then 1 end, 0) as rab, coalesce(case g.strength when 'High' then 2 when 'Medium' then 1 end, 0) as rba, f.strength as ab, g.strength as ba
from base p left join relations f on f.cause = p.a and f.effect = p.b left join relations g on g.cause = p.b and g.effect = p.a)"""


def relations(spark, d):
    """Raw relation rows of the tags, badly cased and with rows that don't count, for relation_table to clean."""
    t = T.exploded(V.tags(spark, d)).select("tag").distinct()
    pairs = t.select(F.col("tag").alias("cause")).join(t.select(F.col("tag").alias("effect")), F.col("cause") != F.col("effect"))
    rest = (F.length("cause") * 3 + F.length("effect")) % 3
    good = pairs.select(F.lit(2).alias("row_no"), F.concat(F.lit(" "), "cause").alias("cause"), "effect", F.when(rest == 0, " hIGH").when(rest == 1, "medium ").otherwise("IMMATERIAL").alias("strength"))
    early = pairs.select(F.lit(1).alias("row_no"), "cause", "effect", F.lit("High").alias("strength"))
    return good.unionByName(early).unionByName(pairs.select(F.lit(3).alias("row_no"), "cause", "effect", F.lit("unknown").alias("strength")))


@query("I5_relation_table", f", {RELATIONS} select * from relations", "tags exploded")
def i5(spark, d):
    return T.relation_table(relations(spark, d))


@query("P18_tag_cooccurrence", f", {PAIRS} select a, b, n, round(n / (max(n) over ()), 4) as share from pairs", "tags exploded")
def p18(spark, d):
    return T.cooccurrence(V.tags(spark, d))


@query("P19_tag_association", f""", {PAIRS}, base as (select * from pairs), {RELATIONS}, {WAYS}, alone as (select tag, count(*) as nt from exploded group by 1), total as (select count(*) as total from tags),
raw as (select case when rab >= rba then a else b end as cause, case when rab >= rba then b else a end as effect, n, n / case when rab >= rba then x.nt else y.nt end as given, n * total / (x.nt * y.nt) as lift
from ways join alone x on x.tag = a join alone y on y.tag = b, total where rab > 0 or rba > 0)
select cause, effect, n, round(given, 4) as given, round(lift, 4) as lift, round(given * lift / (max(given * lift) over ()), 4) as score from raw order by given * lift desc, cause, effect limit 10""", "tags exploded")
def p19(spark, d):
    return T.association(V.tags(spark, d), T.relation_table(relations(spark, d)))


for _high in (False, True):

    @query("P20_relation_matrix" + "_high" * _high, f""", {RELATIONS}, base as (select x.tag as a, y.tag as b from (select distinct tag from exploded) x join (select distinct tag from exploded) y on x.tag < y.tag), {WAYS}
select case when rab >= rba then a else b end as cause, case when rab >= rba then b else a end as effect, case when rab >= rba then ab else ba end as strength from ways where greatest(rab, rba) >= {1 + _high}""", "tags exploded")
    def p20(spark, d, high=_high):
        return T.relation_matrix(T.exploded(V.tags(spark, d)).select("tag").distinct(), T.relation_table(relations(spark, d)), high_only=high)


@query("F13_split_tags", "select event_key, list_sort(string_split(categories, '; ')) as tags from tags", "tags")
def f13(spark, d):
    return V.tags(spark, d).select("event_key", F.array_sort(T.split_tags(F.concat(F.lit("none; "), F.col("categories"), F.lit(";; No applicable categories")))).alias("tags"))


#: The fixed list of categories that tags are encoded against in the query.
CATEGORIES = ("click", "view", "purchase", "error", "login", "signup", "logout", "search", "share", "like", "refund", "cart", "visit", "other")


def one_hot(tags, categories):
    found = F.transform(tags, lambda x: F.lower(x))
    return [F.array_contains(found, F.lit(c.lower())).cast("int").alias(f"cat_{c.lower().replace(' ', '_')}") for c in categories]


@query("Q24_one_hot_tags", "select event_key, " + ", ".join(f"cast(list_contains(string_split(categories, '; '), '{c}') as int) as cat_{c}" for c in CATEGORIES) + " from tags", "tags")
def q24(spark, d):
    return V.tags(spark, d).select("event_key", *one_hot(T.split_tags(F.upper("categories")), CATEGORIES))

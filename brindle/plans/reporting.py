"""Queries of the reporting aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bars as B
from ..operators import reports as A
from ..operators import rules as R
from ..operators import tags as T
from . import prices
from . import views as V
from .registry import query
from .scoring import GRADE


def tagged(spark, d):
    return V.tags(spark, d).withColumn("list", T.split_tags(F.col("categories")))


@query("A1_kpi_summary", "select count(*) as events, count(*) filter (amount > 250000) as damage_events, round(count(*) filter (amount > 250000) * 100.0::double / count(*), 2) as damage_share, round(avg(stage) filter (amount > 250000), 4) as mean_damage, round(avg(probability) filter (amount > 250000), 4) as mean_response, round(avg(name % 7) filter (amount > 250000), 4) as articles_per_event from cases", "cases")
def a1(spark, d):
    return A.kpi_summary(V.cases(spark, d).withColumn("n", F.col("name") % 7), damaging=F.col("amount") > 250000, damage="stage", response="probability", articles="n")


@query("A2_severity_distribution", "select b as bucket, count(s) as n from (select cast(unnest(range(1, 6)) as int) as b) left join (select cast(round_even((name % 9) / 2 + 0.5::double, 0) as int) as s from cases) on b = s group by 1", "cases")
def a2(spark, d):
    return A.severity_distribution(V.cases(spark, d).select(((F.col("name") % 9) / 2 + 0.5).alias("score")), "score")


@query("A3_frequencies", "select tag as value, count(*) as n from exploded where tag <> 'error' group by 1", "tags exploded")
def a3(spark, d):
    return A.frequencies(tagged(spark, d), F.col("list"), without=("error",))


@query("A4_article_summary", "select strftime(date '2023-01-01' + cast(doc_id % 730 as int), '%Y-%m') as month, count(*) as articles, round(avg(case when s <> 0 then s end), 4) as mean_score, count(*) filter (s >= 4) as high_impact, count(*) filter (doc_id % 11 <= 3) as low_relevance from (select *, (quality + toxic * 4) as s from labelled) group by 1", "labelled")
def a4(spark, d):
    rows = V.labelled(spark, d).select((F.col("quality") + F.col("toxic") * 4).alias("s"), (F.col("doc_id") % 11).alias("r"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 730).cast("int")).alias("date"))
    return A.article_summary(rows, score="s", relevance="r", month=F.date_format("date", "yyyy-MM"))


@query("A5_analysis_lists", """select unnest(list_filter([case when toxic * 4 >= 4 then 'severe' end, case when quality * 3 <= 2 then 'poor response' end, case when coalesce(case when doc_id % 3 = 0 then doc_id % 5 end, 3) <= 2 then 'insincere' end], lambda x: x is not null)) as list, doc_id, substr(text, 1, 200) as facts from labelled""", "labelled")
def a5(spark, d):
    rows = V.labelled(spark, d).select("doc_id", "text", (F.col("toxic") * 4).alias("damage"), (F.col("quality") * 3).alias("response"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 5).alias("sincerity"))
    return A.analysis_lists(rows, key="doc_id", damage="damage", response="response", sincerity="sincerity", facts="text")


WORDS = ("the", "queux", "ción", "ung", "est")


@query("A6_keyword_and_source_counts", f"select k as value, 'keyword' as kind, count(*) as n from (select unnest(list_filter({list(WORDS)!r}, lambda w: contains(lower(description), w))) as k from articles) group by 1 union all select source, 'source', count(*) from articles group by 1", "articles")
def a6(spark, d):
    a = V.articles(spark, d)
    words = A.frequencies(a, X.matched(F.col("description"), WORDS)).select("value", F.lit("keyword").alias("kind"), "n")
    return words.unionByName(a.groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n")).select("value", F.lit("source").alias("kind"), "n"))


@query("A7_articles_by_month", "select case when id % 9 = 0 then 'unknown' else strftime(date, '%Y-%m') end as month, count(*) as articles from articles group by 1", "articles")
def a7(spark, d):
    month = F.coalesce(F.when(F.col("id") % 9 != 0, F.date_format("date", "yyyy-MM")), F.lit("unknown"))
    return V.articles(spark, d).groupBy(month.alias("month")).agg(F.count("*").alias("articles"))


@query("A8_month_timeline", "select strftime(date, '%Y-%m') as month, count(*) as events, round(sum(stage::double), 2) as total_damage, round(avg(stage), 4) as mean_damage, list_sort(list(distinct category)) as categories, list_sort(list(distinct 's' || stage)) as stakeholders from cases group by 1", "cases")
def a8(spark, d):
    return A.month_timeline(V.cases(spark, d).withColumn("stage", F.col("stage").cast("double")), date="date", damage="stage", categories=F.array("category"), stakeholders=F.array(F.concat(F.lit("s"), F.col("stage").cast("int").cast("string"))))


@query("A9_event_markers", "select name, date, stage from (select * from cases order by date, name limit 100) where stage >= 3", "cases")
def a9(spark, d):
    return A.event_markers(V.cases(spark, d).select("name", "date", "stage"), date="date", key="name", damage="stage")


@query("A10_severity_timeline", f"select name, cast(date as varchar) as date, {GRADE} as grade from cases where name % 2 = 0 and name % 3 <> 0 and name % 5 <> 0", "cases")
def a10(spark, d):
    c = V.cases(spark, d)
    grade = F.when(F.col("name") % 5 != 0, R.severity_grade(F.col("stage"), F.col("probability")))
    results = c.select("name", F.when(F.col("name") % 3 == 0, F.date_format("date", "yyyy")).otherwise(F.concat(F.col("date").cast("string"), F.lit("T00:00"))).alias("date_text"), grade.alias("grade"))
    return A.severity_timeline(results, c.select("name", (F.col("name") % 2 == 0).alias("relevant")))


@query("A11_enriched_top", f"select name, grade, probability, case when name % 2 = 0 then category || '!' end as info from (select *, {GRADE} as grade from cases) where grade >= 4 order by grade desc, probability desc, name limit 6", "cases")
def a11(spark, d):
    c = V.cases(spark, d)
    results = c.select("name", R.severity_grade(F.col("stage"), F.col("probability")).alias("grade"), "probability")
    even = c.filter("name % 2 = 0")
    events = even.select("name", F.col("category").alias("info"), F.lit(1).alias("place")).unionByName(even.select("name", F.concat("category", F.lit("!")).alias("info"), F.lit(2).alias("place")))
    return A.enriched_top(results, events)


@query("A12_top_responses", "select category as value, count(*) as n, case category when '1-URGENT' then 'best' when '5-LOW' then 'poor' else 'unclassified' end as class from cases group by 1 order by n desc, value limit 8", "cases")
def a12(spark, d):
    counts = V.cases(spark, d).groupBy(F.col("category").alias("value")).agg(F.count("*").alias("n"))
    return A.classed_top(counts, spark.createDataFrame([("1-urgent", "best"), ("5-low", "poor")], "slug string, class string"))


@query("A13_top_stakeholders", "select stakeholder, count(*) as n from reactions group by 1 order by n desc, stakeholder limit 8", "reactions")
def a13(spark, d):
    return A.top(V.reactions(spark, d).groupBy("stakeholder").agg(F.count("*").alias("n")), 8, "n", "stakeholder")


@query("A14_drill_down", "select event_key, magnitude from tags where list_contains(string_split(categories, '; '), 'error') order by magnitude desc, event_key limit 50", "tags")
def a14(spark, d):
    return A.drill_down(tagged(spark, d), "error", column="list", damage="magnitude", key="event_key").select("event_key", "magnitude")


@query("A14_category_counts", "select category, count(*) as n from (select unnest(l) as category from (select string_split(categories, '; ') as l from tags) where list_contains(l, 'error')) where category <> 'error' group by 1", "tags")
def a14_categories(spark, d):
    return A.drill_down_categories(tagged(spark, d), "error", column="list")


@query("A15_trajectory", ", m as (select user_id as event, date, stakeholder, case when sum(score) % 4 <> 0 then sum(score) end as score from reactions group by 1, 2, 3) select event, date, stakeholder, cast(score as bigint) as score from m where score is not null and stakeholder not in ('error', 'view')", "reactions")
def a15(spark, d):
    s = V.reactions(spark, d).groupBy(F.col("user_id").alias("event"), "date", "stakeholder").agg(F.sum("score").alias("s"))
    maps = s.groupBy("event", "date").agg(F.map_from_entries(F.collect_list(F.struct("stakeholder", F.when(F.col("s") % 4 != 0, F.col("s")).alias("score")))).alias("m"))
    return A.trajectory(maps, reactions="m", without=("error", "view"))


@query("A16_two_stakeholders", "select event_id, date, stakeholder, score, case when score >= 2 then 'positive' when score <= -2 then 'negative' else 'neutral' end as band from reactions where stakeholder in ('click', 'purchase')", "reactions")
def a16(spark, d):
    rows = V.reactions(spark, d).filter(F.col("stakeholder").isin("click", "purchase"))
    return rows.select("event_id", "date", "stakeholder", "score", A.score_band(F.col("score")).alias("band"))


@query("A17_prediction_summary", "select label, count(*) as n, round(avg(id % 100 / 100.0::double), 4) as mean_confidence, round(count(*) * 100.0::double / (select count(*) from vectors), 2) as percent from vectors group by 1", "vectors")
def a17(spark, d):
    return A.prediction_summary(V.vectors(spark, d).withColumn("c", F.col("id") % 100 / 100.0), label="label", confidence="c")


@query("A18_cost_ledger", "select role as model, count(*) as requests, sum(length(text) // 4)::bigint as tokens_in, sum(turn)::bigint as tokens_out, round(sum((length(text) // 4) / 1000 * case role when 'user' then 0.0025::double when 'assistant' then 0.03::double else 0.00015::double end + turn / 1000 * case role when 'user' then 0.01::double when 'assistant' then 0.06::double else 0.0006::double end), 6) as cost from conversations group by 1")
def a18(spark, d):
    requests = V.table(spark, d, "conversations").select(F.col("role").alias("model"), F.floor(F.length("text") / 4).alias("tokens_in"), F.col("turn").alias("tokens_out"))
    rates = spark.createDataFrame([("user", 0.0025, 0.01), ("assistant", 0.03, 0.06)], "model string, rate_in double, rate_out double")
    return A.cost_ledger(requests, rates, default=(0.00015, 0.0006))


@query("A19_cost_forecast", "select texts, t as tokens_in, round((t / 1000 * 0.00015::double + 500 / 1000 * 0.0006::double) * texts, 6) as cost from (select count(*) as texts, cast(floor(floor(avg(length(description))) / 4) as bigint) as t from articles)", "articles")
def a19(spark, d):
    return A.cost_forecast(V.articles(spark, d), "description", rate_in=0.00015, rate_out=0.0006, tokens_out=500)


@query("A20_compared_runs", "select metric, round(max(value) filter (model = 'R'), 6) as R, round(max(value) filter (model = 'N'), 6) as N, round(max(value) filter (model = 'A'), 6) as A from (select l_returnflag as model, 'mean price' as metric, avg(l_extendedprice) as value from lineitem group by 1 union all select l_returnflag, 'rows', count(*) from lineitem group by 1) group by 1")
def a20(spark, d):
    g = V.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.avg("l_extendedprice").alias("p"), F.count("*").cast("double").alias("n"))
    metrics = g.select("model", F.expr("stack(2, 'mean price', p, 'rows', n) as (metric, value)"))
    out = A.compared(metrics, ("R", "N", "A"))
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("R", "N", "A")])


@query("A21_residuals", f", e as ({prices.EXCESS}), s as (select *, index_change_percent - excess as residual from e) select date, excess, index_change_percent, residual, 'bottom' as side from (select * from s order by excess, date limit 3) union all select date, excess, index_change_percent, residual, 'top' from (select * from s order by excess desc, date limit 3)", prices.JOINED)
def a21(spark, d):
    return A.residuals(B.excess_movements(prices.joined(spark, d)), key="date", actual="excess", predicted="index_change_percent")

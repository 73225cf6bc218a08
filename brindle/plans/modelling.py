"""Queries that fit models, and queries that drain streams."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import functions as F

from ..operators import factors as N
from ..operators import models as M
from ..operators import topics as T
from ..sources.articles import shared_folder, stored
from ..streaming import articles as ST
from . import views as V
from .registry import query

FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


def rows(spark, d):
    return M.dealt(V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", *[F.col(c).cast("double").alias(c) for c in FEATURES], F.col("l_extendedprice").alias("target")))


_FORESTS: dict = {}


def forest(spark, d):
    """The forest of several queries, fitted once for each session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FORESTS:
        _FORESTS[key] = M.fit(rows(spark, d), FEATURES)
    return _FORESTS[key]


@query("M1_components")
def m1(spark, d):
    scores, _ = M.components(V.vectors(spark, d), k=10)
    return scores.select("id", "component", F.round("score", 6).alias("score"))


@query("M5_lda_topics")
def m5(spark, d):
    shares, _ = M.lda_topics(V.articles(spark, d), key="id", text="description")
    return shares.select("id", "topic", F.round("share", 4).alias("share"))


@query("M6_factor_topics")
def m6(spark, d):
    shares, _, _ = N.topics(V.articles(spark, d), key="id", text="description")
    return shares.select("id", "topic", F.round("share", 4).alias("share"))


@query("M6_topic_terms")
def m6_terms(spark, d):
    _, terms, _ = N.topics(V.articles(spark, d), key="id", text="description")
    return terms.select("topic", "place", "term", F.round("weight", 6).alias("weight"))


def _length_tails(spark, d):
    a = V.articles(spark, d).select("id", F.length("description").cast("double").alias("score"), F.lit("c1").alias("component"))
    return T.tails(a, 50)


@query("M7_tail_only_topics")
def m7(spark, d):
    ids = _length_tails(spark, d).select("id").distinct()
    docs = V.articles(spark, d).join(ids, "id", "left_semi")
    return N.tail_only_topics(docs, key="id", text="description", k=20)


@query("M9_tail_topics")
def m9(spark, d):
    ends = stored(_length_tails(spark, d), "tails")
    shares, _ = M.lda_topics(V.articles(spark, d), key="id", text="description", only=ends)
    return M.tail_topics(ends, shares).select("component", "tail", "topic", "place")


@query("M15_probe")
def m15(spark, d):
    names = ("chars", "word_length", "type_token", "punctuation", "digits", "upper")
    style = V.articles(spark, d).select("id", *T.style_features(F.col("description"))).select("id", *[F.col(c).cast("double").alias(c) for c in names])
    high = T.tails(style.select("id", F.col("chars").alias("score"), F.lit("c1").alias("component")), 50).filter("tail = 'high'").select("id", F.lit(True).alias("high"))
    probed = M.probe(style.join(high, "id", "left"), names, F.coalesce("high", F.lit(False)))
    return probed.select("feature", F.round("coefficient", 4).alias("coefficient"))


@query("M24_forest_metrics")
def m24(spark, d):
    r = rows(spark, d)
    return M.regression_metrics(M.predicted(forest(spark, d), r, FEATURES))


@query("M24_metrics", "select round(sqrt(avg(e * e)), 6) as rmse, round(avg(abs(e)), 6) as mae, round(1 - sum(e * e) / (var_pop(t) * count(*)), 6) as r2, round(avg(abs(e) / (abs(t) + 1e-10)) * 100, 6) as mape from (select l_extendedprice as t, l_quantity * 2000 - l_extendedprice as e from lineitem)")
def m24_metrics(spark, d):
    return M.regression_metrics(rows(spark, d).withColumn("prediction", F.col("l_quantity") * 2000))


@query("M25_pipeline_evaluation")
def m25(spark, d):
    r = rows(spark, d)
    found = M.evaluate(M.predicted(forest(spark, d), r, FEATURES))
    return spark.createDataFrame(sorted(found.items()), "metric string, value double")


@query("M25_label_metrics", "with r as (select l_returnflag as a, case when l_quantity < 17 then 'A' when l_quantity < 34 then 'R' else 'N' end as p from lineitem), e as (select a, count(*) as n, count(*) filter (a = p) as hits, (select count(*) from r x where x.p = r.a) as said from r group by 1) select round(sum(hits) / sum(n), 6) as accuracy, round(sum(2 * hits / (n + said) * n) / sum(n), 6) as f1 from e")
def m25_labels(spark, d):
    said = F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "R").otherwise("N")
    return M.label_metrics(V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("target"), said.alias("prediction")))


@query("M26_model_choice")
def m26(spark, d):
    r = rows(spark, d)
    with ThreadPool(1) as pool:  # boosted trees wait for each other, so a forest grows beside them
        boosted = pool.apply_async(M.fit, (r, FEATURES), {"kind": "boosted"})
        models = {"forest": forest(spark, d), "boosted": boosted.get()}
    parts = [M.regression_metrics(M.predicted(m, r, FEATURES)).withColumn("model", F.lit(kind)) for kind, m in models.items()]
    return parts[0].unionByName(parts[1])


@query("M27_time_folds", "select event_id, cast(case when p < n - 5 * (n // 6) then 0 else (p - (n - 5 * (n // 6))) // (n // 6) + 1 end as int) as fold from (select event_id, row_number() over (order by ts, event_id) - 1 as p, count(*) over () as n from events)")
def m27(spark, d):
    return M.time_folds(V.table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", k=5).select("event_id", "fold")


@query("M27_cross_validation")
def m27_metrics(spark, d):
    folded = M.shuffled_folds(rows(spark, d).withColumn("k", F.concat_ws("-", F.col("l_orderkey"), F.col("l_partkey"))), "k", k=5)
    return M.cross_validated(folded, FEATURES, expanding=False)


@query("M27_expanding_folds")
def m27_expanding(spark, d):
    dated = V.table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(f"f_{c}") for c in FEATURES], F.col("l_extendedprice").alias("target"))
    folded = M.time_folds(dated, "l_shipdate", "l_orderkey", "l_linenumber", k=5)
    return M.cross_validated(folded, tuple(f"f_{c}" for c in FEATURES), expanding=True)


@query("M27_stratified_folds", "select doc_id, toxic, cast((row_number() over (partition by toxic, g order by doc_id) - 1 + g) % 5 + 1 as int) as fold from (select doc_id, toxic, (('0x' || md5(doc_id::varchar)[1:8])::ubigint % 64)::bigint as g from labels)")
def m27_stratified(spark, d):
    return M.stratified_folds(V.table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@query("M28_importances")
def m28(spark, d):
    return M.importances(forest(spark, d), FEATURES, spark)


@query("M29_partial_dependence")
def m29(spark, d):
    r = rows(spark, d).withColumn("k", F.concat_ws("-", F.col("l_orderkey"), F.col("l_partkey")))
    return M.partial_dependence(forest(spark, d), r, FEATURES, key="k")


@query("M30_saved_model")
def m30(spark, d):
    r, path = rows(spark, d), shared_folder(spark, "model")
    M.save(forest(spark, d), path)
    return M.regression_metrics(M.predicted(M.load(path), r, FEATURES))


def _arrivals(spark, df, name):
    """The rows as the files of a stream, in a few parts."""
    path = shared_folder(spark, name)
    df.repartition(4).write.parquet(path)
    return ST.stream(spark, path, df.schema)


@query("S1_new_urls", "select url, min(page_id) % 2 as run from (select url, page_id from pages where url <> '' and url not in (select url from pages where page_id % 5 = 0 and url is not null)) group by url having min(page_id % 2) = max(page_id % 2) union all select url, 0 from (select url from pages where url <> '' and url not in (select url from pages where page_id % 5 = 0 and url is not null) group by url having min(page_id % 2) < max(page_id % 2))")
def s1(spark, d):
    """Pages with even ids come in the first run of a stream; all pages come half a year later, after a restart.  A fifth is stored already."""
    pages = V.table(spark, d, "pages").select("url", "page_id")
    known, source, kept = pages.filter("page_id % 5 = 0 and url is not null"), shared_folder(spark, "url-stream"), shared_folder(spark, "urls")
    for run, (some, day) in enumerate(((pages.filter("page_id % 2 = 0"), "2024-01-01"), (pages, "2024-07-01"))):
        rows = some.select("url", F.lit(day).cast("timestamp_ntz").cast("timestamp").alias("ts"), F.lit(run).cast("long").alias("run"))
        rows.repartition(4).write.mode("append").parquet(source)
        found = ST.drained(ST.new_keys(ST.stream(spark, source, rows.schema), "url", known=known), kept)
    return found.select("url", "run")


@query("S2_monthly_counts", "select strftime(ts, '%Y-%m') as month, count(*) as n, round(sum(value), 2) as total from events group by 1")
def s2(spark, d):
    e = V.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    days = ST.drained(ST.monthly_counts(_arrivals(spark, e, "event-stream"), "ts"), shared_folder(spark, "days"), mode="update")
    return ST.by_month(ST.latest(days, "day"))


@query("S3_rolling_rerun", "select event_id from events where ts >= (select max(ts) from events) - interval 10 day")
def s3(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    newest = e.agg(F.max("ts").alias("m")).first()["m"]
    kept = _arrivals(spark, e, "rerun-stream").withWatermark("ts", "90 days").filter(F.col("ts") >= F.lit(newest) - F.expr("interval 10 days"))
    return ST.drained(kept, shared_folder(spark, "rerun")).select("event_id")


@query("S4_interval_join", "select a.user_id, a.event_id as left_id, b.event_id as right_id from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and a.ts between b.ts - interval 10 day and b.ts")
def s4(spark, d):
    e = V.table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    left, right = _arrivals(spark, e.filter("event_type = 'click'"), "clicks"), _arrivals(spark, e.filter("event_type = 'purchase'"), "purchases")
    # the test stream's files are in no order, so lateness covers all of it
    return ST.drained(ST.interval_join(left, right, "user_id", days=10, late="60 days"), shared_folder(spark, "intervals"))

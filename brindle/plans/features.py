"""Queries over dataset quality, validation and feature encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import quality as Q
from . import views as V
from .registry import query


def runs(spark, d):
    return V.runs(spark, d)


@query("Q1_validation_report", ", t as (select text, case when doc_id % 10 <> 0 then quality * 2.0::double - toxic end as target, date '2023-01-01' + cast(doc_id % 730 as int) as date from labelled) select count(*) as rows, count(*) filter (text is null or trim(text) = '') as empty_texts, count(*) filter (target is null) as missing_targets, count(*) filter (date is null) as missing_dates, min(date) as first_date, max(date) as last_date, min(target) as min_target, max(target) as max_target, round(avg(target), 6) as mean_target, round(stddev_samp(target), 6) as std_target, cast(min(length(text)) as int) as min_length, cast(max(length(text)) as int) as max_length, round(avg(length(text)), 4) as mean_length, true as valid from t", "labelled")
def q1(spark, d):
    rows = V.labelled(spark, d).select("text", F.when(F.col("doc_id") % 10 != 0, F.col("quality") * 2.0 - F.col("toxic")).alias("target"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 730).cast("int")).alias("date"))
    return Q.validation_report(rows, text="text", target="target", date="date")


@query("Q2_temporal_split", "select event_id, p as position, case when p < floor(n * 0.7) then 'train' when p >= floor(n * 0.7) + 5 and p < floor(n * 0.7) + 5 + floor(n * 0.15) then 'validate' when p >= floor(n * 0.7) + 10 + floor(n * 0.15) then 'test' end as split from (select event_id, row_number() over (order by ts, event_id) - 1 as p, count(*) over () as n from events)")
def q2(spark, d):
    return Q.temporal_split(V.table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", gap=5).select("event_id", "position", "split")


@query("Q3_diversity", r"select *, (select count(distinct w) from (select unnest(regexp_split_to_array(lower(text), '\s+')) as w from labelled) where w <> '') as vocabulary from (select round(count(distinct text) / count(*), 6) as distinct_share, round(avg(length(text)), 4) as mean_length, round(avg(n_chars), 6) as mean_target, round(stddev_samp(n_chars), 6) as std_target, quantile_cont(n_chars, 0.25) as q1, quantile_cont(n_chars, 0.5) as median, quantile_cont(n_chars, 0.75) as q3 from labelled)", "labelled")
def q3(spark, d):
    return Q.diversity(V.labelled(spark, d), text="text", target="n_chars")


@query("Q4_diversity_score", "select round((count(distinct label) / count(*) + count(distinct topic) / count(*) + least(stddev_samp(quantity) / avg(quantity), 1) + least(stddev_samp(score) / avg(score), 1)) / 4, 6) as diversity from runs", "runs")
def q4(spark, d):
    return Q.diversity_score(runs(spark, d), texts=("label", "topic"), numbers=("quantity", "score"))


@query("Q5_completeness", "select round((count(doc_id) + count(quality) + count(toxic)) / (count(*) * 3), 6) as completeness from (select d.doc_id, quality, toxic from documents d left join labels using (doc_id))")
def q5(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id").join(V.table(spark, d, "labels"), "doc_id", "left")
    return Q.completeness(rows, ("doc_id", "quality", "toxic"))


PAIR = "pair as (select a.doc_id, a.label as l1, b.label as l2, a.topic as t1, b.topic as t2, a.quantity as q1, b.quantity as q2, a.score as s1, b.score as s2 from runs a join runs b on a.doc_id = b.doc_id and a.run = 1 and b.run = 2)"


def two_runs(spark, d):
    r = runs(spark, d)
    one, two = r.filter("run = 1"), r.filter("run = 2")
    return one.join(two, "doc_id", "left_semi"), two


@query("Q6_consistency", f", {PAIR} select round((avg(cast(l1 = l2 as int)) + avg(cast(t1 = t2 as int)) + abs(corr(q1, q2)) + abs(corr(s1, s2))) / 4, 6) as consistency from pair", "runs")
def q6(spark, d):
    return Q.consistency(*two_runs(spark, d), "doc_id", texts=("label", "topic"), numbers=("quantity", "score"))


IV = "select round(sum(case when good > 0 and bad > 0 then (good / goods - bad / bads) * ln((good / goods) / (bad / bads)) else 0 end), 6) as information_value from (select count(*) filter (toxic = 0) as good, count(*) filter (toxic = 1) as bad from {0} group by {1}), (select count(*) filter (toxic = 0) as goods, count(*) filter (toxic = 1) as bads from labelled)"


@query("Q7_categorical_iv", IV.format("labelled", "lang"), "labelled")
def q7(spark, d):
    return Q.categorical_iv(V.labelled(spark, d), "lang", F.col("toxic") == 1)


@query("Q8_numeric_iv", ", e as (select list_distinct(quantile_cont(n_chars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as edges from labelled), b as (select toxic, len(list_filter(edges, lambda x: x < n_chars)) as bin from labelled, e) " + IV.format("b", "bin"), "labelled")
def q8(spark, d):
    return Q.numeric_iv(V.labelled(spark, d), "n_chars", F.col("toxic") == 1)


MANY = ", b as (select {0} as feature, source = (select source from labelled where source is not null group by 1 order by count(*) desc, 1 limit 1) as bad from labelled), c as (select count(*) filter (not bad) as good, count(*) filter (bad) as bad from b where feature is not null group by feature), t as (select count(*) filter (not bad) as goods, count(*) filter (bad) as bads from b) select round(sum(case when good > 0 and bad > 0 then (good / goods - bad / bads) * ln((good / goods) / (bad / bads)) else 0 end), 6) as information_value from c, t"


@query("Q7_many_classes_iv", MANY.format("lang"), "labelled")
def q7_many(spark, d):
    return Q.information_value(V.labelled(spark, d).filter("source is not null"), "lang", "source")


@query("Q7_number_iv", ", k as (select lang, row_number() over (order by lang) - 1 as code from (select distinct lang from labelled)) select round(abs(corr(code, n_chars)), 6) as information_value from labelled join k using (lang)", "labelled")
def q7_number(spark, d):
    return Q.information_value(V.labelled(spark, d), "lang", "n_chars")


@query("Q8_number_iv", ", e as (select list_distinct(quantile_cont(n_chars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as edges from labelled), b as (select quality::double as quality, len(list_filter(edges, lambda x: x < n_chars)) as bin from labelled, e), k as (select bin, row_number() over (order by bin) - 1 as code from (select distinct bin from b)) select round(abs(corr(code, quality)), 6) as information_value from b join k using (bin)", "labelled")
def q8_number(spark, d):
    return Q.information_value(V.labelled(spark, d).withColumn("quality", F.col("quality").cast("double")), "n_chars", "quality", binned=True)


@query("Q9_schema_compliance", "select field, compliance, compliance >= 0.95 as ok from (select 'label' as field, round(avg(cast(label in ('A', 'N') as int)), 6) as compliance from runs union all select 'confidence', round(avg(cast(confidence between 0 and 0.09 as int)), 6) from runs union all select 'topic', round(avg(cast(topic is not null as int)), 6) from runs)", "runs")
def q9(spark, d):
    return Q.schema_compliance(runs(spark, d), {"label": F.col("label").isin("A", "N"), "confidence": F.col("confidence").between(0, 0.09), "topic": F.col("topic").isNotNull()})


HALLUCINATION = "least(1.0::double, (case when contains(lower(description), 'tionre') then 0 else 1 end + case when contains(lower(description), 'queux') then 0 else 1 end) * 0.1::double + case when contains(lower(description), lower(source)) then 0 else 1 end * 0.1::double + (case when contains(lower(description), lower(title)) then 0 else 1 end + case when contains(lower(description), 'ung') then 0 else 1 end) / 2 * 0.2::double)"


@query("Q10_hallucination", f"select id, round({HALLUCINATION}, 6) as score, round({HALLUCINATION}, 6) > 0.3 as suspicious from articles", "articles")
def q10(spark, d):
    score = F.round(Q.hallucination((F.array(F.lit("TIONRE"), F.lit("queux")), F.array("source")), F.array(F.col("title"), F.lit("ung")), F.col("description")), 6)
    return V.articles(spark, d).select("id", score.alias("score"), (score > 0.3).alias("suspicious"))


CONFIDENCE = "least(1.0::double, coalesce(case when run % 3 <> 0 then confidence * 10 end, 0.5::double) + (1 + cast(quantity > 25 as int) + cast(label = 'A' as int)) / 3 * 0.3::double)"


def confidence():
    base = F.when(F.col("run") % 3 != 0, F.col("confidence") * 10)
    return Q.confidence(base, (F.col("topic").isNotNull(), F.col("quantity") > 25, F.col("label") == "A"))


@query("Q11_confidence", f"select doc_id, run, round({CONFIDENCE}, 6) as confidence from runs", "runs")
def q11(spark, d):
    return runs(spark, d).select("doc_id", "run", F.round(confidence(), 6).alias("confidence"))


@query("Q12_low_confidence", f", c as (select doc_id, run, round({CONFIDENCE}, 6) as c from runs) select doc_id, run, c from c where c < (select quantile_cont(c, 0.25) from c)", "runs")
def q12(spark, d):
    return Q.below_quantile(runs(spark, d).select("doc_id", "run", F.round(confidence(), 6).alias("c")), "c")


@query("Q13_batch_verdict", "select count(*) as rows, count(*) filter (score > 0.07) as suspicious, count(*) filter (confidence < 0.02) as low_confidence, round(avg(cast(quantity >= 3 as int)), 6) as compliance, case when round(avg(cast(quantity >= 3 as int)), 6) >= 0.95 and count(*) filter (score > 0.07) / count(*) < 0.1 then 'accept' when round(avg(cast(quantity >= 3 as int)), 6) >= 0.8 and count(*) filter (score > 0.07) / count(*) < 0.3 then 'review' else 'reject' end as verdict from runs", "runs")
def q13(spark, d):
    return Q.batch_verdict(runs(spark, d), suspicious=F.col("score") > 0.07, low=F.col("confidence") < 0.02, compliant=F.col("quantity") >= 3)


@query("Q14_disagreements", f", {PAIR} select doc_id, cast(l1 <> l2 as int) + cast(t1 <> t2 as int) + cast(s1 <> s2 as int) as differing from pair where cast(l1 <> l2 as int) + cast(t1 <> t2 as int) + cast(s1 <> s2 as int) > 1", "runs")
def q14(spark, d):
    return Q.disagreements(*two_runs(spark, d), "doc_id", ("label", "topic", "score"))


@query("Q14_agreement", f", {PAIR} select field, agreement from (select 'label' as field, round(avg(cast(l1 = l2 as int)), 6) as agreement from pair union all select 'topic', round(avg(cast(t1 = t2 as int)), 6) from pair union all select 'score', round(coalesce(abs(corr(s1, s2)), 0), 6) from pair)", "runs")
def q14_agreement(spark, d):
    return Q.agreement(*two_runs(spark, d), "doc_id", texts=("label", "topic"), numbers=("score",))


@query("Q15_review_set", "select doc_id from runs where score > 0.07 union select doc_id from runs where confidence < 0.01 union select doc_id from runs where quantity < 2", "runs")
def q15(spark, d):
    r = runs(spark, d)
    return Q.review_set(*[r.filter(c).select("doc_id") for c in ("score > 0.07", "confidence < 0.01", "quantity < 2")])


@query("Q16_consensus", "select doc_id, (select label from (select label, count(*) as n from runs s where s.doc_id = r.doc_id group by 1 order by n desc, label limit 1)) as label, round(avg(confidence), 6) as confidence, list_sort(list(distinct topic)) as topics, count(*) as runs, (select list(label || '=' || q order by label) from (select label, arg_max(quantity, run) as q from runs s where s.doc_id = r.doc_id group by 1)) as quantities from runs r group by 1", "runs")
def q16(spark, d):
    r = runs(spark, d).withColumn("topics", F.array("topic")).withColumn("quantities", F.create_map("label", "quantity"))
    found = Q.consensus(r, "doc_id", order="run", texts=("label",), numbers=("confidence",), lists=("topics",), maps=("quantities",))
    return found.withColumn("quantities", F.transform(F.array_sort(F.map_entries("quantities")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))


@query("Q16_first_run", "select doc_id, run, label, confidence from (select *, row_number() over (partition by doc_id order by confidence desc, run) as p from runs) where p = 1", "runs")
def q16_first(spark, d):
    r = runs(spark, d).select("doc_id", "run", "label", "confidence")
    return Q.first_run(r, "doc_id", F.struct(-F.col("confidence"), "run"))


@query("Q17_sentiment_block", "select doc_id, cast(quality = 1 and toxic = 0 as int) as sentiment_positive, cast(toxic = 1 as int) as sentiment_negative, cast(quality = 0 and toxic = 0 as int) as sentiment_neutral, case when doc_id % 5 = 0 then 0.5::double else doc_id % 100 / 100.0::double end as sentiment_confidence, case when doc_id % 7 = 0 then 0.0::double else 0.25::double end as sentiment_score from labelled", "labelled")
def q17(spark, d):
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    conf = F.when(F.col("doc_id") % 5 == 0, "high").otherwise((F.col("doc_id") % 100 / 100.0).cast("string"))
    return V.labelled(spark, d).select("doc_id", *E.sentiment_block(label, conf, F.when(F.col("doc_id") % 7 != 0, F.lit(0.25))))


@query("Q18_topic_block", ", t as (select source, row_number() over (order by count(*) desc, source) as r from documents group by 1 order by count(*) desc, source limit 5) select doc_id, r as hit from documents left join t using (source)".lstrip(", ").replace("t as (", "with t as (", 1))
def q18(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "source")
    topics = E.fit_topics(docs, "source")
    block = docs.select("doc_id", *E.topic_block(F.col("source"), None, topics))
    hit = F.lit(None).cast("long")
    for i, t in enumerate(topics):
        hit = F.when(F.col(f"topic_{t}") == 1, i + 1).otherwise(hit)
    return block.select("doc_id", hit.cast("long").alias("hit"))


@query("Q19_entity_block", "select id, 2 as company_count, case when id % 3 = 0 then 0 else 1 end as people_count, case when id % 2 = 0 then 3 else 0 end as metric_count, case when id % 3 = 0 or lang = source then 2 when lang = 'en' then 2 else 3 end as entity_diversity, 2 + case when id % 3 = 0 then 0 else 1 end + case when id % 2 = 0 then 3 else 0 end as entity_importance from articles", "articles")
def q19(spark, d):
    people = F.when(F.col("id") % 3 != 0, F.array(F.when(F.col("lang") == "en", F.col("lang")).otherwise("x")))
    metrics = F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return V.articles(spark, d).select("id", *E.entity_block(F.array("lang", "source"), people, metrics))


@query("Q20_causal_block", "select doc_id, cast(count(*) as int) as causal_factor_count, max(run) as causal_chain_length, 0 as cause_category_internal_operations, cast(max(label) = 'A' as int) as cause_category_market_conditions, 0 as cause_category_regulatory, 0 as cause_category_external_events, cast(max(label) <> 'A' as int) as cause_category_unknown, round(avg(coalesce(case when score > 0 then score end, 0.5::double)), 6) as causal_confidence_avg, round(sum(coalesce(case when score > 0 then score end, 0.5::double)), 6) as causal_strength from runs group by 1", "runs")
def q20(spark, d):
    docs = runs(spark, d).groupBy("doc_id").agg(F.collect_list(F.coalesce(F.when(F.col("score") > 0, F.col("score")), F.lit(-1.0))).alias("c"), F.max("run").alias("chain"), F.max("label").alias("label"))
    conf = F.transform("c", lambda x: F.when(x >= 0, x))
    return docs.select("doc_id", *E.causal_block(conf, F.col("chain"), F.when(F.col("label") == "A", "market_conditions").otherwise("unknown")))


@query("Q21_risk_block", "select doc_id, run, greatest(1, least(10, case when run % 4 = 0 then 5 else cast(floor(quantity / 3) as int) end)) as risk_level, case when label = 'A' then 2 else 0 end as uncertainty_count, cast(topic = 'O' as int) as forward_looking_flag from runs", "runs")
def q21(spark, d):
    level = F.when(F.col("run") % 4 != 0, F.floor(F.col("quantity") / 3).cast("int"))
    doubt = F.when(F.col("label") == "A", F.array(F.lit("may"), F.lit("might")))
    return runs(spark, d).select("doc_id", "run", *E.risk_block(level, doubt, F.col("topic") == "O"))


@query("Q22_text_block", "select event_id, n as key_phrase_count, cast(t = 'factual' as int) as tone_factual, cast(t = 'speculative' as int) as tone_speculative, cast(t = 'urgent' as int) as tone_urgent, cast(t = 'neutral' as int) as tone_neutral, 0 as tone_optimistic, 0 as tone_pessimistic, n as text_length_proxy, round(n / (n + 1), 6) as readability_score, cast(t = 'urgent' as int) as urgency_score from (select event_id, cast(user_id % 6 as int) as n, case event_type when 'error' then 'urgent' when 'click' then 'factual' when 'view' then 'speculative' else 'neutral' end as t from events)")
def q22(spark, d):
    t = F.col("event_type")
    tone = F.when(t == "error", "urgent").when(t == "click", "factual").when(t == "view", "speculative").otherwise("neutral")
    phrases = F.array_repeat(F.lit("p"), (F.col("user_id") % 6).cast("int"))
    return V.table(spark, d, "events").select("event_id", *E.text_block(phrases, tone))


@query("Q23_scaled_blocks", "select doc_id, run, round((quantity - m1) / s1, 6) as quantity, round((score - m2) / s2, 6) as score from runs, (select avg(quantity) as m1, stddev_pop(quantity) as s1, avg(score) as m2, stddev_pop(score) as s2 from runs)", "runs")
def q23(spark, d):
    r = runs(spark, d).select("doc_id", "run", "quantity", "score")
    out = E.Scaler().fit(r, ("quantity", "score")).transform(r)
    return out.select("doc_id", "run", F.round("quantity", 6).alias("quantity"), F.round("score", 6).alias("score"))


#: All synonyms, in order; the SQL knows them with their factors.
SYNONYMS = tuple(s for names in E.FACTORS.values() for s in names)
FACTOR_SQL = "fs as (select * from (values " + ", ".join(f"({n}, '{k}', '{s}')" for n, (k, names) in enumerate(E.FACTORS.items()) for s in names) + ") v(n, key, syn)), sy as (select [" + ", ".join(f"'{s}'" for s in SYNONYMS) + "] as l)"
_RULE = "case when r = key then -1 when contains(r, syn) or contains(syn, r) then n when contains(replace(replace(r, 'prices', 'price'), 'costs', 'cost'), key) or contains(replace(replace(r, 'prices', 'price'), 'costs', 'cost'), syn) then n + 100 end"
CANON = f"canon as (select name, arg_min(key, place) as canonical from (select name, key, {_RULE} as place from (select distinct name, trim(lower(name)) as r from names), fs) where place is not null group by 1)"


def named_factors(key, word):
    """Names as models write them: a synonym, one inside other words, a part of one, plurals, keys, and words that are no factor."""
    n, keys = len(SYNONYMS), list(E.FACTORS)
    synonym = F.element_at(F.array(*[F.lit(s) for s in SYNONYMS]), (key % n + 1).cast("int"))
    kind = (F.floor(key / n) % 6).cast("int")
    return F.when(kind == 0, synonym).when(kind == 1, F.concat(F.upper(word), F.lit(" "), synonym)).when(kind == 2, F.substring(synonym, 1, 5)).when(kind == 3, F.concat(F.lit(" "), synonym, F.lit(" costs "))).when(kind == 4, F.element_at(F.array(*[F.lit(k) for k in keys]), (key % len(keys) + 1).cast("int"))).otherwise(word)


def named_sql(key, word):
    keys = "[" + ", ".join(f"'{k}'" for k in E.FACTORS) + "]"
    synonym = f"l[({key} % {len(SYNONYMS)} + 1)::int]"
    return f"case {key} // {len(SYNONYMS)} % 6 when 0 then {synonym} when 1 then upper({word}) || ' ' || {synonym} when 2 then substr({synonym}, 1, 5) when 3 then ' ' || {synonym} || ' costs ' when 4 then {keys}[({key} % {len(E.FACTORS)} + 1)::int] else {word} end"


@query("Q25_canonical_factor", f"with {FACTOR_SQL}, names as (select p_partkey, {named_sql('p_partkey', 'p_name')} as name from part, sy), {CANON} select p_partkey, name, canonical from names left join canon using (name)")
def q25(spark, d):
    names = V.table(spark, d, "part").select("p_partkey", named_factors(F.col("p_partkey"), F.col("p_name")).alias("name"))
    return E.canonical_factors(names, "name")


def factors(spark, d):
    """An extraction's run as a factor, named by its part; its direction, weight and confidence are the run's."""
    direction = F.when(F.col("label") == "A", "positive").when(F.col("label") == "R", "negative").otherwise("neutral")
    centrality = F.when(F.col("run") == 1, "primary").when(F.col("run") == 2, "secondary").otherwise("other")
    rows = runs(spark, d).select("doc_id", "run", named_factors(F.col("part"), F.col("topic")).alias("name"), direction.alias("direction"), centrality.alias("centrality"), (F.col("score") > 0.04).alias("causal"), F.col("confidence"))
    return E.canonical_factors(rows, "name")


W = "case run when 1 then 1.0::double when 2 then 0.6::double else 0.5::double end * confidence"
SUMS = ", ".join(f"coalesce(round(sum({W}) filter (canonical = '{n}' and {when}), 6), 0) as {n}__{c}" for n in E.FACTORS for c, when in (("pos", "label = 'A'"), ("neg", "label = 'R'"), ("causal", "score > 0.04")))
NAMED = f", {FACTOR_SQL}, names as (select runs.*, {named_sql('part', 'topic')} as name from runs, sy), {CANON}"


@query("Q26_factor_features", f"{NAMED} select doc_id, {SUMS} from names left join canon using (name) group by 1", "runs")
def q26(spark, d):
    return E.factor_features(None, factors(spark, d), "doc_id", names=tuple(E.FACTORS))


@query("Q27_factor_rows", f"{NAMED} select doc_id, cast(run - 1 as int) as place, canonical, confidence from names left join canon using (name)", "runs")
def q27(spark, d):
    docs = factors(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("run", "canonical", "confidence"))).alias("factors"))
    return E.factor_rows(docs, "doc_id", "factors").select("doc_id", "place", "canonical", "confidence")


@query("Q28_feature_matrix", "select id, label, cast(label % 2 = 0 as int) as even, round(vector[1]::double, 6) as v0, round(vector[2]::double, 6) as v1 from vectors", "vectors")
def q28(spark, d):
    v = V.vectors(spark, d)
    return E.feature_matrix("id", v.select("id", "label"), v.select("id", (F.col("label") % 2 == 0).cast("int").alias("even")), v.select("id", *[F.round(F.get("vector", F.lit(i)).cast("double"), 6).alias(f"v{i}") for i in (0, 1)]))


FEATURE_SCHEMA = "overall_sentiment string, sentiment_confidence double, sentiment_score double, primary_topic string, topic_scores map<string,double>, companies_mentioned array<string>, risk_level int, forward_looking boolean, tone string"


def feature_record(text):
    """The typed record of a feature JSON, and whether its enums and ranges hold."""
    r = F.from_json(text, FEATURE_SCHEMA)
    ok = r["overall_sentiment"].isin(*E.SENTIMENTS) & r["sentiment_confidence"].between(0, 1) & r["sentiment_score"].between(-1, 1) & r["risk_level"].between(1, 10)
    return r, F.coalesce(ok, F.lit(False))


@query("F19_feature_record", "select doc_id, run, case when label = 'A' then 'positive' when label = 'R' then 'negative' else 'mixed' end as overall_sentiment, cast(quantity / 4 as int) as risk_level, topic as primary_topic, label <> 'N' and cast(floor(quantity / 4) as int) between 1 and 10 as valid from runs".replace("cast(quantity / 4 as int) as", "cast(floor(quantity / 4) as int) as"), "runs")
def f19(spark, d):
    label = F.when(F.col("label") == "A", "positive").when(F.col("label") == "R", "negative").otherwise("mixed")
    text = F.to_json(F.struct(label.alias("overall_sentiment"), F.col("confidence").alias("sentiment_confidence"), F.col("score").alias("sentiment_score"), F.col("topic").alias("primary_topic"), F.floor(F.col("quantity") / 4).cast("int").alias("risk_level"), F.create_map(F.col("topic"), F.col("score")).alias("topic_scores")))
    rows = runs(spark, d).select("doc_id", "run", text.alias("text"))
    record, valid = feature_record(F.col("text"))
    return rows.select("doc_id", "run", record.alias("r"), valid.alias("valid")).select("doc_id", "run", "r.overall_sentiment", "r.risk_level", "r.primary_topic", "valid")

"""Queries over text statistics, component labels and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import information as I
from ..operators import probes as P
from ..operators import quality as Q
from ..operators import similar as S
from ..operators import topics as T
from ..operators import words as W
from . import views as V
from .registry import query

STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
TOKENS = rf"tok as (select id, list_filter(regexp_split_to_array(lower(description), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1 and w not in {STOP}) as w from articles)"
TFIDF = f"""{TOKENS}, cnt as (select id, term, count(*) as tf from (select id, unnest(w || case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end) as term from tok) group by 1, 2),
idf as (select term, ln(((select count(*) from articles) + 1) / (count(*) + 1)) + 1 as idf from cnt group by 1 having count(*) >= 2 and count(*) <= (select count(*) from articles) * 0.8 order by sum(tf) desc, term limit 500),
w as (select id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by id)) as weight from cnt join idf using (term))"""


def weights(spark, d):
    return T.tfidf(V.articles(spark, d), key="id", text="description")


@query("M3_tfidf", f", {TFIDF} select id, term, round(weight, 6) as weight from w", "articles")
def m3(spark, d):
    return weights(spark, d).select("id", "term", F.round("weight", 6).alias("weight"))


SCORES = "scores as (select 'c' || j as component, id, case j when 1 then (length(regexp_replace(description, '[^aeiou]', '', 'g')) * 1000 // greatest(length(description), 1))::double when 2 then (length(regexp_replace(description, '[^,;:.]', '', 'g')) * 1000 // greatest(length(description), 1))::double else length(description)::double end as score from articles, (select unnest([1, 2, 3]) as j))"
TAILS = "tails as (select component, id, score, 'high' as tail from (select *, row_number() over (partition by component order by score desc, id) as p from scores) where p <= 50 union all select component, id, score, 'low' from (select *, row_number() over (partition by component order by score, id) as p from scores) where p <= 50)"


def scores(spark, d):
    a = W.characters(T.dealt(V.articles(spark, d).select("id", "description")), key="id", text="description", kinds=("aeiou", ",;:."))

    def per_mille(j):
        return F.floor(F.col("counts")[j] * 1000 / F.greatest("n", F.lit(1))).cast("double")

    s = [per_mille(0), per_mille(1), F.col("n").cast("double")]
    rows = a.select("id", F.posexplode(F.array(*s)).alias("j", "score")).select(F.concat(F.lit("c"), (F.col("j") + 1).cast("string")).alias("component"), "id", "score")
    return S.stored(rows, "scores")  # numbers, so that both tails and what follows don't read the texts again


def tails(spark, d):
    return T.tails(scores(spark, d), 50)


@query("M2_score_tails", f", {SCORES}, {TAILS} select * from tails", "articles")
def m2(spark, d):
    return tails(spark, d)


KEYS = "keys as (select component, tail, term, weight, row_number() over (partition by component, tail order by weight desc, term) as place from (select component, tail, term, round(sum(weight) / 50, 6) as weight from tails join w using (id) group by 1, 2, 3) where weight > 0)"


def keywords(spark, d, k=15, ends=None):
    ends = ends or S.stored(tails(spark, d), "tails")
    return T.tail_keywords(ends, T.tfidf(V.articles(spark, d), key="id", text="description", only=ends), k=k)


@query("M8_tail_keywords", f", {SCORES}, {TAILS}, {TFIDF}, {KEYS} select component, tail, term, cast(place as int) as place from keys where place <= 15", "articles")
def m8(spark, d):
    return keywords(spark, d).drop("weight")


@query("M8_unique_keywords", f", {SCORES}, {TAILS}, {TFIDF}, {KEYS}, top as (select * from keys where place <= 15) select component, tail, term, cast(rank as int) as rank from (select component, tail, term, row_number() over (partition by component, tail order by place) as rank from top t where not exists (select 1 from top o where o.component = t.component and o.term = t.term and o.tail <> t.tail)) where rank <= 10", "articles")
def m8_unique(spark, d):
    return T.unique_keywords(keywords(spark, d)).drop("weight")


@query("M10_component_uniqueness", f", {SCORES}, {TAILS}, {TFIDF}, {KEYS}, own as (select distinct component, term from keys where place <= 15) select component, round(1 - coalesce(s, 0) / (n * 2), 6) as uniqueness from (select component, count(*) as n from own group by 1) left join (select a.component, count(*) as s from own a join own b on a.term = b.term and a.component <> b.component group by 1) using (component)", "articles")
def m10(spark, d):
    return T.uniqueness(keywords(spark, d))


UNIQUE = "top as (select * from keys where place <= 15), uq as (select component, tail, term, rank from (select component, tail, term, row_number() over (partition by component, tail order by place) as rank from top t where not exists (select 1 from top o where o.component = t.component and o.term = t.term and o.tail <> t.tail)) where rank <= 10)"
ODDS = "odds as (select component, abs(ln((h + 0.01) / (l + 0.01))) / (1 + abs(ln((h + 0.01) / (l + 0.01)))) as o from (select component, avg(topic) filter (tail = 'high') as h, avg(topic) filter (tail = 'low') as l from tails join (select id, (length(description) - length(replace(description, 'e', '')))::double / greatest(length(description), 1) as topic from articles) using (id) group by 1))"
OWN = "own as (select distinct component, term from keys where place <= 15), un as (select component, round(1 - coalesce(s, 0) / (n * 2), 6) as u from (select component, count(*) as n from own group by 1) left join (select a.component, count(*) as s from own a join own b on a.term = b.term and a.component <> b.component group by 1) using (component))"


def associations(spark, d, ends=None):
    """(component, h, l): the mean share of the letter e in the high and in the low tail, which stands for a topic."""
    p = F.col("topic") / F.greatest(F.col("n"), F.lit(1))
    rows = (ends or tails(spark, d)).join(topic(spark, d), "id").join(V.articles(spark, d).select("id", F.length("description").alias("n")), "id")
    return rows.groupBy("component").agg(F.avg(F.when(F.col("tail") == "high", p)).alias("h"), F.avg(F.when(F.col("tail") == "low", p)).alias("l"))


@query("M11_component_confidence", f", {SCORES}, {TAILS}, {TFIDF}, {KEYS}, {OWN}, {ODDS}, var as (select component, v / sum(v) over () as v from (select component, var_pop(score) as v from scores group by 1)), k as (select component, max(weight) as k from keys where place <= 1 group by 1) select component, round(least(v * 0.3 + least(k * 2, 1.0::double) * 0.3 + least(o * 3, 1.0::double) * 0.2 + u * 0.2, 1.0::double), 6) as confidence from k join un using (component) join odds using (component) join var using (component)", "articles")
def m11(spark, d):
    every = scores(spark, d)  # once, as each call reads all texts
    ends = S.stored(T.tails(every, 50), "tails")
    words = S.stored(keywords(spark, d, ends=ends), "keywords")
    top = words.filter("place <= 1").groupBy("component").agg(F.max("weight").alias("k"))
    spread = every.groupBy("component").agg(F.var_pop("score").alias("v"))
    share = spread.crossJoin(spread.agg(F.sum("v").alias("all"))).select("component", F.try_divide("v", "all").alias("v"))  # one row for each component
    rows = top.join(T.uniqueness(words), "component").join(associations(spark, d, ends), "component").join(share, "component")
    return rows.select("component", F.round(T.component_confidence(F.col("v"), F.col("k"), T.log_odds(F.col("h"), F.col("l")), F.col("uniqueness")), 6).alias("confidence"))


@query("M12_component_labels", f", {SCORES}, {TAILS}, {TFIDF}, {KEYS}, {UNIQUE}, t as (select component, coalesce(string_agg(term, ', ' order by rank) filter (tail = 'high' and rank <= 3), '') as h, coalesce(string_agg(term, ', ' order by rank) filter (tail = 'low' and rank <= 3), '') as l from uq group by 1) select component, concat_ws(' versus ', nullif(h, ''), nullif(l, '')) as label, 'high: ' || h || '; low: ' || l as subtitle from t", "articles")
def m12(spark, d):
    return T.component_labels(T.unique_keywords(keywords(spark, d)))


def _share(items):
    return f"round(len(list_filter(ws, lambda w: w in ({', '.join(repr(x) for x in items)}))) / n, 6)"


STYLE = rf"""select id, cast(length(t) as int) as chars, cast(len(ws) as int) as words, round(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) / n, 6) as word_length, round(len(list_distinct(ws)) / n, 6) as type_token,
 round(len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}_\s]')) / c, 6) as punctuation, round(len(regexp_extract_all(t, '!')) / c, 6) as exclamations, round(len(regexp_extract_all(t, '\?')) / c, 6) as questions, round(len(regexp_extract_all(t, '[0-9]')) / c, 6) as digits, round(len(regexp_extract_all(t, '\p{{Lu}}')) / c, 6) as upper,
 cast(len(ss) as int) as sentences, round(coalesce(list_sum(ls), 0) / m, 6) as sentence_length, cast(coalesce(list_max(ls), 0) as int) as longest_sentence, {_share(T.PRONOUNS)} as first_person, {_share(T.SECOND_PERSON)} as second_person, {_share(T.MODALS)} as modals, {_share(T.NEGATIONS)} as negations
from (select *, greatest(length(t), 1) as c, greatest(len(ws), 1) as n, greatest(len(ss), 1) as m, list_transform(ss, lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> ''))) as ls from (select id, description as t, list_filter(regexp_split_to_array(lower(description), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '') as ws, list_filter(regexp_split_to_array(description, '[.!?]+'), lambda s: trim(s) <> '') as ss from articles))"""


@query("M13_style_features", STYLE, "articles")
def m13(spark, d):
    return T.with_style(T.dealt(V.articles(spark, d).select("id", "description")), key="id", text="description")


CLASS_TFIDF = TFIDF.replace("from articles", "from articles_").replace("count(*) >= 2", "count(*) >= 3").replace(" * 0.8 order", " * 1.0 order").replace("limit 500", "limit 5000").replace("w as (select id, term, tf", "cw as (select id, term, tf")


@query("M14_class_tfidf", f", {SCORES}, {TAILS}, articles_ as (select * from articles where id in (select id from tails where component = 'c1')), {CLASS_TFIDF}, ks as (select tail, term, round(sum(weight) / 50, 6) as weight from tails join cw using (id) where component = 'c1' group by 1, 2) select tail, term, cast(place as int) as place from (select tail, term, row_number() over (partition by tail order by weight desc, term) as place from ks where weight > 0) where place <= 20", "articles")
def m14(spark, d):
    rows = S.stored(tails(spark, d).filter("component = 'c1'"), "tails")
    texts = V.articles(spark, d).join(rows.select("id").distinct(), "id", "left_semi")
    return T.tail_keywords(rows, T.tfidf(texts, key="id", text="description", least=3, most=1.0, terms=5000), k=20).select("tail", "term", "place")


EFFECT = "round(avg({0}) filter (f) - avg({0}) filter (not f), 6) as difference, round((avg({0}) filter (f) - avg({0}) filter (not f)) / sqrt(((count(*) filter (f) - 1) * var_samp({0}) filter (f) + (count(*) filter (not f) - 1) * var_samp({0}) filter (not f)) / (count(*) - 2)), 6) as cohens_d"


@query("M16_effects", f", x as (select id % 5 = 0 as f, length(description)::double as chars, (id * 37 % 101)::double as code from articles) select 'chars' as feature, {EFFECT.format('chars')} from x union all select 'code', {EFFECT.format('code')} from x", "articles")
def m16(spark, d):
    rows = V.articles(spark, d).select("id", F.length("description").cast("double").alias("chars"), (F.col("id") * 37 % 101).cast("double").alias("code"))
    return T.effects(rows, ("chars", "code"), tail=F.col("id") % 5 == 0)


@query("M16_mutual_information", ", e as (select list_distinct(quantile_cont(length(description), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as edges from articles), b as (select len(list_filter(edges, lambda x: x < length(description))) as bin, lang = 'en' as flag from articles, e), c as (select bin, flag, count(*) as n from b group by 1, 2) select round(sum(v), 6) as mutual_information from (select n / (sum(n) over ()) * ln(n * (sum(n) over ()) / ((sum(n) over (partition by bin)) * (sum(n) over (partition by flag)))) as v from c)", "articles")
def m16_information(spark, d):
    rows = V.articles(spark, d).select(F.length("description").alias("n"), "lang")
    return T.mutual_information(Q.quantile_bins(rows, "n"), "bin", F.col("lang") == "en")


def _psi(n):
    z = f"({n} + 6)::double"
    terms = " - ".join(f"1 / ({n} + {i})::double" for i in range(6))
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z}^2) + 1 / (120 * {z}^4) - 1 / (252 * {z}^6) + 1 / (240 * {z}^8) - {terms})"


NEAREST = f"""x as (select unnest(['chars', 'code']) as feature, unnest([length(description)::double, (id * 37 % 101)::double]) as v, lang as c, id from articles),
s as (select *, least(3, size - 1) as k from (select *, count(*) over (partition by feature, c) as size from x) where size > 1),
near as (select feature, id, v, c, size, k, d from (select a.*, abs(a.v - b.v) as d, row_number() over (partition by a.feature, a.id order by abs(a.v - b.v)) as place from s a join s b on a.feature = b.feature and a.c = b.c and a.id <> b.id) where place = k),
m as (select n.feature, n.id, any_value(n.size) as size, any_value(n.k) as k, count(*) as m from near n join s on s.feature = n.feature and (abs(s.v - n.v) < n.d or s.v = n.v) group by 1, 2)
select feature, round(greatest(0, {_psi('count(*)')} + avg({_psi('k')}) - avg({_psi('size')}) - avg({_psi('m')})), 6) as information from m group by 1"""


@query("M16_nearest_information", f", {NEAREST}", "articles")
def m16_nearest(spark, d):
    rows = V.articles(spark, d).select(F.length("description").cast("double").alias("chars"), (F.col("id") * 37 % 101).cast("double").alias("code"), "lang")
    found = [(f, round(I.nearest_information(rows, f, "lang"), 6)) for f in ("chars", "code")]
    return spark.createDataFrame(found, "feature string, information double")


@query("M17_oriented_scores", f", {SCORES}, {TAILS}, m as (select component, avg(v) filter (tail = 'high') as h, avg(v) filter (tail = 'low') as l from tails join (select id, length(title)::double + length(description) % 97 as v from articles) using (id) group by 1) select component, id, score * case when h < l then -1 else 1 end as score from scores join m using (component)", "articles")
def m17(spark, d):
    reference = V.articles(spark, d).select("id", (F.length("title").cast("double") + F.length("description") % 97).alias("value"))
    return T.oriented(scores(spark, d), tails(spark, d), reference).select("component", "id", "score")


def topic(spark, d):
    """(id, topic): how often the letter e stands in an article."""
    return V.articles(spark, d).select("id", F.regexp_count("description", F.lit("e")).cast("double").alias("topic"))


@query("M18_topic_alignment", f", {SCORES}, x as (select component, score, (length(description) - length(replace(description, 'e', '')))::double as topic from scores join articles using (id)), r as (select component, rank() over (partition by component order by score) + (count(*) over (partition by component, score) - 1) / 2 as rx, rank() over (partition by component order by topic) + (count(*) over (partition by component, topic) - 1) / 2 as ry from x) select component, round(abs(corr(rx, ry)), 6) as rho from r group by 1", "articles")
def m18(spark, d):
    rows = scores(spark, d).join(topic(spark, d), "id")
    return T.spearman(rows, group="component", x="score", y="topic")


@query("M18_log_odds", f", {SCORES}, {TAILS} select component, round(abs(ln((h + 0.01) / (l + 0.01))) / (1 + abs(ln((h + 0.01) / (l + 0.01)))), 6) as association from (select component, avg(topic) filter (tail = 'high') as h, avg(topic) filter (tail = 'low') as l from tails join (select id, (length(description) - length(replace(description, 'e', '')))::double / greatest(length(description), 1) as topic from articles) using (id) group by 1)", "articles")
def m18_odds(spark, d):
    g = associations(spark, d)
    return g.select("component", F.round(T.log_odds(F.col("h"), F.col("l")), 6).alias("association"))


#: One turn of both coordinates at a time; both sides come to the same minimum.
PROBES = """shares as (select id, topic, case topic when 0 then (length(description) - length(replace(description, 'e', '')))::double / greatest(length(description), 1) when 1 then least(length(description), 2000) / 2000.0::double else (lang = 'en')::double end as share from articles, (select unnest([0, 1, 2]) as topic)),
x as (select s.component, h.topic, h.share, coalesce(t.tail = 'high', false)::double as y from scores s join shares h using (id) left join tails t on t.component = s.component and t.id = s.id and t.tail = 'high'),
fit as (select component, topic, 0.0::double as w, 0.0::double as b, 0 as turn from x group by 1, 2 union all
 select component, topic, w1, (case when abs(hbb * b - gb - hwb * (w1 - w)) > 10 then (hbb * b - gb - hwb * (w1 - w)) - 10 * sign(hbb * b - gb - hwb * (w1 - w)) else 0 end) / hbb, turn + 1 from (
  select *, (case when abs(hww * w - gw) > 10 then hww * w - gw - 10 * sign(hww * w - gw) else 0 end) / hww as w1 from (
   select component, topic, any_value(w) as w, any_value(b) as b, any_value(turn) as turn, sum((p - y) * share) as gw, sum(p - y) as gb, sum(p * (1 - p) * share * share) as hww, sum(p * (1 - p) * share) as hwb, sum(p * (1 - p)) as hbb
   from (select x.*, w, b, turn, 1 / (1 + exp(-(w * share + b))) as p from x join fit using (component, topic) where turn < 150) group by 1, 2))),
probe as (select component, topic, abs(w) / (abs(w) + 1) as beta from fit where turn = 150),
rk as (select component, topic, rank() over (partition by component, topic order by score) + (count(*) over (partition by component, topic, score) - 1) / 2 as rx, rank() over (partition by component, topic order by share) + (count(*) over (partition by component, topic, share) - 1) / 2 as ry from scores join shares using (id)),
rho as (select component, topic, coalesce(abs(corr(rx, ry)), 0) as correlation from rk group by 1, 2),
ends as (select component, topic, avg(share) filter (tail = 'high') as h, avg(share) filter (tail = 'low') as l from tails join shares using (id) group by 1, 2),
od as (select *, abs(o) / (abs(o) + 1) as log_odds from (select *, ln((h + 0.01) / (1 - h + 0.01)) - ln((l + 0.01) / (1 - l + 0.01)) as o from ends))"""


@query("M18_alignment", f", {SCORES}, {TAILS}, {PROBES} select component, cast(topic as int) as topic, round(correlation, 6) as correlation, round(log_odds, 6) as log_odds, round(beta, 6) as beta, round((correlation + log_odds + beta) / 3, 6) as alignment, case when h > l then 1 else -1 end as sign, round(h, 6) as high_mean, round(l, 6) as low_mean from probe join rho using (component, topic) join od using (component, topic)", "articles", recursive=True)
def m18_alignment(spark, d):
    a = V.articles(spark, d)
    kinds = [F.regexp_count("description", F.lit("e")) / F.greatest(F.length("description"), F.lit(1)), F.least(F.length("description"), F.lit(2000)) / F.lit(2000.0), (F.col("lang") == "en").cast("double")]
    shares = a.select("id", F.posexplode(F.array(*kinds)).alias("topic", "share"))
    found = P.topic_alignment(scores(spark, d), tails(spark, d), shares)
    return found.select("component", "topic", *[F.round(c, 6).alias(c) for c in ("correlation", "log_odds", "beta", "alignment")], "sign", *[F.round(c, 6).alias(c) for c in ("high_mean", "low_mean")])


TAXONOMY = ", x as (select component, l.lang as facet, s.id, score, (a.lang = l.lang)::double as f from scores s join articles a using (id), (select distinct lang from articles) l), r as (select component, facet, rank() over (partition by component, facet order by score) + (count(*) over (partition by component, facet, score) - 1) / 2 as rx, rank() over (partition by component, facet order by f) + (count(*) over (partition by component, facet, f) - 1) / 2 as ry from x), c as (select component, facet, corr(rx, ry) as rho from r group by 1, 2), z as (select component, facet, abs(avg(f) filter (tail = 'high') - avg(f) filter (tail = 'low')) as gap from x join tails using (component, id) group by 1, 2), sd as (select component, facet, stddev_pop(f) as sd from x group by 1, 2)"


@query("M19_taxonomy_facets", f", {SCORES}, {TAILS} {TAXONOMY} select component, facet, side, round(score, 6) as score, cast(rank as int) as rank from (select *, row_number() over (partition by component, side order by round(score, 6) desc, facet) as rank from (select component, facet, case when rho > 0 then 'high' else 'low' end as side, greatest(abs(rho), 0.4::double) as score from c join z using (component, facet) join sd using (component, facet) where abs(rho) >= 0.15 and gap / (sd + 1e-10) >= 0.5)) where rank <= 3", "articles")
def m19(spark, d):
    a = V.articles(spark, d).select("id", "lang")
    kinds = a.select(F.col("lang").alias("facet")).distinct()  # the values of a taxonomy
    counts = a.crossJoin(F.broadcast(kinds)).select("id", "facet", (F.col("lang") == F.col("facet")).cast("double").alias("count"))
    return T.taxonomy_facets(scores(spark, d), counts, tails(spark, d), enrichment=0.5)


@query("M20_facets", f", {SCORES}, {TAILS}, {TFIDF}, {KEYS}, f as (select component, tail as side, term as facet, weight * 20 as score, row_number() over (partition by component, tail order by weight * 20 desc, term) as rank from keys where place <= 15 and weight * 20 >= 0.25) select component, side, facet, round(score, 6) as score, cast(rank as int) as rank, count(*) over (partition by component, side) < 2 as weak from f where rank <= 5", "articles")
def m20(spark, d):
    rows = keywords(spark, d).select("component", F.col("tail").alias("side"), F.col("term").alias("facet"), (F.col("weight") * 20).alias("score"))
    return T.facets(rows).withColumn("score", F.round("score", 6))


STYLE_NAMES = ("chars", "words", "word_length", "type_token", "punctuation", "digits", "upper", "sentences", "sentence_length", "longest_sentence", "first_person", "modals")


@query("M20_style_facets", f", {SCORES}, {TAILS}, style as ({STYLE}), long as (select component, place, facet, avg(v) filter (tail = 'high') as h, avg(v) filter (tail = 'low') as l from (select component, tail, unnest(range({len(STYLE_NAMES)})) as place, unnest([{', '.join(repr(n) for n in STYLE_NAMES)}]) as facet, unnest([{', '.join(n + '::double' for n in STYLE_NAMES)}]) as v from tails join style using (id)) group by 1, 2, 3), s as (select component, case when h > l then 'high' else 'low' end as side, facet, place from long where abs(h - l) > 0.1) select component, side, facet, cast(rank as int) as rank from (select *, row_number() over (partition by component, side order by place) as rank from s) where rank <= 5", "articles")
def m20_style(spark, d):
    ends = S.stored(tails(spark, d), "tails")
    texts = V.articles(spark, d).select("id", "description").join(ends.select("id").distinct(), "id", "left_semi")
    return T.style_facets(ends.join(T.with_style(texts, key="id", text="description"), "id"), STYLE_NAMES)


COS = "list_inner_product(a.vector::double[], b.vector::double[])"


MEANS = "m as (select label, list(x order by i) as vector from (select label, i, avg(x) as x from (select label, unnest(vector::double[]) as x, generate_subscripts(vector, 1) as i from vectors) group by 1, 2) group by 1), v as (select label::bigint as id, vector, [label::bigint, label::bigint % 3, label::bigint % 4] as t from m)"


LABEL_PAIRS = f"select a.id as a, b.id as b, round(({COS} / (sqrt(list_inner_product(a.vector::double[], a.vector::double[])) * sqrt(list_inner_product(b.vector::double[], b.vector::double[])))) * 0.5 + len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) * 0.5, 6) as similarity from v a join v b on a.id < b.id"


@query("M22_label_similarity", f", {MEANS} {LABEL_PAIRS}", "vectors")
def m22(spark, d):
    """Labels by the mean of all their vectors: as many rows as there are labels meet."""
    cells = V.vectors(spark, d).select(F.col("label").cast("long").alias("id"), F.posexplode("vector").alias("i", "x"))
    means = cells.groupBy("id", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vector"))
    v = S.stored(means.withColumn("t", F.array(F.col("id"), F.col("id") % 3, F.col("id") % 4)), "labels")
    a, b = v.select(F.col("id").alias("a"), F.col("vector").alias("va"), F.col("t").alias("ta")), v.select(F.col("id").alias("b"), F.col("vector").alias("vb"), F.col("t").alias("tb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(T.label_similarity(S.cosine(F.col("va"), F.col("vb")), F.col("ta"), F.col("tb")), 6).alias("similarity"))


@query("M22_diversity_index", f", {MEANS}, pairs as ({LABEL_PAIRS}) select round(coalesce(avg(1 - similarity), 1.0::double), 6) as diversity from pairs", "vectors")
def m22_diversity(spark, d):
    return T.diversity_index(m22(spark, d))


@query("M23_evidence_pack", f", {SCORES}, {TAILS} select component, tail, cast(place as int) as place, id, score, substr(description, 1, 200) as snippet from (select *, row_number() over (partition by component, tail order by case when tail = 'high' then -score else score end, id) as place from tails) join articles using (id) where place <= 30", "articles")
def m23(spark, d):
    texts = V.articles(spark, d).select("id", F.col("description").alias("text"))
    return T.evidence_pack(tails(spark, d), texts)

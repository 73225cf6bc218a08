"""Queries of the rule scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from . import views as V
from .registry import query

STOP = "[" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "]"
TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(description), '\s+'), lambda x: x <> ''))"


def tokens(column):
    return F.array_distinct(F.filter(F.split(F.lower(column), r"\s+"), lambda x: x != ""))


PAIRS = f"paired as (select a.id, [a.lang, a.source] as ca, [b.lang, b.source] as cb, a.tok as wa, b.tok as wb from (select *, {TOKENS} as tok from articles) a join (select *, {TOKENS} as tok from articles) b on b.id = a.id + 4)"
SIMILARITY = f"""least(1.0::double, len(list_intersect(ca, cb)) / len(list_distinct(ca || cb)) * 0.6::double
 + coalesce(len(list_filter(list_intersect(wa, wb), lambda x: not list_contains({STOP}, x))) / nullif(case when len(wa) > 0 and len(wb) > 0 then len(list_distinct(wa || wb)) end, 0), 0) * 0.4::double)"""


@query("R1_issue_similarity", f", {PAIRS} select id, round({SIMILARITY}, 6) as similarity from paired", "articles")
def r1(spark, d):
    a = V.articles(spark, d).select("id", F.array("lang", "source").alias("ca"), tokens("description").alias("wa"))
    b = a.select((F.col("id") - 4).alias("id"), F.col("ca").alias("cb"), F.col("wa").alias("wb"))
    return a.join(b, "id").select("id", F.round(R.issue_similarity(F.col("ca"), F.col("cb"), F.col("wa"), F.col("wb")), 6).alias("similarity"))


THEMES = (("climate", ("tionre", "queux")), ("human_rights", ("heed",)), ("governance", ("onre", "src3")))
THEME_SQL = """case when contains(lower(description), 'tionre') or contains(lower(description), 'queux') then 'climate' when contains(lower(description), 'heed') then 'human_rights' when contains(lower(description), 'onre') or contains(source, 'src3') then 'governance' else 'other' end"""


@query("R2_theme", f"select id, {THEME_SQL} as theme from articles", "articles")
def r2(spark, d):
    return V.articles(spark, d).select("id", R.theme(F.col("description"), F.array("lang", "source"), THEMES).alias("theme"))


BANDS = "bands as (select * from (values " + ", ".join(f"({lo}, {hi}, '{t}', {w}::double)" for lo, hi, ws in R.THEME_BANDS for t, w in ws.items()) + ") v(lo, hi, theme, w))"
CASE_THEME = "case category when '1-URGENT' then 'climate' when '2-HIGH' then 'human_rights' when '3-MEDIUM' then 'governance' when '5-LOW' then 'tax' else 'other' end"


def case_theme():
    c = F.col("category")
    return F.when(c == "1-URGENT", "climate").when(c == "2-HIGH", "human_rights").when(c == "3-MEDIUM", "governance").when(c == "5-LOW", "tax").otherwise("other")


@query("R3_theme_priority", f", {BANDS}, c as (select name, year(date) + cast(name % 20 as int) as year, {CASE_THEME} as theme from cases) select name, coalesce((select w from bands b where c.year between lo and hi and b.theme = c.theme), (select w from bands b where c.year between lo and hi and b.theme = 'other'), 0.1::double) as priority from c", "cases")
def r3(spark, d):
    c = V.cases(spark, d).select("name", (F.year("date") + (F.col("name") % 20).cast("int")).alias("year"), case_theme().alias("theme"))
    return R.theme_priority(c).select("name", "priority")


RECENCY = "case when {0} is null then 0.5::double when {0} <= 0 then 1.0::double when {0} <= 365 then 1.0::double - {0} / 365 * 0.5::double when {0} <= 730 then 0.5::double - ({0} - 365) / 365 * 0.4::double else greatest(0.1::double, 0.5::double - ({0} - 730) / 365 * 0.3::double) end"


@query("R4_recency", f", c as (select name, case when name % 10 = 0 then null when name % 10 = 1 then cast('2001-12-31' as date) - make_date(year(date), 1, 1) else cast('2001-12-31' as date) - date end as n from cases) select name, round({RECENCY.format('n')}, 6) as recency from c", "cases")
def r4(spark, d):
    text = F.when(F.col("name") % 10 == 0, "soon").when(F.col("name") % 10 == 1, F.year("date").cast("string")).otherwise(F.col("date").cast("string"))
    days = F.datediff(F.lit("2001-12-31").cast("date"), R.day_of(text))
    return V.cases(spark, d).select("name", F.round(R.recency(days), 6).alias("recency"))


PRIOR = f"""p as (select a.name, b.name as prior, round((least(1.0::double, len(list_intersect(a.cats, b.cats)) / len(list_distinct(a.cats || b.cats)) * 0.6::double + len(list_filter(list_intersect(a.tok, b.tok), lambda x: x <> 'the')) / len(list_distinct(a.tok || b.tok)) * 0.4::double)) * 0.5::double
 + coalesce(w.w, o.w, 0.1::double) * 0.3::double + {RECENCY.format('(a.date - b.date)')} * 0.2::double, 6) as score
 from c a join c b on a.company = b.company and b.date < a.date left join bands w on year(a.date) between w.lo and w.hi and w.theme = b.theme left join bands o on year(a.date) between o.lo and o.hi and o.theme = 'other')
select name, prior, score, cast(rank as int) as rank from (select *, row_number() over (partition by name order by score desc, prior) as rank from p) where rank <= 3"""


@query("R5_prior_events", f", {BANDS}, c as (select *, {CASE_THEME} as theme, [category, cast(stage as varchar)] as cats, [left(category, 1), cast(floor(amount / 100000) as int)::varchar, 'the'] as tok from cases), {PRIOR}", "cases")
def r5(spark, d):
    c = V.cases(spark, d).select("name", "company", "date", F.array("category", F.col("stage").cast("string")).alias("categories"), F.array(F.substring("category", 1, 1), F.floor(F.col("amount") / 100000).cast("string"), F.lit("the")).alias("tokens"), case_theme().alias("theme"))
    return R.prior_events(c, k=3).select("name", "prior", "score", "rank")


@query("R5_prior_events_own_words", f", {BANDS}, c as (select name, case when name % 10 = 0 then 0 else company end as company, date, {CASE_THEME} as theme, [category] as cats, ['w' || name % 997, 'v' || name, left(category, 1), 'the'] as tok from cases), {PRIOR}", "cases")
def r5_own_words(spark, d):
    """A company with a tenth of all cases, each of which has words of its own and one that a few others have."""
    tokens = F.array(F.concat(F.lit("w"), (F.col("name") % 997).cast("string")), F.concat(F.lit("v"), F.col("name").cast("string")), F.substring("category", 1, 1), F.lit("the"))
    c = V.cases(spark, d).withColumn("company", F.when(F.col("name") % 10 == 0, 0).otherwise(F.col("company")))
    return R.prior_events(c.select("name", "company", "date", F.array("category").alias("categories"), tokens.alias("tokens"), case_theme().alias("theme")), k=3)


GRADE = "case when stage = 1 then case when probability < 0.5 then 1 else 2 end when stage = 2 then 3 when stage = 3 then 4 else 5 end"


@query("R6_severity_grade", f"select name, {GRADE} as grade from cases", "cases")
def r6(spark, d):
    return V.cases(spark, d).select("name", R.severity_grade(F.col("stage"), F.col("probability")).alias("grade"))


def actions(spark, d):
    c = V.cases(spark, d)
    return c.select(F.col("name").alias("id"), F.year("date").alias("year"), "date", F.concat(F.lit("action "), F.col("name").cast("string")).alias("title"), F.when(F.col("name") % 3 == 0, F.col("probability") * 25).alias("support"))


WHOLE = """actions as (select name as id, year(date) as year, date, 'action ' || name as title, case when name % 3 = 0 then probability * 25 end as support from cases), years as (select distinct year(date) as of from cases),
j as (select of, a.*, row_number() over (partition by of order by a.date desc, a.id) as place from years join actions a on a.year between of - 2 and of),
h as (select of, count(*) as n_actions, string_agg(title, ' | ' order by place) filter (place <= 3) as digest, case when max(coalesce(support, 0)) >= 20 then 'partial' else 'non-responsive' end as responsiveness from j group by 1)"""


@query("R7_action_history", f", {WHOLE} select name, n_actions, digest, responsiveness from cases c join h on of = year(c.date)", "cases")
@query("R7_action_history_whole", f", {WHOLE} select name, n_actions, digest, responsiveness from cases c join h on of = year(c.date)", "cases")
def r7(spark, d):
    """Every order is an action."""
    return R.action_history(V.cases(spark, d).select("name", F.year("date").alias("year")), actions(spark, d))


@query("R8_actual_action", "select name, case when year(date) % 3 = 0 then 'history ' || year(date) when year(date) % 3 = 1 then 'activism ' || year(date) when year(date) >= 2000 and name % 2 = 0 then 'stored ' || name end as actual from cases", "cases")
def r8(spark, d):
    c = V.cases(spark, d).select("name", F.year("date").alias("year"))
    years = c.select("year").distinct()
    text = lambda kind, of: F.concat(F.lit(kind), F.col(of).cast("string")).alias("action")
    history, activism = years.filter("year % 3 = 0").select("year", text("history ", "year")), years.filter("year % 3 in (0, 1)").select("year", text("activism ", "year"))
    stored = c.filter("name % 2 = 0").select("name", text("stored ", "name"))
    return R.actual_action(c, history, activism, stored, stored_from=2000).select("name", "actual")


@query("R9_severity_ranking", f"select name, {GRADE} as grade, stage, probability from cases order by grade desc, stage desc, probability desc, name limit 5", "cases")
def r9(spark, d):
    c = V.cases(spark, d).withColumn("grade", R.severity_grade(F.col("stage"), F.col("probability")))
    return R.ranked_by_severity(c).select("name", "grade", "stage", "probability")


@query("R9_run_counts", f"select count(*) as events, count(distinct company) as companies, min(date) as first_day, max(date) as last_day, {', '.join(f'count(*) filter (grade = {g}) as grade_{g}' for g in range(1, 6))} from (select company, date, {GRADE} as grade from cases)", "cases")
def r9_counts(spark, d):
    return R.severity_counts(V.cases(spark, d).withColumn("grade", R.severity_grade(F.col("stage"), F.col("probability"))))


NAMED = "named as (select name, case name % 6 when 0 then 'Airline WINS award' when 1 then 'Privacy breach' when 2 then 'Bonus row' when 3 then 'Court fine' else 'Delay' end as title, case name % 4 when 0 then ['safety', 'incident'] when 1 then ['Governance'] else ['service'] end as cats, floor(amount / 100000) as damage, cast(name % 40 as int) as n, name % 3 = 0 as own from cases)"


def named_cases(spark, d):
    rest, kind = F.col("name") % 6, F.col("name") % 4
    title = F.when(rest == 0, "Airline WINS award").when(rest == 1, "Privacy breach").when(rest == 2, "Bonus row").when(rest == 3, "Court fine").otherwise("Delay")
    cats = F.when(kind == 0, F.array(F.lit("safety"), F.lit("incident"))).when(kind == 1, F.array(F.lit("Governance"))).otherwise(F.array(F.lit("service")))
    return V.cases(spark, d).select("name", title.alias("title"), cats.alias("cats"), F.floor(F.col("amount") / 100000).alias("damage"), (F.col("name") % 40).alias("n"), (F.col("name") % 3 == 0).alias("own"))


@query("R10_materiality_hint", f""", {NAMED} select name, case when own and (title = 'Bonus row' or cats = ['Governance']) then false when own and cats = ['safety', 'incident'] then false when title = 'Privacy breach' and n < 30 and damage <= 2.5 then true when title = 'Airline WINS award' then true else damage <= 2 and n < 15 end as hint from named""", "cases")
def r10(spark, d):
    return named_cases(spark, d).select("name", R.materiality_hint(F.col("title"), F.col("cats"), F.col("damage"), F.col("n"), F.col("own")).alias("hint"))


@query("R11_governance_flag", f", {NAMED} select name, case when own and (title in ('Bonus row', 'Court fine') or cats = ['Governance']) then true else damage > 3 end as flag from named", "cases")
def r11(spark, d):
    return named_cases(spark, d).select("name", R.governance_flag(F.col("damage") > 3, F.col("title"), F.col("cats"), F.col("own")).alias("flag"))


LABELS = ("Do Nothing", "Share Opinion with Others", "Protest", "Sell Shares")
REACTED = "reacted as (select event_id as id, stakeholder, ['Do Nothing', 'Share Opinion with Others', 'Protest', 'Sell Shares'][cast(event_id % 4 as int) + 1] as label, score, user_id % 2 = 0 as material, event_id % 7 = 0 as governance, case when user_id % 5 = 0 then 'sector-wide' else 'own' end as context from reactions)"


@query("R12_reaction_rules", f""", {REACTED} select id, unnest(list_filter([case when label = 'Sell Shares' and stakeholder <> 'purchase' then 'label not allowed' end, case when not material and label in ('Protest', 'Sell Shares') then 'immaterial: label' end, case when not material and abs(score) > 1 then 'immaterial: score' end,
 case when stakeholder = 'purchase' and not governance and label in ('Protest', 'Sell Shares') then 'guard: label' end, case when stakeholder = 'purchase' and not governance and abs(score) > 1 then 'guard: score' end, case when stakeholder = 'click' and label = 'Protest' and context = 'sector-wide' then 'context ban' end], lambda x: x is not null)) as rule from reacted""", "reactions")
def r12(spark, d):
    r = V.reactions(spark, d)
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = r.select(F.col("event_id").alias("id"), "stakeholder", label.alias("label"), "score", (F.col("user_id") % 2 == 0).alias("material"), (F.col("event_id") % 7 == 0).alias("governance"), F.when(F.col("user_id") % 5 == 0, "Sector-Wide").otherwise("own").alias("context"))
    kinds = r.select("stakeholder").distinct().crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in LABELS], "label string")))
    allowed = kinds.filter("label <> 'Sell Shares' or stakeholder = 'purchase'")
    banned = spark.createDataFrame([("click", "Protest", "sector-wide")], "stakeholder string, label string, context string")
    return R.reaction_violations(rows, allowed, banned, guarded="purchase")


@query("R13_vote_class", "select year, topic, round(against_pct, 4) as against_pct, case when against_pct > 33.5 then 'contentious' when against_pct >= 32 then 'unsuccessful' else 'passed' end as class from votes", "votes")
def r13(spark, d):
    return V.votes(spark, d).select("year", "topic", F.round("against_pct", 4).alias("against_pct"), R.vote_class(F.col("against_pct"), contentious=33.5, unsuccessful=32.0).alias("class"))


STRIKE = 33.0


@query("R14_remuneration_strikes", f", best as (select year, arg_max(against_pct, row(topic = '3-MEDIUM', topic)) as p from votes group by 1) select year, round(p, 4) as against_pct, case when p < {STRIKE} then 'none' when lag(year) over (order by year) = year - 1 and lag(p) over (order by year) >= {STRIKE} then 'second' else 'first' end as strike from best", "votes")
def r14(spark, d):
    v = V.votes(spark, d).select("year", F.when(F.col("topic") == "3-MEDIUM", "results").otherwise("notice").alias("kind"), F.col("topic").alias("place"), "against_pct")
    return R.remuneration_strikes(v, strike=STRIKE).withColumn("against_pct", F.round("against_pct", 4))


@query("R15_protest_votes", ", y as (select year, count(*) as resolutions, count(*) filter (against_pct > 33.5) as contentious, max(against_pct) as top from votes group by 1) select year, resolutions, contentious, round(top, 4) as top, case when top < 34 then 'none' when lag(top) over (order by year) >= 34 then 'second' else 'first' end as strike from y", "votes")
def r15(spark, d):
    return R.protest_votes(V.votes(spark, d), strike=34.0, contentious=33.5).withColumn("top", F.round("top", 4))


@query("R16_merged_resolutions", """select doc_id, arg_min(score, run) filter (score <> 0) as score, arg_min(confidence, run) filter (confidence <> 0) as confidence, arg_min(topic, run) filter (topic <> '') as topic, list(source order by s) as sources from
(select doc_id, score, confidence, topic, run, null as source, null as s from runs union all select doc_id, null, null, null, null, label, run from (select doc_id, label, min(run) as run from runs group by 1, 2)) group by 1""".replace("list(source order by s)", "list(source order by s) filter (source is not null)"), "runs")
def r16(spark, d):
    rows = V.runs(spark, d).withColumn("source", F.col("label"))
    return R.merged_resolutions(rows, "doc_id", priority="run", fields=("score", "confidence", "topic"))


@query("R17_activism_rollup", "select year(date) as year, bool_or(name % 1000 = 0) as any_activism, coalesce(list('t' || name order by 't' || name) filter (name % 1000 = 0), []) as titles, list_sort(list(distinct category)) as proposers, arg_min(probability, name) filter (name % 5 = 0) as first_vote from cases group by 1", "cases")
def r17(spark, d):
    c = V.cases(spark, d)
    rows = c.select(F.year("date").alias("year"), (F.col("name") % 1000 == 0).alias("activist"), F.concat(F.lit("t"), F.col("name").cast("string")).alias("title"), F.col("category").alias("proposer"), F.when(F.col("name") % 5 == 0, F.col("probability")).alias("vote"), F.col("name").alias("place"))
    return R.activism_rollup(rows)

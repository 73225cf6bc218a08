"""Queries over sources, sinks, keys, dates and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import bars as B
from ..sources import articles as A
from . import prices
from . import views as V
from .registry import query

ARTICLE = "id long, title string, url string, source string, date date, description string, ai_analysis struct<key_issues: array<string>, primary_entity: string>"


def _with_analysis(df):
    issues = F.when(F.col("id") % 5 != 0, F.array("lang", "source"))
    return df.withColumn("ai_analysis", F.when(F.col("id") % 7 != 0, F.struct(issues.alias("key_issues"), F.col("source").alias("primary_entity"))))


@query("I1_article_scan", "select id, description as full_content, source as primary_entity from articles where id % 5 <> 0 and id % 7 <> 0", "articles")
def i1(spark, d):
    path = A.shared_folder(spark, "articles")
    _with_analysis(V.articles(spark, d)).write.json(path)
    return A.scan_articles(spark, path, ARTICLE).select("id", "full_content", "ai_analysis.primary_entity")


BAR = "date: date, open: double, high: double, low: double, close: double, volume: bigint, daily_change: double, daily_change_percent: double"


@query("I2_price_document", "select * from bars", prices.BARS)
def i2(spark, d):
    path = A.shared_folder(spark, "prices")
    rows = prices.bars(spark, d).withColumn("year", F.year("date"))
    one = rows.groupBy("year").agg(F.collect_list(F.struct("date", "open", "high", "low", "close", "volume", "daily_change", "daily_change_percent")).alias("data"), F.count("*").alias("n"))
    one.select(F.struct("year").alias("metadata"), F.struct("n").alias("statistics"), "data").write.json(path)  # one document for each year
    return A.scan_price_document(spark, path, f"data array<struct<{BAR}>>")


@query("I3_analysis_scan", "select doc_id as id, quality, toxic, lang from labelled", "labelled")
def i3(spark, d):
    path = A.shared_folder(spark, "analysis")
    rows = V.labelled(spark, d).select(F.col("doc_id").alias("id"), F.struct(F.array("lang").alias("key_issues"), F.col("quality"), F.col("toxic")).alias("ai_analysis"), F.lit(None).cast("string").alias("description"), "lang")
    rows.write.json(path)
    found = A.scan_articles(spark, path, "id long, description string, lang string, ai_analysis struct<key_issues: array<string>, quality: int, toxic: int>")
    return found.select("id", "ai_analysis.quality", "ai_analysis.toxic", "lang")


@query("I4_drops_csv", "select row_number() over (order by daily_change_percent, date) as rank, date, daily_change_percent from bars where daily_change_percent < -3 order by daily_change_percent, date limit 100", prices.BARS)
def i4(spark, d):
    path = A.shared_folder(spark, "drops")
    B.significant_drops(prices.bars(spark, d)).select("rank", "date", "daily_change_percent").write.csv(path, header=True)
    return spark.read.schema("rank int, date date, daily_change_percent double").csv(path, header=True)


@query("I6_json_sink", "select id, title, date from articles", "articles")
def i6(spark, d):
    path = A.shared_folder(spark, "json")
    V.articles(spark, d).select("id", "title", "date").write.json(path)
    return spark.read.schema("id long, title string, date date").json(path)


@query("I7_csv_flattening", "select id, lang, lang || ', ' || source as labels from articles", "articles")
def i7(spark, d):
    return A.flattened(V.articles(spark, d).withColumn("labels", F.array("lang", "source")), ("id", "lang", "labels"))


@query("I8_partitioned_sink", r"""select page_id, 2020 + cast(page_id % 4 as int) as year, 1 + cast(page_id % 12 as int) as month, substr(md5(url), 1, 8) || '_' || regexp_replace(trim(substr(regexp_replace(lower(url), '[^\p{L}\p{N}_\s-]', '', 'g'), 1, 50)), '[-\s]+', '-', 'g') as file_key from pages""")
def i8(spark, d):
    path = A.shared_folder(spark, "by-month")
    rows = V.table(spark, d, "pages").select("page_id", (2020 + F.col("page_id") % 4).cast("int").alias("year"), (1 + F.col("page_id") % 12).cast("int").alias("month"), A.file_key(F.col("url"), F.col("url")).alias("file_key"))
    rows.write.partitionBy("year", "month").parquet(path)
    return spark.read.schema("page_id long, file_key string, year int, month int").parquet(path).select("page_id", "year", "month", "file_key")


@query("I9_skip_seen", "select page_id, url from pages where url not in (select url from pages where page_id % 3 = 0)")
def i9(spark, d):
    p = V.table(spark, d, "pages").select("page_id", "url")
    return A.unseen(p, p.filter("page_id % 3 = 0"), "url").select("page_id", "url")


for _days in (90, 365 * 5):

    @query(f"I10_window_{_days}d", f"select name, date from cases where date >= date '2001-06-30' - {_days}", "cases")
    def i10(spark, d, days=_days):
        return A.recent(V.cases(spark, d).select("name", "date"), "date", F.lit("2001-06-30").cast("date"), days)


@query("I11_drop_nulls", "select d.doc_id, quality from documents d join labels using (doc_id)")
def i11(spark, d):
    return V.table(spark, d, "documents").select("doc_id").join(V.table(spark, d, "labels"), "doc_id", "left").filter("quality is not null").select("doc_id", "quality")


@query("I12_first_url", "select min(page_id) as page_id, url from pages where url <> '' group by url")
def i12(spark, d):
    return A.first_of(V.table(spark, d, "pages").select("page_id", "url"), ("url",), "page_id")


@query("I13_composite_key", "select row_key, min(l_partkey) as l_partkey from (select l_orderkey || '|' || cast(l_shipdate as date) || '|' || l_linenumber as row_key, l_partkey from lineitem) group by 1")
def i13(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.concat_ws("|", F.col("l_orderkey").cast("string"), V.day("l_shipdate").cast("string"), F.col("l_linenumber").cast("string")).alias("row_key"), "l_partkey")
    return A.first_of(rows, ("row_key",), "l_partkey")


@query("I14_content_keys", "select id, md5(title || '_' || source) as article_key, md5(title || '_' || substr(description, 1, 200)) as snippet_key, title || '|' || date || '|' || substr(md5(description), 1, 8) as event_key, substr(sha256(source), 1, 16) as url_key from articles", "articles")
def i14(spark, d):
    keys = A.content_keys(F.col("title"), F.col("source"), F.col("date"), F.col("description"))
    return V.articles(spark, d).select("id", *[c.alias(k) for k, c in keys.items()])


@query("I15_set_and_pair_keys", """select regexp_extract(url, '://([^/?#]*)', 1) as host, md5(string_agg(url, '|' order by url)) as set_key,
 least(md5(substr(min(html), 1, 1000)), md5(substr(max(html), 1, 1000))) || '_' || greatest(md5(substr(min(html), 1, 1000)), md5(substr(max(html), 1, 1000))) as pair_key from pages group by 1""")
def i15(spark, d):
    g = V.table(spark, d, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return g.agg(A.set_key(F.collect_list("url")).alias("set_key"), A.pair_key(F.min("html"), F.max("html")).alias("pair_key"))


@query("I16_memo", "select doc_id, case when doc_id % 2 = 0 then quality else 10 + toxic end as verdict from labels")
def i16(spark, d):
    rows = V.table(spark, d, "labels").select("doc_id", "quality", "toxic")
    memo = rows.filter("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("verdict"))
    return A.memoized(rows, memo, "doc_id", lambda new: new.select("doc_id", (F.col("toxic") + 10).alias("verdict")))


BOUNDS = "bounds as (select min(date) as lo, max(date) as hi from cases)"


def bounds(spark, d):
    return V.cases(spark, d).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))


@query("I17_month_spine", f", {BOUNDS} select cast(greatest(m, lo) as date) as start_date, least(last_day(cast(m as date)), hi) as end_date from (select unnest(generate_series(cast(date_trunc('month', lo) as timestamp), cast(hi as timestamp), interval 1 month)) as m, lo, hi from bounds)", "cases")
def i17(spark, d):
    return D.month_spine(bounds(spark, d), "lo", "hi")


@query("I18_quarter_spine", f", {BOUNDS} select cast(year(q) as int) as year, cast(quarter(q) as int) as quarter from (select unnest(generate_series(cast(date_trunc('quarter', lo) as timestamp), cast(hi as timestamp), interval 3 month)) as q from bounds)", "cases")
def i18(spark, d):
    return D.quarter_spine(bounds(spark, d), "lo", "hi")


@query("I19_coverage", f", {BOUNDS}, spine as (select year(q) as y, quarter(q) as q from (select unnest(generate_series(cast(date_trunc('quarter', lo) as timestamp), cast(hi as timestamp), interval 3 month)) as q from bounds)), facts as (select distinct year(date) as y, quarter(date) as q from cases where amount > 499500) select count(f.y) as found, count(*) - count(f.y) as missing from spine s left join facts f using (y, q)", "cases")
def i19(spark, d):
    facts = V.cases(spark, d).filter("amount > 499500").select(F.year("date").alias("year"), F.quarter("date").alias("quarter"))
    return A.coverage(D.quarter_spine(bounds(spark, d), "lo", "hi"), facts, ("year", "quarter"))


@query("F1_host", "select page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host from pages")
def f1(spark, d):
    return V.table(spark, d, "pages").select("page_id", D.host(F.col("url")).alias("host"))


_DAY = "cast(date '2023-01-01' + cast(page_id % 700 as int) as varchar)"
PAGES = f"""fields as (select page_id, case when page_id % 5 = 0 then {_DAY} when page_id % 5 = 1 then 'soon' end as field, case when page_id % 5 = 2 then 'http://x.org/' || {_DAY} || '/a' else url end as url,
 case when page_id % 5 = 3 then 'on ' || strftime(date '2023-01-01' + cast(page_id % 700 as int), '%b %-d, %Y') || ' it' else 'none' end as snippet, date '2023-01-01' + cast(page_id % 700 as int) as d from pages)"""
ARTICLE_DATE = "case when page_id % 5 in (0, 2, 3) then d end"


def fields(spark, d):
    p = V.table(spark, d, "pages")
    date = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") % 700).cast("int"))
    rest, text = F.col("page_id") % 5, date.cast("string")
    return p.select(
        "page_id",
        F.when(rest == 0, text).when(rest == 1, "soon").alias("field"),
        F.when(rest == 2, F.concat(F.lit("http://x.org/"), text, F.lit("/a"))).otherwise(F.col("url")).alias("url"),
        F.when(rest == 3, F.concat(F.lit("on "), F.date_format(date, "MMM d, yyyy"), F.lit(" it"))).otherwise("none").alias("snippet"),
    )


@query("F2_article_date", f"with {PAGES} select page_id, {ARTICLE_DATE} as date from fields")
def f2(spark, d):
    return fields(spark, d).select("page_id", D.article_date(F.col("field"), F.col("url"), F.col("snippet")).alias("date"))


@query("F3_month_key", f"with {PAGES} select page_id, strftime({ARTICLE_DATE}, '%Y-%m') as month from fields where page_id % 5 in (0, 2, 3)")
def f3(spark, d):
    return fields(spark, d).select("page_id", D.month_key(D.article_date(F.col("field"), F.col("url"), F.col("snippet"))).alias("month")).filter("month is not null")


@query("F4_valid_date", r"select event_id, regexp_full_match(t, '\d{4}-\d{2}-\d{2}') and try_strptime(t, '%Y-%m-%d') is not null as valid from (select event_id, '2024-' || lpad(cast(event_id % 14 as varchar), 2, '0') || '-' || lpad(cast(event_id % 33 as varchar), 2, '0') as t from events)")
def f4(spark, d):
    part = lambda n: F.lpad((F.col("event_id") % n).cast("string"), 2, "0")
    t = F.concat_ws("-", F.lit("2024"), part(14), part(33))
    return V.table(spark, d, "events").select("event_id", D.is_date(t).alias("valid"))


WORDS = ("the", "tion", "queux", "que", "and", "ung", "ción", "est")
LIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"


@query("F5_keyword_hits", f"select id, list_filter({LIST}, lambda k: contains(lower(title || ' ' || description), k)) as matched from articles", "articles")
def f5(spark, d):
    return V.articles(spark, d).select("id", X.matched(F.concat_ws(" ", "title", "description"), WORDS).alias("matched"))


_T = "lower(description)"
_SUM = " + ".join(f"case when contains({_T}, '{w}') then {p} else 0 end" for w, p in (("tion", 2.0), ("ing", 2.0), ("er", 1.0), ("on", 1.0), ("an", 1.5)))


@query("F6_relevance", f"select id, least(10.0::double, (case when contains({_T}, 'the') then 5.0 when contains({_T}, 'th') then 3.0 else 0 end + {_SUM} + case when contains({_T}, 'th') and source in ('src1', 'src2') then 2.0 else 0 end)::double) as score from articles", "articles")
def f6(spark, d):
    score = X.relevance(F.col("description"), F.col("source").isin("src1", "src2"), name="the", short="th", damage=("tion", "ing"), industry=("er", "on"), executive=("an",))
    return V.articles(spark, d).select("id", score.alias("score"))


@query("F7_trusted_source", "select page_id, url from pages where lower(regexp_extract(url, '://([^/?#]*)', 1)) in ('therin.example.net', 'ththin.example.com', 'therha.example.com')")
def f7(spark, d):
    trusted = spark.createDataFrame([("therin.example.net",), ("ththin.example.com",), ("therha.example.com",)], "host string")
    p = V.table(spark, d, "pages").select("page_id", "url", D.host(F.col("url")).alias("host"))
    return p.join(F.broadcast(trusted), "host", "left_semi").select("page_id", "url")


@query("F8_clean_for_embedding", r"select id, substr(coalesce(nullif(trim(regexp_replace(description, '\s+', ' ', 'g')), ''), 'empty'), 1, 8000) as clean from articles", "articles")
def f8(spark, d):
    return V.articles(spark, d).select("id", X.clean_for_embedding(F.col("description")).alias("clean"))


@query("F9_normal_form", r"select id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(description), '!+', '!', 'g'), '[?]+', '?', 'g'), '[.]+', '.', 'g'), ',+', ',', 'g'), '\s+', ' ', 'g')) as clean from articles", "articles")
def f9(spark, d):
    return V.articles(spark, d).select("id", X.normal_form(F.col("description")).alias("clean"))


@query("F10_dataset_text", r"select id, regexp_replace(lower(description), '[^\p{L}\p{N}_\s]', '', 'g') as description from articles where length(regexp_replace(lower(description), '[^\p{L}\p{N}_\s]', '', 'g')) >= 50", "articles")
def f10(spark, d):
    return X.dataset_text(V.articles(spark, d).select("id", "description"), "description", remove_special=True, least=50)


#: Groups of response and stakeholder names.
RESPONSES = {
    "Policy Change": ("policy-change", "policy changes", "policy change"), "Legal Action": ("legal-action", "legal action", "legal actions"), "Apology": ("apology", "apologies", "apologize"), "Compensation": ("compensation", "compensate", "compensatory"),
    "Investigation": ("investigation", "investigate", "investigative"), "Communication": ("communication", "communicate", "public communication"), "Reform": ("reform", "reforms", "reformative"), "Denial": ("denial", "deny", "denies"),
    "Transparency": ("transparency", "transparent", "transparency measures"), "Training": ("training", "train", "employee training"), "PR Statement": ("pr-statement", "public statement", "public statements"),
    "Executive Remuneration": ("executive remuneration", "executive bonus reduction", "bonus reduction", "executive pay cut", "executive compensation reduction", "shareholder action on executive pay", "personnel-change", "executive pay reduction", "bonus cuts", "executive compensation scrutiny", "no short-term bonuses awarded to executives", "no short-term bonuses awarded to executives in 2020 and 2021", "prioritization of shareholder dividends and executive pay", "executive pay cuts demanded by shareholders", "reduction of former ceo pay", "increased shareholder and investor scrutiny of executive pay", "potential policy changes regarding executive compensation"),
    "Termination of Employment": ("termination of employment", "ceo forced out", "executive termination", "forced resignation", "executive dismissal", "leadership change", "ceo removal", "personnel change", "executive departure", "leadership transition", "resignation of ceo", "resignation of chairman", "withholding of ex-ceo payout", "clawback of long-term incentive payment"),
    "Increased Transparency": ("public disclosure of executive compensation in the annual report", "transparency", "transparent", "transparency measures", "public disclosure"),
}
STAKEHOLDERS = {
    "Employees": ("employees", "employee"), "Customers": ("customers", "customer", "passengers"), "General Public": ("society", "general public", "public", "the public", "general_public"), "Shareholders": ("shareholders", "shareholder"),
    "Management": ("management", "ceo", "board"), "Regulators": ("regulators", "regulatory bodies", "regulatory"), "Unions": ("unions", "union"), "Suppliers": ("suppliers",), "Competitors": ("competitors",), "Media": ("media",), "Government": ("government",),
}


def _case(groups, value):
    done, arms = set(), []
    for g, names in groups.items():
        own = [n for n in names if n not in done]
        done.update(own)
        if own:
            arms.append(f"when {value} in ({', '.join(repr(n) for n in own)}) then '{g}'")
    return "case " + " ".join(arms) + f" else array_to_string(list_transform(string_split({value}, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') end"


RESPONSE_LIST = [n for names in RESPONSES.values() for n in names] + ["quiet talks", "site visit"]
STAKEHOLDER_LIST = [n for names in STAKEHOLDERS.values() for n in names] + ["local schools", "pilots"]


def _cycled(values):
    return "[" + ", ".join(repr(v) for v in values) + f"][cast(event_id % {len(values)} as int) + 1]"


def _cycle(values):
    return F.element_at(X.words(tuple(values)), (F.col("event_id") % len(values) + 1).cast("int"))


@query("F11_response_label", f"select event_id, {_case(RESPONSES, 'v')} as label from (select event_id, {_cycled(RESPONSE_LIST)} as v from events)")
def f11(spark, d):
    rows = V.table(spark, d, "events").select("event_id", F.concat(F.lit(" "), F.upper(_cycle(RESPONSE_LIST)), F.lit("..")).alias("raw"))
    return X.canonical(rows, "raw", RESPONSES, out="label", strip_period=True).select("event_id", "label")


@query("F12_stakeholder_label", f"select event_id, {_case(STAKEHOLDERS, 'v')} as label from (select event_id, {_cycled(STAKEHOLDER_LIST)} as v from events)")
def f12(spark, d):
    rows = V.table(spark, d, "events").select("event_id", F.concat(F.upper(_cycle(STAKEHOLDER_LIST)), F.lit(" ")).alias("raw"))
    return X.canonical(rows, "raw", STAKEHOLDERS, out="label").select("event_id", "label")


@query("F14_word_chunks", r"""select id, cast(i // 500 as int) as chunk, cast(i as int) as start, cast(least(i + 500, len(w)) as int) as "end", array_to_string(w[i + 1:i + 500], ' ') as text from (select id, w, unnest(range(0, len(w), 500)) as i from (select id, list_filter(regexp_split_to_array(trim(description), '\s+'), lambda x: x <> '') as w from articles))""", "articles")
def f14(spark, d):
    return X.chunked(V.articles(spark, d), "id", "description", size=500)


@query("F15_bullet_lines", r"""select id, cast(place as int) as place, substr(t, 1, 200) as title from (select id, unnest(b) as t, generate_subscripts(b, 1) - 1 as place from (select id, list_filter(list_transform(list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(l)), lambda l: regexp_matches(l, '^(\d+[.)]|[-*•])\s*')), lambda l: trim(regexp_replace(l, '^(\d+[.)]|[-*•])\s*', ''))), lambda l: length(l) > 20)[1:10] as b
from (select id, '1. ' || replace(description, '. ', chr(10) || '- ') as x from articles)))""", "articles")
def f15(spark, d):
    rows = V.articles(spark, d).select("id", F.concat(F.lit("1. "), F.replace("description", F.lit(". "), F.lit("\n- "))).alias("x"))
    return X.bullet_lines(rows, "id", "x")


@query("F16_resolutions", r"""select id, 'numbered_resolution' as type, cast(id as varchar) as number, a as title, null::double as votes_for, null::double as votes_against from r
union all select id, case when id % 2 = 0 then 'ordinary' else 'special' end || '_resolution', null, b, null, null from r
union all select id, 'voting_result', null, 'Item ' || id, id % 100 + 0.5::double, 12.0::double from r""", "articles r")
def f16(spark, d):
    word = F.element_at(F.split("title", r"[\s.,]+"), 1)
    kind = F.when(F.col("id") % 2 == 0, "Ordinary").otherwise("SPECIAL")
    text = F.concat(F.lit("Resolution "), F.col("id").cast("string"), F.lit(": "), word, F.lit(" one\n"), kind, F.lit(" resolution: "), F.lower(word), F.lit(" two \nItem "), F.col("id").cast("string"), F.lit(" had "), (F.col("id") % 100).cast("string"), F.lit(".5% for and\n12% against"))
    return X.resolutions(V.articles(spark, d).select("id", text.alias("text")), "id", "text")


@query("F17_json_payload", "select event_id, cast(props ->> 'k' as int) as k from events where event_id % 4 <> 3")
def f17(spark, d):
    rest = F.col("event_id") % 4
    text = F.when(rest == 0, F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n``` {done}"))).when(rest == 1, F.concat(F.lit("so "), F.col("props"), F.lit(" it is"))).when(rest == 2, F.col("props")).otherwise("nothing here")
    rows = V.table(spark, d, "events").select("event_id", F.from_json(X.json_in(text), "k int", {"mode": "PERMISSIVE"}).alias("j"))
    return rows.filter("j.k is not null").select("event_id", "j.k")


@query("F18_factor_typing", "select event_id, case when event_id % 3 = 0 then 'positive' else 'neutral' end as direction, case when event_id % 2 = 0 then 'primary' else 'secondary' end as centrality, event_id % 3 = 1 as causal, case when event_id % 4 = 0 then cast(props ->> 'k' as int) / 100 else 0.5::double end as confidence from events")
def f18(spark, d):
    e = F.col("event_id")
    fields_ = [F.when(e % 3 == 0, '"direction": "POSITIVE"'), F.when(e % 2 == 0, '"centrality": "Primary"'), F.when(e % 3 == 1, '"causal": "true"'), F.when(e % 4 == 0, F.concat(F.lit('"confidence": "'), (F.get_json_object("props", "$.k").cast("int") / 100).cast("string"), F.lit('"'))).when(e % 4 == 1, '"confidence": "high"')]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *fields_), F.lit("}"))
    return V.table(spark, d, "events").select("event_id", *soft_typed(text))


def soft_typed(text):
    """The fields of a factor with defaults for what is missing or of the wrong kind."""
    j = F.from_json(text, "direction string, centrality string, causal string, confidence string")
    return [F.lower(F.coalesce(j["direction"], F.lit("neutral"))).alias("direction"), F.lower(F.coalesce(j["centrality"], F.lit("secondary"))).alias("centrality"), F.coalesce(j["causal"].try_cast("boolean"), F.lit(False)).alias("causal"), F.coalesce(j["confidence"].try_cast("double"), F.lit(0.5)).alias("confidence")]


#: Elements that name an article's author, and those that date it, in the order in which they are asked.
AUTHOR = (r"""(?is)<\w+\b[^>]*class=["'][^"'>]*\bauthor\b[^>]*>([^<]+)""", r"""(?is)<\w+\b[^>]*class=["'][^"'>]*\bbyline\b[^>]*>([^<]+)""", r"""(?is)<\w+\b[^>]*rel=["']author["'][^>]*>([^<]+)""", r"""(?is)<meta\b[^>]*name=["']author["'][^>]*content=["']([^"']+)""", r"""(?is)<\w+\b[^>]*itemprop=["']author["'][^>]*>([^<]+)""")
PUBLISHED = (r"""(?is)<time\b[^>]*datetime=["']([^"']+)""", r"""(?is)<time\b[^>]*>([^<]+)""", r"""(?is)<\w+\b[^>]*\bdatetime=["']([^"']+)""", r"""(?is)<\w+\b[^>]*class=["'][^"'>]*\b(?:publication|article|post)-date\b[^>]*>([^<]+)""", r"""(?is)<meta\b[^>]*property=["']article:published_time["'][^>]*content=["']([^"']+)""", r"""(?is)<meta\b[^>]*name=["']publish_date["'][^>]*content=["']([^"']+)""")


def first_found(html, patterns):
    """What the first of the patterns that finds something captures, or null."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit("")) for p in patterns])


def _first_sql(patterns):
    return "coalesce(" + ", ".join("nullif(trim(regexp_extract(html, '" + p.replace("'", "''") + "', 1)), '')" for p in patterns) + ")"


@query("F20_page_article", rf"select page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title, len(regexp_extract_all(html, '(?i)<p[ >]')) as paragraphs, regexp_extract(html, '(?i)<html lang=\"([a-z]+)\"', 1) as lang, {_first_sql(AUTHOR)} as author, {_first_sql(PUBLISHED)} as published from pages")
def f20(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"(?i)<p[ >]")).alias("paragraphs"), F.regexp_extract("html", r'(?i)<html lang="([a-z]+)"', 1).alias("lang"), first_found("html", AUTHOR).alias("author"), first_found("html", PUBLISHED).alias("published"))


def page_body(html):
    """The longest text among article-like containers, or all longer paragraphs where that is short."""
    def plain(x):
        return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))

    bare = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1>", " ")
    parts = F.concat(F.regexp_extract_all(bare, F.lit(r"(?is)<article\b[^>]*>(.*?)</article>"), F.lit(1)), F.regexp_extract_all(bare, F.lit(r"(?is)<main\b[^>]*>(.*?)</main>"), F.lit(1)))
    longest = F.array_max(F.transform(parts, lambda x: F.struct(F.length(plain(x)).alias("n"), plain(x).alias("text"))))["text"]
    paragraphs = F.filter(F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<p\b[^>]*>(.*?)(?:</p>|(?=<p\b)|$)"), F.lit(1)), plain), lambda x: F.length(x) > 50)
    return F.when(F.length(longest) >= 200, longest).otherwise(F.array_join(paragraphs, "\n"))


PLAIN = r"trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
BODY = rf"""bare as (select page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>', ' ', 'g') as html from pages),
parts as (select page_id, list_transform(regexp_extract_all(html, '(?is)<article\b[^>]*>(.*?)</article>', 1) || regexp_extract_all(html, '(?is)<main\b[^>]*>(.*?)</main>', 1), lambda x: {PLAIN}) as parts,
 list_transform(list_transform(string_split_regex(html, '(?i)<p\b[^>]*>')[2:], lambda x: regexp_replace(x, '(?is)</p>.*', '')), lambda x: {PLAIN}) as paragraphs from bare),
bodies as (select page_id, list_reverse_sort(list_transform(parts, lambda x: {{'n': length(x), 't': x}}))[1].t as longest, array_to_string(list_filter(paragraphs, lambda x: length(x) > 50), chr(10)) as rest from parts),
body as (select page_id, case when length(longest) >= 200 then longest else rest end as body from bodies)"""


@query("F20_page_body", rf"with {BODY} select page_id, body, cast(len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')) as int) as word_count from body")
def f20_body(spark, d):
    body = page_body(F.col("html"))
    return V.table(spark, d, "pages").select("page_id", body.alias("body")).withColumn("word_count", F.size(F.filter(F.split("body", r"\s+"), lambda w: w != "")))


@query("F21_event_summary", "select name, 'Event: ' || name || chr(10) || 'Date: ' || date || chr(10) || 'Categories: ' || category || chr(10) || 'Stage: ' || stage || case when amount > 250000 then chr(10) || 'Note: ' || case when length(category) > 5 then left(repeat(category, 4), 17) || '...' else repeat(category, 4) end else '' end as summary from cases", "cases")
def f21(spark, d):
    long_note = F.repeat("category", F.lit(4))
    note = F.when(F.col("amount") > 250000, F.concat(F.lit("Note: "), cut_text(long_note, 20)))
    lines = F.concat_ws("\n", F.concat(F.lit("Event: "), F.col("name").cast("string")), F.concat(F.lit("Date: "), F.col("date").cast("string")), F.concat(F.lit("Categories: "), "category"), F.concat(F.lit("Stage: "), F.col("stage").cast("string")), note)
    return V.cases(spark, d).select("name", lines.alias("summary"))


def cut_text(text, most: int = 200):
    """The text, or its beginning and '...' where it is longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


@query("F22_known_dates", "select p_partkey, case when contains(lower(p_name), 'red') then date '2011-10-29' when contains(lower(p_name), 'ring') then date '2012-01-01' else date '2000-01-01' end as date from part")
def f22(spark, d):
    rows = V.table(spark, d, "part").select("p_partkey", "p_name", F.lit("2000-01-01").cast("date").alias("date"))
    return D.corrected(rows, "p_name", "date", (("Red", "2011-10-29"), ("ring", "2012-01-01"))).select("p_partkey", "date")

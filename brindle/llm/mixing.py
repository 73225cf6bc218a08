"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source has a weight and may be repeated ``epochs`` times at most.  With a common level L a source gets
min(epochs * size, weight * L), and the level is the one at which the whole budget is used: what the capped sources leave
is shared by the others in proportion to their weights.  Sources are sorted by the level at which they meet their cap;
running sums over them give, for each number of capped sources, the level of the rest, and the right one is the first
that its next source can bear.  This is the result of clamping and resharing until nothing is above its cap.

A document is then taken floor(target / size of the source) times, and once more if it is drawn for the fractional
repetition.  Documents are drawn in the order of a seeded hash: those of a source are dealt by the hash into groups of
about GROUP documents, and each group takes the first of its documents until the fraction of its words is reached, a
document counting at its middle.  So every group, and with it the source, is within half a document of its share,
a hot source is many groups, and a rerun draws the same.

Cases: a null text has no words; a null source is a source, ordered last; a source without words has the target 0 and its
documents are taken 0 times; equal rows are drawn like any others, and so are rows that share an id or have none, each for
itself and by its own number, so that they are many groups like others; a very long text counts once, whole, and may put
its group off its share by half its words; no rows give no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, column, few, free_name, keyed, written

#: Documents of a source that are put in order together.
GROUP = 1024
#: A word, in Java's regular expressions and in DuckDB's.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(weights: tuple[float, ...]) -> Column:
    """The weights in turn for sources in order of code points, null last; to be used over the sources."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))


def source_targets(sizes: DataFrame, *, share: float, epochs: float) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs, weight): one row for each source."""
    everything = Window.partitionBy()
    cap = F.col("source_size") * F.lit(float(epochs))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    rows = sizes.withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    # the level if this source and all that come after it stay below their caps
    rows = rows.withColumn("try", (F.col("budget") - F.col("capped")) / F.col("open"))
    found = F.min(F.when(F.col("try") <= F.col("level"), F.struct("level", "try"))).over(everything)
    target = F.when(found.isNull() | (F.col("level") < found["level"]), F.col("cap")).otherwise(F.least("cap", F.col("weight") * found["try"]))
    return rows.select("source", "source_size", "n_docs", target.alias("target"))


def repetitions(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times, key): how many words of each document the mix takes.

    Documents are drawn by a number that no two rows share: ``key_col``, or else one that is made here, which is the id
    of every row whose id is its own.
    """
    key = [docs[key_col].alias("key")] if key_col else []
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, source_col).alias("source"), words(column(docs, text_col)).alias("size"), *key)
    rows = written(rows, "sizes")  # the texts are read once
    if not key_col:
        rows, name = keyed(rows, "doc_id")
        rows = rows.withColumnRenamed(name, "key")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).withColumn("weight", cycled_weights(weights))
    targets = source_targets(sizes, share=share, epochs=epochs).withColumnRenamed("source", "_source")
    small = rows.select("source").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("_source")))

    rows = rows.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key").cast("string"))))
    number = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    groups = F.ceil(F.col("n_docs") / GROUP)
    rows = rows.withColumn("group", number % groups)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate).cast("long")
    inside = Window.partitionBy("source", "group")
    order = inside.orderBy("draw", "key")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = before + F.col("size") / 2 < (rate - whole) * F.sum("size").over(inside)
    times = (whole + F.when(drawn & (F.col("size") > 0), 1).otherwise(0)).alias("times")
    rows = rows.select("doc_id", "size", "source_size", "target", times, "key")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "key")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, all columns as they were; rows may share an id or have none."""
    rows, key = keyed(docs, id_col)
    times = repetitions(rows, key_col=key, id_col=id_col, **options).filter("times > 0").select(F.col("key").alias("_taken"), "times")
    taken = written(times, "taken")
    copy = free_name(docs, "_copy")
    out = rows.join(few(taken), rows[key] == taken["_taken"])
    return out.select(*[column(rows, c) for c in docs.columns], F.explode(F.sequence(F.lit(1), taken["times"])).alias(copy)).drop(copy)


ORACLE_SQL = rf"""
with rows as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size from documents),
sizes as (select source, sum(size)::bigint as source_size, count(*) as n_docs,
  [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from rows group by source),
levels as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as level, (sum(source_size) over ())::double * 1.5::double as budget from sizes),
tries as (select *,
  (budget - coalesce(sum(cap) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by level, source nulls last rows between current row and unbounded following) as attempt from levels),
best as (select level as b_level, attempt as b_try from tries where attempt <= level order by level, attempt limit 1),
targets as (select source, source_size, n_docs, case when b_level is null or level < b_level then cap else least(cap, weight * b_try) end as target
  from tries left join best on true),
dealt as (select r.doc_id, r.size, t.*, md5('7:' || r.doc_id::varchar) as draw,
  case when source_size > 0 then target / source_size else 0 end as rate from rows r join targets t on r.source is not distinct from t.source),
grouped as (select *, ('0x' || draw[1:8])::ubigint % ceil(n_docs / 1024)::ubigint as grp from dealt),
drawn as (select *, coalesce(sum(size) over (partition by source, grp order by draw, doc_id rows between unbounded preceding and 1 preceding), 0) as before,
  sum(size) over (partition by source, grp) as group_size from grouped)
select doc_id, size::bigint as size, source_size, target,
  (size * (floor(rate) + case when size > 0 and before + size / 2.0::double < (rate - floor(rate)) * group_size then 1 else 0 end))::bigint as taken
from drawn
"""

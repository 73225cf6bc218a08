"""Quality of datasets and of extracted features: validation, splits, diversity, agreement, information value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.articles import few, stored


def validation_report(df: DataFrame, *, text: str, target: str, date: str) -> DataFrame:
    """One row: rows, empty texts, missing targets and dates, ranges, and statistics of target and text length."""
    missing = [c for c in (text, target, date) if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame([(False, f"missing columns: {', '.join(missing)}")], "valid boolean, errors string")
    n = F.length(text)
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(text).isNull() | (F.trim(text) == "")).alias("empty_texts"),
        F.count_if(F.col(target).isNull()).alias("missing_targets"),
        F.count_if(F.col(date).isNull()).alias("missing_dates"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.min(target).alias("min_target"),
        F.max(target).alias("max_target"),
        F.round(F.avg(target), 6).alias("mean_target"),
        F.round(F.stddev_samp(target), 6).alias("std_target"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.round(F.avg(n), 4).alias("mean_length"),
    ).withColumn("valid", (F.col("rows") > 0) & (F.col("missing_targets") < F.col("rows")))


#: Bins of a histogram.
BINS = 4_096


def with_position(df: DataFrame, *order: str, out: str = "position") -> DataFrame:
    """The rows with their place from 0 in the order, without a task that holds all.

    The rows are dealt by range and written once with the number of their range, so that the sizes of ranges and the places
    inside them are read from the same rows; each range is numbered from what lies before it.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = ranged.join(few(sizes.select("_part", before.alias("_before"))), "_part")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    return ranged.withColumn(out, place.cast("long")).drop("_part", "_before")


def value_counts(df: DataFrame, value: str, *group: str) -> DataFrame:
    """(group, value, _rows, _less): how often each value that isn't null occurs in its group, and how many rows of it have a lesser one.

    Only distinct values are sorted, by ranges, and written once; a running sum in each range goes on from the ranges before.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_rows"))
    ranged = stored(counts.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()), "values")
    sizes = ranged.groupBy("_part").agg(F.sum("_rows").alias("_n"))  # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("_part").orderBy(*group, value).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.join(few(sizes.select("_part", before.alias("_before"))), "_part").withColumn("_less", F.col("_before") + F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    rows = rows.drop("_part", "_before")
    if not group:
        return rows
    first = rows.groupBy(*group).agg(F.min("_less").alias("_first"))
    return rows.join(few(first), list(group)).withColumn("_less", F.col("_less") - F.col("_first")).drop("_first")


def order_statistics(df: DataFrame, column: str, places: list[int]) -> dict[int, float]:
    """The values at places from 0 in the order of a column, which holds doubles without nulls.

    Histograms of BINS bins, each inside the bins that hold a place, until such a bin has one value: nothing is sorted or shuffled but
    counts.
    """
    v, half = F.col(column), lambda x: x / 2  # noqa: E731  halves, so that no difference is too large
    r = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    found: dict[int, float] = {}
    open_ = [(r["low"], r["high"], 0, sorted(set(places)))]
    while open_:
        cell = F.lit(None).cast("long")
        for i, (low, high, _, _) in enumerate(open_):
            width = half(high) - half(low)
            bin_ = F.floor((half(v) - half(F.lit(low))) / width * BINS) if 0 < width < float("inf") else F.when(v == low, 0).when(v == high, BINS - 1).otherwise(1)
            cell = F.when(v.between(low, high), F.lit(i * BINS) + F.least(F.greatest(bin_.cast("long"), F.lit(0)), F.lit(BINS - 1))).otherwise(cell)
        bins = df.select(cell.alias("cell"), column).filter("cell is not null").groupBy("cell").agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        next_ = []
        for i, (_, _, before, wanted) in enumerate(open_):
            for r in sorted((r for r in bins if r["cell"] // BINS == i), key=lambda r: r["cell"]):
                inside = [p for p in wanted if before <= p < before + r["n"]]
                if inside and r["low"] == r["high"]:
                    found |= dict.fromkeys(inside, r["low"])
                elif inside:
                    next_.append((r["low"], r["high"], before, inside))
                before += r["n"]
        open_ = next_
    return found


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles, linear between neighbours, of the values that are neither null nor NaN; nulls without any."""
    rows = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    rows = stored(rows, "values")
    n = rows.count()
    if not n:
        return [None] * len(shares)
    places = sorted({int(p) for x in shares for p in ((n - 1) * x, min((n - 1) * x + 1, n - 1))})
    at = order_statistics(rows, "v", places)
    found = []
    for x in shares:
        low = int((n - 1) * x)
        part, a = (n - 1) * x - low, at[low]
        found.append(a if part == 0 else a * (1 - part) + at[min(low + 1, n - 1)] * part)
    return found


def temporal_split(df: DataFrame, *order: str, train: float = 0.7, validate: float = 0.15, test: float = 0.15, gap: int = 0) -> DataFrame:
    """The rows with ``split``: train, validate, test in order, ``gap`` rows left out (null) between them."""
    if abs(train + validate + test - 1) > 0.01:
        raise ValueError("the fractions must add up to 1")
    n = df.count()
    a = int(n * train)
    b = a + gap
    c = b + int(n * validate)
    p = F.col("position")
    split = F.when(p < a, "train").when((p >= b) & (p < c), "validate").when(p >= c + gap, "test")
    return with_position(df, *order).withColumn("split", split)


def diversity(df: DataFrame, *, text: str, target: str) -> DataFrame:
    """One row: share of distinct texts, mean length, number of different words, and statistics of the target."""
    words = df.select(F.explode(F.split(F.lower(text), r"\s+")).alias("w")).filter("w <> ''").agg(F.count_distinct("w").alias("vocabulary"))
    rows = df.agg(
        F.round(F.count_distinct(text) / F.count("*"), 6).alias("distinct_share"),
        F.round(F.avg(F.length(text)), 4).alias("mean_length"),
        F.round(F.avg(target), 6).alias("mean_target"),
        F.round(F.stddev_samp(target), 6).alias("std_target"),
        *[F.lit(q).cast("double").alias(name) for q, name in zip(quantiles(df, target, (0.25, 0.5, 0.75)), ("q1", "median", "q3"), strict=True)],
    )
    return rows.crossJoin(words)  # one row each


def diversity_score(df: DataFrame, *, texts: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """The mean over columns of the share of distinct values (texts) or of the capped coefficient of variation (numbers)."""
    parts = [F.count_distinct(c) / F.count("*") for c in texts]
    parts += [F.coalesce(F.when(F.stddev_samp(c) > 0, F.least(F.try_divide(F.stddev_samp(c), F.avg(c)), F.lit(1.0))), F.lit(0.0)) for c in numbers]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.agg(F.round(total / len(parts), 6).alias("diversity"))


def completeness(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The share of cells that aren't null."""
    known = sum((F.count(c) for c in columns[1:]), F.count(columns[0]))
    return df.agg(F.round(F.coalesce(F.try_divide(known, F.count("*") * len(columns)), F.lit(0.0)), 6).alias("completeness"))


def consistency(one: DataFrame, two: DataFrame, key: str, *, texts: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """How well two runs agree: the share of equal texts and the absolute correlation of numbers, on average; 0 where the runs have different keys."""
    left = one.select(key, *[F.col(c).alias(f"{c}_1") for c in texts + numbers])
    right = two.select(key, *[F.col(c).alias(f"{c}_2") for c in texts + numbers])
    both = left.join(right, key, "full").withColumn("_ok", F.col(f"{(texts + numbers)[0]}_1").isNotNull() & F.col(f"{(texts + numbers)[0]}_2").isNotNull())
    parts = [F.avg((F.col(f"{c}_1") == F.col(f"{c}_2")).cast("int")) for c in texts] + [F.coalesce(F.abs(F.corr(f"{c}_1", f"{c}_2")), F.lit(0.0)) for c in numbers]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return both.agg(F.round(F.when(F.bool_and("_ok"), total / len(parts)).otherwise(0.0), 6).alias("consistency"))


def categorical_iv(df: DataFrame, feature: str, bad: Column) -> DataFrame:
    """The information value of a categorical feature for a yes-or-no target; cells without rows of both kinds add nothing."""
    cells = df.filter(F.col(feature).isNotNull()).groupBy(feature).agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"))
    totals = df.agg(F.count_if(~bad).alias("goods"), F.count_if(bad).alias("bads"))
    g, b = F.try_divide(F.col("good"), F.col("goods")), F.try_divide(F.col("bad"), F.col("bads"))
    value = F.when((F.col("good") > 0) & (F.col("bad") > 0), (g - b) * F.ln(F.try_divide(g, b)))
    return cells.crossJoin(F.broadcast(totals)).agg(F.round(F.coalesce(F.sum(value), F.lit(0.0)), 6).alias("information_value"))


def most_frequent(df: DataFrame, column: str) -> object:
    """The most frequent value, the least of equals."""
    rows = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1).collect()
    return rows[0][0] if rows else None


def code_correlation(df: DataFrame, feature: str, target: str) -> DataFrame:
    """The absolute correlation of a category's place among all categories in the order of their text with a number; 0 where there is none.

    Rows without a category have the place -1.
    """
    text = F.col(feature).cast("string")
    places = value_counts(df.select(text.alias("_text")).distinct(), "_text").select("_text", F.col("_less").alias("_code"))
    coded = df.select(text.alias("_text"), F.col(target).cast("double").alias("_target")).join(few(places), "_text", "left").withColumn("_code", F.coalesce("_code", F.lit(-1)))
    found = F.abs(F.corr(F.when(F.col("_target").isNotNull(), F.col("_code").cast("double")), F.col("_target")))
    return coded.agg(F.round(F.coalesce(F.nanvl(found, F.lit(0.0)), F.lit(0.0)), 6).alias("information_value"))


def information_value(df: DataFrame, feature: str, target: str, *, binned: bool = False) -> DataFrame:
    """The information value of a feature for a target of any kind; ``binned`` features are numbers, cut at their deciles.

    A target of two values is yes or no, the greater one counting as yes.  One of more values is its most frequent value or not.
    A number as target has no classes: the absolute correlation with the place of the category, or of the bin, stands for the value.
    """
    if binned:
        df, feature = quantile_bins(df, feature, out="_bin"), "_bin"
    if dict(df.dtypes)[target] in ("double", "float", "int", "bigint", "smallint", "tinyint") or dict(df.dtypes)[target].startswith("decimal"):
        return code_correlation(df.withColumn("_place", F.lpad(F.col(feature).cast("string"), 3, "0")) if binned else df, "_place" if binned else feature, target)
    values = [r[0] for r in df.filter(F.col(target).isNotNull()).select(target).distinct().orderBy(target).limit(3).collect()]
    bad = most_frequent(df, target) if len(values) > 2 else values[-1] if values else None
    return categorical_iv(df, feature, F.coalesce(F.col(target) == F.lit(bad), F.lit(False)))


def quantile_bins(df: DataFrame, feature: str, *, bins: int = 10, out: str = "bin") -> DataFrame:
    """The rows with the number of their quantile bin; bins are closed on the right and equal edges are one."""
    edges = sorted({q for q in quantiles(df, feature, tuple(i / bins for i in range(1, bins))) if q is not None})
    return df.withColumn(out, F.when(F.col(feature).isNotNull(), F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e < F.col(feature)))))


def numeric_iv(df: DataFrame, feature: str, bad: Column) -> DataFrame:
    return categorical_iv(quantile_bins(df, feature), "bin", bad)


def schema_compliance(df: DataFrame, rules: dict[str, Column], *, least: float = 0.95) -> DataFrame:
    """(field, compliance, ok): the share of rows that meet each rule; null does not."""
    rows = df.agg(*[F.round(F.avg(F.coalesce(rule, F.lit(False)).cast("int")), 6).alias(name) for name, rule in rules.items()])
    long = rows.select(F.expr("stack({}, {}) as (field, compliance)".format(len(rules), ", ".join(f"'{n}', `{n}`" for n in rules))))
    return long.withColumn("ok", F.col("compliance") >= least)


def hallucination(entities: tuple[Column, ...], phrases: Column, text: Column) -> Column:
    """0.1 for each entity that the lower-cased text lacks and 0.2 times the share of phrases that it lacks, 1 at most."""
    low = F.lower(text)
    missing = lambda c: F.size(F.filter(c, lambda x: ~F.contains(low, F.lower(x))))
    score = F.coalesce(F.try_divide(missing(phrases), F.size(phrases)), F.lit(0.0)) * 0.2
    for c in entities:
        score = score + missing(c) * 0.1
    return F.least(score, F.lit(1.0))


def confidence(base: Column, populated: tuple[Column, ...]) -> Column:
    """The base (0.5 where unknown) plus 0.3 times the share of key fields that are filled, 1 at most."""
    filled = sum((p.cast("int") for p in populated[1:]), populated[0].cast("int"))
    return F.least(F.coalesce(base, F.lit(0.5)) + filled / len(populated) * 0.3, F.lit(1.0))


def below_quantile(df: DataFrame, column: str, q: float = 0.25) -> DataFrame:
    """The rows under a quantile of a column."""
    return df.filter(F.col(column) < F.lit(quantiles(df, column, (q,))[0]).cast("double"))


def batch_verdict(df: DataFrame, *, suspicious: Column, low: Column, compliant: Column) -> DataFrame:
    """One row: counts and the verdict accept, review or reject."""
    rows = df.agg(F.count("*").alias("rows"), F.count_if(suspicious).alias("suspicious"), F.count_if(low).alias("low_confidence"), F.round(F.avg(compliant.cast("int")), 6).alias("compliance"))
    share = F.try_divide(F.col("suspicious"), F.col("rows"))
    return rows.withColumn("verdict", F.when((F.col("compliance") >= 0.95) & (share < 0.1), "accept").when((F.col("compliance") >= 0.8) & (share < 0.3), "review").otherwise("reject"))


def disagreements(one: DataFrame, two: DataFrame, key: str, fields: tuple[str, ...], *, more_than: int = 1) -> DataFrame:
    """(key, differing) for rows in which more than so many fields differ; null differs from everything."""
    left, right = one.select(key, *[F.col(c).alias(f"{c}_1") for c in fields]), two.select(key, *[F.col(c).alias(f"{c}_2") for c in fields])
    differ = [F.coalesce(F.col(f"{c}_1") != F.col(f"{c}_2"), F.lit(True)).cast("int") for c in fields]
    total = sum(differ[1:], differ[0])
    return left.join(right, key).select(key, total.alias("differing")).filter(F.col("differing") > more_than)


def agreement(one: DataFrame, two: DataFrame, key: str, *, texts: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """(field, agreement): by field the share of equal texts, or the absolute correlation of numbers, of two runs; null differs from everything."""
    left = one.select(key, *[F.col(c).alias(f"{c}_1") for c in texts + numbers])
    right = two.select(key, *[F.col(c).alias(f"{c}_2") for c in texts + numbers])
    parts = [F.avg(F.coalesce(F.col(f"{c}_1") == F.col(f"{c}_2"), F.lit(False)).cast("int")) for c in texts]
    parts += [F.coalesce(F.nanvl(F.abs(F.corr(f"{c}_1", f"{c}_2")), F.lit(0.0)), F.lit(0.0)) for c in numbers]
    rows = left.join(right, key).agg(F.array(*[F.struct(F.lit(c).alias("field"), F.round(p, 6).alias("agreement")) for c, p in zip(texts + numbers, parts, strict=True)]).alias("f"))
    return rows.select(F.inline("f"))


def review_set(*frames: DataFrame) -> DataFrame:
    """The distinct ids of all frames."""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def consensus(runs: DataFrame, key: str, *, order: str, texts: tuple[str, ...] = (), numbers: tuple[str, ...] = (), lists: tuple[str, ...] = (), maps: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: the most frequent text (the least of equals), the mean number, the union of lists, and maps
    merged in the order of the runs, a later run's value taking the place of an earlier one's.

    What lists and maps hold is made distinct before it is collected.
    """
    grouped = [F.mode(c, True).alias(c) for c in texts] + [F.round(F.avg(c), 6).alias(c) for c in numbers]
    out = runs.groupBy(key).agg(*grouped, F.count("*").alias("runs"))
    for c in lists:
        items = runs.select(F.col(key), F.explode(c).alias("_item")).distinct().groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list("_item")).alias(c))
        none = F.array().cast(dict(runs.dtypes)[c])
        out = out.join(items, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn(c, F.coalesce(c, none))
    for c in maps:
        items = runs.select(F.col(key), F.col(order).alias("_order"), F.explode(c).alias("_name", "_value")).groupBy(key, "_name").agg(F.max_by("_value", "_order").alias("_value"))
        items = items.groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_value")))).alias(c))
        out = out.join(items, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn(c, F.coalesce(c, F.create_map().cast(dict(runs.dtypes)[c])))
    return out


def first_run(runs: DataFrame, key: str, order: Column) -> DataFrame:
    """Whole rows: the first by an order for each document, such as the run number or the negative confidence."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return runs.withColumn("_place", place).filter("_place = 1").drop("_place")

"""Mutual information of a number and a label by nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.articles import few, stored
from .quality import with_position

#: Different values that one task looks at in order.
IN_BLOCK = 100_000


def digamma(n: Column) -> Column:
    """Of a whole number from 1 on, to about eleven digits."""
    z = n + 6
    series = F.ln(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    return series - sum((1 / (n + i) for i in range(1, 6)), 1 / n)


def _with_distance(counts: DataFrame, k: int) -> DataFrame:
    """(label, value, n, k, d): the distance from a value to the k-th nearest other row of its label.

    Different values lie in order of label and value; blocks of them get the k last values of the block before and the k first
    of the one behind, and a row finds its neighbours in its block.
    """
    placed = with_position(counts, "label", "value", out="_at").withColumn("_block", F.floor(F.col("_at") / IN_BLOCK))
    inside = F.pmod("_at", F.lit(IN_BLOCK))
    blocks = F.array_compact(F.array(F.lit(0), F.when(inside < k, -1), F.when(inside >= IN_BLOCK - k, 1)))
    placed = placed.withColumn("_shift", F.explode(blocks)).withColumn("_block", F.col("_block") + F.col("_shift"))
    order = Window.partitionBy("_block").orderBy("_at")
    other = F.struct("label", "value", "n")
    near = F.concat(F.collect_list(other).over(order.rowsBetween(-k, -1)), F.collect_list(other).over(order.rowsBetween(1, k)))
    rows = placed.withColumn("_near", near).filter("_shift = 0")
    own = F.transform(F.filter("_near", lambda x: x["label"] == F.col("label")), lambda x: F.struct(F.abs(x["value"] - F.col("value")).alias("d"), x["n"].alias("n")))
    start = F.struct((F.col("n") - 1).alias("seen"), F.when(F.col("n") > F.col("k"), 0.0).cast("double").alias("d"))
    found = F.aggregate(F.array_sort(own), start, lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["d"], F.when(s["seen"] + x["n"] >= F.col("k"), x["d"])).alias("d")))
    return rows.select("label", "value", "n", "size", "k", found["d"].alias("d"))


def _with_neighbours(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Adds m: how many rows, of any label, lie nearer than d, or at the value itself where d is 0.

    values (value, n).  The ends of all intervals lie among the values in ranges of one order.  Each end finds the value before and the one
    behind it, over the edges of ranges by one row for each range, and takes that one which its distance says.
    """
    ends = F.when(F.col("d") > 0, F.array(F.struct(F.lit(False).alias("upper"), (F.col("value") - F.col("d")).alias("at")), F.struct(F.lit(True).alias("upper"), (F.col("value") + F.col("d")).alias("at"))))
    ends = F.coalesce(ends, F.array(F.struct(F.lit(False).alias("upper"), F.col("value").alias("at")), F.struct(F.lit(True).alias("upper"), F.col("value").alias("at"))))
    asked = rows.select("label", "value", "d", F.explode(ends).alias("e")).select(F.col("e.at").alias("at"), "label", "value", "d", F.col("e.upper").alias("upper"), F.lit(None).cast("long").alias("n"))
    table = values.select(F.col("value").alias("at"), F.lit(None).cast(dict(rows.dtypes)["label"]).alias("label"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("boolean").alias("upper"), "n")
    ranged = stored(asked.unionByName(table).repartitionByRange("at").withColumn("_part", F.spark_partition_id()), "ends")
    parts = ranged.groupBy("_part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n"), F.max(F.when(F.col("n").isNotNull(), F.struct("at", "n"))).alias("_last"), F.min(F.when(F.col("n").isNotNull(), F.struct("at", "n"))).alias("_first"))
    before, behind = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)  # one row for each range
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_sum"), F.last("_last", ignorenulls=True).over(before).alias("_left"), F.first("_first", ignorenulls=True).over(behind).alias("_right"))
    order = Window.partitionBy("_part").orderBy("at", F.col("n").isNull())  # a value stands before the ends at it
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_part").orderBy(F.desc("at"), F.col("n").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)  # backwards, as a frame to the end is read anew for each row
    one = F.when(F.col("n").isNotNull(), F.struct("at", "n"))
    found = ranged.join(few(parts), "_part").select(
        "label", "value", "d", "upper", "n",
        (F.col("_sum") + F.coalesce(F.sum("n").over(up), F.lit(0))).alias("_until"),
        F.coalesce(F.last(one, ignorenulls=True).over(up), F.col("_left")).alias("_before"),
        F.coalesce(F.last(one, ignorenulls=True).over(down), F.col("_right")).alias("_behind"),
    ).filter("n is null")
    inside = lambda x: F.coalesce(F.abs(x["at"] - F.col("value")) < F.col("d"), F.lit(False)) | F.coalesce(x["at"] == F.col("value"), F.lit(False))
    before_n, behind_n = F.coalesce(F.col("_before.n"), F.lit(0)), F.coalesce(F.col("_behind.n"), F.lit(0))
    # rows up to the upper end that are inside, and rows up to the lower end that are outside
    upper = F.when(inside(F.col("_behind")), F.col("_until") + behind_n).when(inside(F.col("_before")), F.col("_until")).otherwise(F.col("_until") - before_n)
    lower = F.when(inside(F.col("_before")), F.col("_until") - before_n).when(F.col("_behind").isNotNull() & ~inside(F.col("_behind")), F.col("_until") + behind_n).otherwise(F.col("_until"))
    counts = found.groupBy("label", "value").agg((F.sum(F.when(F.col("upper"), upper)) - F.sum(F.when(~F.col("upper"), lower))).alias("m"))
    return rows.join(counts, ["label", "value"])


def nearest_information(df: DataFrame, value: str, label: str, *, k: int = 3) -> float:
    """The mutual information of a number and a label, from the distances to the k-th nearest rows of the same label; 0 at least.

    Rows without a number or label, and labels of one row, are left out.  Equal numbers are at distance 0, and a row whose k-th neighbour is there
    counts the rows of its number.  Equal rows are looked at once.
    """
    rows = df.select(F.col(label).alias("label"), F.col(value).cast("double").alias("value")).filter("label is not null and value is not null and not isnan(value)")
    counts = stored(rows.groupBy("label", "value").agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy("label").agg(F.sum("n").alias("size")).filter("size > 1")
    counts = counts.join(few(sizes), "label").withColumn("k", F.least(F.col("size") - 1, F.lit(k)))
    spaced = stored(_with_distance(counts, k), "distances")
    found = _with_neighbours(spaced, spaced.groupBy("value").agg(F.sum("n").alias("n")))
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    r = found.agg(F.sum("n").alias("n"), (digamma(F.sum("n")) + mean(digamma(F.col("k"))) - mean(digamma(F.col("size"))) - mean(digamma(F.col("m")))).alias("v")).first()
    return max(0.0, r["v"]) if r["n"] else 0.0

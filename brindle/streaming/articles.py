"""Incremental forms: seen keys, monthly buckets, rolling reruns and the interval join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, *, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


#: Keeps keyed state on disk, so that it may outgrow the executors' memory.
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_keys(rows: DataFrame, key: str, *, known: DataFrame | None = None) -> DataFrame:
    """A row of each key that neither came before, however long ago and across restarts, nor is in the table ``known``.

    Keys stay in the state for good; it is kept on disk.  Rows with an empty key, or none, are left out.  ``known`` is what was stored
    before the stream began: it is only read, and a key that it has needs no state.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ON_DISK)
    rows = rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
    if known is not None:
        rows = rows.join(known.select(key), key, "left_anti")
    return rows.dropDuplicates([key])


def new_keys_within(rows: DataFrame, key: str, time: str, *, late: str = "90 days") -> DataFrame:
    """The first row of each key within the watermark: less state, but a key comes again after it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def monthly_counts(rows: DataFrame, time: str, *, late: str = "40 days") -> DataFrame:
    """(day, n, total) of tumbling days, from which months are summed; late rows open their day again within the watermark."""
    days = rows.withWatermark(time, late).groupBy(F.window(time, "1 day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return days.select(F.col("window.start").cast("date").alias("day"), "n", "total")


def by_month(days: DataFrame) -> DataFrame:
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


def interval_join(left: DataFrame, right: DataFrame, key: str, *, days: int, late: str = "1 day") -> DataFrame:
    """Pairs of a key whose left time is in the days before the right time; state is bounded by both watermarks."""
    a = left.select(F.col(key), F.col("id").alias("left_id"), F.col("ts").alias("left_ts")).withWatermark("left_ts", late)
    b = right.select(F.col(key).alias("_key"), F.col("id").alias("right_id"), F.col("ts").alias("right_ts")).withWatermark("right_ts", late)
    within = (F.col("left_ts") >= F.col("right_ts") - F.make_dt_interval(F.lit(days))) & (F.col("left_ts") <= F.col("right_ts"))
    return a.join(b, (F.col(key) == F.col("_key")) & within).select(key, "left_id", "right_id")


def drained(rows: DataFrame, path: str, *, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there (trigger available now) and gives the table that it wrote; a rerun continues from its checkpoint."""
    spark = rows.sparkSession
    if mode == "append":
        q = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    else:  # each batch replaces the rows of its keys: the latest is the one of the greatest batch
        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")

        q = rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the last batch for each key, of a table that ``drained`` wrote in update mode."""
    fields = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(*keys, "r.*")

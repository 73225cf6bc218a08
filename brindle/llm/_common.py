"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ship

#: Largest table, in rows of two numbers each (16 MB), that is sent to every executor; beyond it a join shuffles.
BROADCAST_ROWS = 1_000_000

#: Bytes in a range of rows that are sorted, about.
RANGE_BYTES = 256 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lets a batch of rows on its way to Python be of some megabytes at most, since texts may be long, and sends this package to the workers.

    The settings are the session's; smaller ones are left as they are.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = str(spark.conf.get(key)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine has a temporary folder; any other is refused.
    """
    bounded_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = context._brindle_folder = getattr(context, "_brindle_folder", None) or "file://" + tempfile.mkdtemp(prefix="brindle-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The frame, written once to the shared folder and read again: cuts lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, of a few numbers a row, marked for a broadcast if it has ``most`` rows at most; to be read from a written table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def keyed(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """The frame with a number that no two rows share, and the name of that column.

    A row whose id is its own has that id.  Rows that share an id or have none get numbers below all ids, by the order of
    their hashed contents: the same rows get the same numbers on every cluster, and rows that are equal in all columns are
    interchangeable.  Only these rows are written.
    """
    key, id_ = free_name(df, "_row"), column(df, id_col).cast("long")
    ids = df.select(id_.alias("_id"))
    shared = written(ids.filter("_id is not null").groupBy("_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("_id").alias("_shared")), "shared-ids")
    none, some = ids.filter("_id is null").limit(1).count() > 0, shared.limit(1).count() > 0
    if not none and not some:
        return df.withColumn(key, id_), key
    own, rows = df.filter(id_.isNotNull()), []
    if some:
        twice = few(shared)
        rows.append(own.join(twice, id_ == F.col("_shared"), "left_semi"))
        own = own.join(twice, id_ == F.col("_shared"), "left_anti")
    if none:
        rows.append(df.filter(id_.isNull()))
    least = ids.agg(F.least(F.min("_id"), F.lit(0))).first()[0] or 0
    odd = rows[0] if len(rows) == 1 else rows[0].union(rows[1])
    return own.withColumn(key, id_).union(_numbered(odd, key, least - 1)), key


def _numbered(df: DataFrame, key: str, first: int) -> DataFrame:
    """The frame, written, with numbers from ``first`` downwards in the order of the rows' hashed contents.

    Rows are dealt by range, equal ones over several ranges; each range goes on from those before it.
    """
    content = F.to_json(F.struct(*[column(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)]))
    part, tie, *hashes = (free_name(df, c) for c in ("_part", "_tie", "_first", "_second"))
    rows = df.withColumn(hashes[0], F.xxhash64(content)).withColumn(hashes[1], F.xxhash64(F.lit(1), content)).withColumn(tie, F.xxhash64(F.monotonically_increasing_id()))
    rows = written(rows.repartitionByRange(*hashes, tie).withColumn(part, F.spark_partition_id()), "odd-rows")
    base = free_name(rows, "_base")
    rows = with_base(rows, part, F.lit(1), base)
    place = F.row_number().over(Window.partitionBy(part).orderBy(*hashes, tie)) + F.col(base)
    return rows.withColumn(key, F.lit(first + 1) - place).select(*[column(rows, c) for c in df.columns], key)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges_for(rows: DataFrame, size: Column) -> int:
    """How many ranges rows are dealt over: the session's shuffle partitions, and more where a range would pass RANGE_BYTES of ``size``."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return max(partitions(rows.sparkSession), -(-int(total) // RANGE_BYTES))


def with_base(rows: DataFrame, part: str, n: Column, base: str) -> DataFrame:
    """Adds to each row the number of units in all parts before its own: the second pass of a prefix sum.

    There is one total for each part, that is for each task that wrote, so the ordered window and the table that is
    joined stay small; the table is broadcast only up to BROADCAST_ROWS.
    """
    totals = written(rows.groupBy(part).agg(F.sum(n).alias("_n")), "totals")
    order = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(part, F.coalesce(F.sum("_n").over(order), F.lit(0)).cast("long").alias(base))
    return rows.join(F.broadcast(bases) if totals.count() <= BROADCAST_ROWS else bases, part)


def named(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns that the operator reads, so that further ones, whatever their names, are never in the way."""
    return df.select(*[column(df, c) for c in columns])


def column(df: DataFrame, name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def free_name(df: DataFrame, name: str) -> str:
    """The name, behind as many underscores as it takes to be no column of the frame."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def under_plain_names(df: DataFrame) -> DataFrame:
    """The frame with columns c0, c1, …, for functions that don't take names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def wider(df: DataFrame, **more: str) -> T.StructType:
    """The frame's schema with further columns."""
    return T.StructType([*df.schema.fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in more.items()]])

"""Token counts of documents in flat token files that have no index: a separator scan.

A flat file is ids and nothing else; a document ends with the separator id.  The files are dealt to tasks by ranges of
bytes, so that a file of any size is read by many of them.  Each range, a block, is searched at once for the separator,
and gives its number of ids and the places of its separators.  A prefix scan over the blocks of a file adds what lies
before, and the last separator before a block stitches the document that runs over its edge.  Only these summaries are
shuffled, never ids.

Flat files are written and read by ranges through Arrow's file systems, as Spark has no sink for raw bytes and its
binary source takes a file as one row; the folder must be one that Arrow and Spark both reach.  A task names its file by
its attempt, and only the attempts whose rows Spark has committed count, so that a task may be run again.

Cases: an empty document has 0 tokens, and so has a null text; ids after a file's last separator are a document that isn't
terminated (``ended`` false); a document may cover many whole blocks; an empty file gives nothing, and no rows give no
rows; rows that share a doc_id, or have none, are counted one by one; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import few, named, partitions, shared_path, with_base, written
from ._tokens import default_tokenizer, encoded, encoder

#: Ids in a block.
BLOCK = 1 << 18
#: The end-of-document id of the public byte-level vocabulary.
END_OF_TEXT = 50256


#: Names of stores in Spark's paths that Arrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, and the path in it; a mounted store ("dbfs:/...") is a folder of that name at the root."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}" if colon else path)


def flat_files(docs: DataFrame, path: str, *, tokenizer: str | None = None, separator: int = END_OF_TEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes one flat file for each scanned partition into the folder ``path``; returns the plain list of their documents.

    The list, (file, first, doc_ids), names the documents in the order in which they were written and knows nothing of
    where they lie; its files are those that count.
    """
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first, out = TaskContext.get(), 0, None
        store, folder = _store(path)
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        for batch in batches:
            for at, ids, offsets in encoded(batch.column(1), tokenizer, separator):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}")
                out.write(np.ascontiguousarray(ids))
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0).slice(at, n).cast(pa.int64()))], ["file", "first", "doc_ids"])
                first += n
        if out is not None:
            out.close()  # before the task is done

    rows = named(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col))
    return written(rows.mapInArrow(run, "file string, first long, doc_ids array<long>"), "flat-names")


def read_flat_files(spark: SparkSession, path: str, *, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, ids): the blocks of the raw token files of ``width`` bytes an id in a folder; one task reads a few ranges of a file."""
    size = block * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        for batch in batches:
            for name, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{folder}/{name}") as f:
                    content = f.read_at(size, k * size)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k]), pa.array([content[: len(content) // width * width]], pa.binary())], ["file", "block", "ids"])

    files = spark.read.format("binaryFile").load(path)  # names and lengths; no content is read
    blocks = files.filter("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / size) - 1)).alias("block"))
    dealt = blocks.repartition(max(partitions(spark), 1), "file", "block")
    return dealt.select("file", F.col("block").cast("long")).mapInArrow(run, "file string, block long, ids binary")


def count_tokens(blocks: DataFrame, *, separator: int = END_OF_TEXT, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, local_start, n_tokens, ended) of every document in the files; the separator isn't counted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, places = [], []
            for x in batch.column(2):
                ids = np.frombuffer(x.as_buffer(), dtype)
                n.append(len(ids))
                places.append(np.flatnonzero(ids == separator))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int64()))], ["file", "block", "n_ids", "places"])

    kind = blocks.schema["file"].dataType.simpleString()
    found = written(blocks.select("file", "block", "ids").mapInArrow(scan, f"file {kind}, block long, n_ids long, places array<long>"), "separators")
    return _stitched(found)


def _stitched(found: DataFrame) -> DataFrame:
    """The documents from (file, block, n_ids, places), the summaries of all blocks.

    The prefix scan sees a few numbers of each block; the places are joined to its result.
    """
    by_block = Window.partitionBy("file").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    n_ends = F.size("places").alias("n_ends")
    scan = found.select("file", "block", "n_ids", n_ends, F.when(F.size("places") > 0, F.element_at("places", -1)).alias("last"))
    scan = scan.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    scan = scan.select(
        "file",
        "block",
        "base",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ordinal"),
        F.coalesce(F.last(F.col("base") + F.col("last"), ignorenulls=True).over(before), F.lit(-1)).alias("last_end"),
        F.lead("block").over(by_block).isNull().alias("final"),
    )
    scan = written(scan, "scan")
    joined = found.join(few(scan), ["file", "block"])
    ends = F.transform("places", lambda p: p + F.col("base"))
    # the starts of the documents that end in the block, and of what is left at the end of the file
    joined = joined.select("file", "ordinal", "last_end", F.size("places").alias("n_ended"), ends.alias("ends"), "final", (F.col("base") + F.col("n_ids")).alias("stop"))
    last = F.when(F.col("n_ended") > 0, F.element_at("ends", -1)).otherwise(F.col("last_end"))
    rest = F.col("final") & (last < F.col("stop") - 1)
    joined = joined.withColumn("ends", F.when(rest, F.concat("ends", F.array("stop"))).otherwise(F.col("ends")))
    docs = joined.select("file", "ordinal", "last_end", "ends", "n_ended", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("last_end")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    return docs.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("local_start"), (F.col("end") - start).alias("n_tokens"), (F.col("k") < F.col("n_ended")).alias("ended"))


def document_tokens(docs: DataFrame, *, tokenizer: str | None = None, separator: int = END_OF_TEXT, block: int = BLOCK) -> DataFrame:
    """(doc_id, start, n_tokens): writes the documents to flat files and counts them there; ``start`` is over all files."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    dtype = encoder(tokenizer).dtype
    path = shared_path(spark, "flat-tokens")
    names = flat_files(docs, path, tokenizer=tokenizer, separator=separator)
    files = names.select("file").distinct()
    if not files.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long")
    blocks = read_flat_files(spark, path, width=dtype.itemsize, block=block).join(F.broadcast(files), "file", "left_semi")  # one row for each task that wrote
    counted = written(count_tokens(blocks, separator=separator, dtype=dtype.str), "counted")
    sizes = written(counted.groupBy("file").agg((F.sum("n_tokens") + F.count("*")).alias("n_all")), "file-sizes")
    placed = with_base(sizes, "file", F.col("n_all"), "base").select("file", "base")
    listed = names.select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    out = counted.join(listed, ["file", "ordinal"]).join(few(placed), "file")
    return out.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")

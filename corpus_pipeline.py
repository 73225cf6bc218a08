"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; between stages the documents are written as Parquet and read
again.  All but the last return the columns of ``documents``, whatever further ones there are and whatever their names.

In every stage a row is judged for itself: rows that share a doc_id, or have none, are different documents with their own
text, and equal rows are equal documents; a very long text is read whole; a null text counts as an empty one; no documents
give no rows, and without labels of both kinds the first two stages drop nothing but texts without words to judge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import mixing, near_dedup, packing, quality, toxicity
from brindle.llm._common import read, shared_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that importance resampling against the labelled good ones does not draw.

    A null or empty text is never drawn; documents whose keys tie at the last place all stay; null labels are not used.
    """
    return quality.resampled(docs, read(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose toxicity is above the threshold of their language.

    A null language, and one with few labels, has the threshold of all; a null or empty text is judged as one without words.
    """
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five words a shingle, a similarity of 0.8 or more.

    It is the one with the least doc_id; a row without one stays only if none of its group has one.  A text of fewer words
    is one shingle; texts without words are like nothing and all stay.
    """
    return near_dedup.deduplicated(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents up to the sources' targets; one that is taken twice stands there twice.

    A null source is a source, the last in order; a document without words is taken no time, as its source's words are all it counts for.
    """
    return mixing.mixed(docs, weights=(5, 2, 1), share=1.5, epochs=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs, length=1024, end_id=0)


STAGES = [("quality", good), ("toxicity", clean), ("near_duplicates", unlike), ("mixing", mixed), ("packing", packed)]

#: Classifiers and tokenizers can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, mixing, near_dedup, neighbours, packing, quality, token_counts, token_files, toxicity, url_filter, vector_codes, vector_files, whitening
from ._common import read, shared_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(read(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.repetitions(read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, epochs=2.0).drop("times", "key")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), length=1024, end_id=0)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_token_files(read(spark, sf_dir, "documents"), path, end_id=2)
    return token_files.documents_of(token_files.read_token_files(spark, path)).drop("shard")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), rules=url_filter.RULES)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampling(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("key", "row")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), cut=0.7)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=32)


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_files.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_fingerprints, op3_mixing, op4_packing, op5_token_files, op6_url_filter, op7_neighbours, op8_quality, op9_toxicity, op10_near_dedup, op11_vector_codes, op12_whitening, op13_exact_search)}

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.ORACLE_SQL, "op10_near_dedup": near_dedup.ORACLE_SQL, "op11_vector_codes": vector_codes.ORACLE_SQL, "op13_exact_search": vector_files.ORACLE_SQL}

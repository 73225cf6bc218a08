"""The registered queries and the pipeline on the smallest tables."""

import pytest

from brindle.llm import queries


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op7_neighbours", "op12_whitening", "op13_exact_search")])
def test_one_row_or_more_for_each_input(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir)
    table = {"op6": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert rows.count() == n or name == "op4_packing" and rows.select("doc_id").distinct().count() == n


def test_neighbours_query(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = queries.QUERIES["op7_neighbours"](spark, sf_dir)
    assert rows.count() == v.filter("vec_id % 20 = 0").count() * min(20, v.count() - 1)


def test_vector_queries(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert queries.QUERIES["op12_whitening"](spark, sf_dir).count() == v.count() * 32
    assert queries.QUERIES["op13_exact_search"](spark, sf_dir).count() == v.filter("vec_id % 50 = 0").count() * 5


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"file://{tmp_path}/{name}")
        out = spark.read.parquet(f"file://{tmp_path}/{name}")
        if k < 3:
            assert 0 < out.count() <= docs.count()
        docs = out if k < 4 else docs
    assert out.select("doc_id").distinct().count() == docs.filter("doc_id is not null").select("doc_id").distinct().count() <= n


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    from tests.compare import connect, rows_of, rows_of_sql

    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), queries.ORACLE_SQL[name])

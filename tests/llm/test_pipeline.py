"""The pipeline's stages: each held against a plain version on its own input, and on odd and empty tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import mixing, quality, toxicity

from .test_texts import brute_components, labelled
from .test_tokens import crc, plain  # noqa: F401


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage had and what it returned, as pandas frames and as folders."""
    folder = tmp_path_factory.mktemp("stages")
    at = {"documents": f"{sf_dir}/documents.parquet"}
    for (name, stage), before in zip(corpus_pipeline.STAGES, ["documents", *[n for n, _ in corpus_pipeline.STAGES]], strict=False):
        at[name] = f"file://{folder}/{name}"
        stage(spark, spark.read.parquet(at[before]), sf_dir).write.parquet(at[name])
    return at, {k: spark.read.parquet(v).toPandas() for k, v in at.items()}


def test_quality_drops_what_is_not_drawn(spark, sf_dir, stages):
    at, rows = stages
    docs, labels = spark.read.parquet(at["documents"]), spark.read.parquet(f"{sf_dir}/labels.parquet")
    drawn = {r.doc_id for r in quality.resampling(docs, labels).filter("kept").collect()}
    assert sorted(rows["quality"].doc_id) == sorted(drawn)
    good = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    assert np.mean([(x in drawn) == bool(y) for x, y in good.items()]) > 0.9


def test_toxicity_drops_what_is_over_the_threshold(spark, sf_dir, stages):
    """Every text is scored alone here, without batches and chunks."""
    at, rows = stages
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net, cuts = toxicity.fit(spark.read.parquet(at["quality"]), labels, lang_col="lang")
    low = []
    for r in rows["quality"].itertuples():
        slots, ends = toxicity.term_slots(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))
        if toxicity.probability(net, toxicity.scores(net, slots, ends))[0] < cuts.get(r.lang, cuts[None]):
            low.append(r.doc_id)
    assert sorted(rows["toxicity"].doc_id) == sorted(low)


def test_near_duplicates_as_brute_force(stages):
    texts = dict(zip(stages[1]["toxicity"].doc_id, stages[1]["toxicity"].text, strict=True))
    label, _ = brute_components(texts, 5, 80)
    assert sorted(stages[1]["near_duplicates"].doc_id) == sorted(i for i in texts if label[i] == i)


def test_mixing_as_its_sql(stages):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{stages[0]['near_duplicates'].removeprefix('file://')}/*.parquet')")
    times = {i: taken // size for i, size, taken in c.execute(f"select doc_id, size, taken from ({mixing.ORACLE_SQL})").fetchall() if taken}
    assert Counter(stages[1]["mixing"].doc_id) == times


def test_packing_as_plain_encoding(stages, plain):  # noqa: F811
    docs, pieces = stages[1]["mixing"], stages[1]["packing"]
    texts, copies = dict(zip(docs.doc_id, docs.text, strict=True)), Counter(docs.doc_id)
    at = pieces.sort_values(["sequence_id", "offset"])
    for s, own in at.groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
        assert own.length.sum() == 1024 or s == at.sequence_id.max() and own.length.sum() < 1024
    for i, own in pieces.groupby("doc_id"):
        ids = plain(texts[i]) + [0]
        assert own.length.sum() == copies[i] * len(ids)
        assert all(p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for p in own.itertuples())
    assert set(pieces.doc_id) == set(docs.doc_id)


def test_run_gives_the_pieces_of_the_same_documents(spark, sf_dir, stages):
    def tokens(pieces):
        return pieces.groupby("doc_id").length.sum().to_dict()

    assert tokens(corpus_pipeline.run(spark, sf_dir).toPandas()) == tokens(stages[1]["packing"])


def folder_of(docs, labels, path):
    docs.write.parquet(f"file://{path}/documents.parquet")
    labels.write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


@pytest.mark.parametrize("some", [True, False])
def test_stages_on_odd_and_on_no_rows(spark, odd_docs, tmp_path, some):
    """Null and repeated ids and rows, texts null, empty and long, clashing names; labels of both kinds, or none."""
    rows, labels = labelled(spark, 120)
    if not some:
        labels = labels.limit(0)
    more = rows.select(F.col("source"), "text", F.col("lang"), (F.col("doc_id") + 100).alias("doc_id")).unionByName(odd_docs.select("source", "text", "lang", "doc_id"))
    none = more.withColumn("doc_id", F.lit(None).cast("long"))
    docs = more.union(more.filter("doc_id % 2 = 0")).union(none).withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    for name in ("_row", "_gone", "_copy", "a.b", "weight", "score", "part"):
        docs = docs.withColumn(name, F.lit("x"))
    for k, start in enumerate((docs, docs.limit(0))):
        sf = folder_of(start, labels.withColumn("doc_id", F.col("doc_id") + 100), tmp_path / str(k))
        now = spark.read.parquet(f"{sf}/documents.parquet")
        names = now.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf)
            assert out.columns == names
            out.write.parquet(f"{sf}/{name}")
            before, now = now, spark.read.parquet(f"{sf}/{name}")
            if k:
                assert now.count() == 0
            elif name == "quality":
                assert not now.filter("coalesce(text, '') = ''").count()
                assert now.filter("doc_id is null").count() and (some or now.count() == before.filter("text <> ''").count())
            elif name == "near_duplicates":
                texts = [r.text for r in now.collect() if r.text.strip()]  # those without words all stay
                assert 0 < len(texts) == len(set(texts))
                if not some:  # nothing went before but empty texts
                    assert now.filter(F.col("doc_id").isNull() & F.col("text").rlike(r"\S")).count() == 0
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert pieces.filter("start = 0").count() == now.count()


def test_learning_from_a_labelled_id_that_many_rows_share(spark):
    docs, labels = labelled(spark, 200)
    one = docs.filter("doc_id = 0")
    many = docs.union(one.crossJoin(spark.range(500)).drop("id"))
    for y, f in (("quality", lambda d: quality.model(d, labels)[0]), ("toxic", lambda d: toxicity.fit(d, labels)[0].out)):
        a, b = f(docs), f(many)
        assert y == "quality" or np.array_equal(a, b)
    assert quality.resampled(many, labels).filter("doc_id = 0").count() == 0

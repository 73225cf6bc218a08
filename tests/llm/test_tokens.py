"""Operators that write ids: against plain encoding with the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import packing, token_counts, token_files
from brindle.llm._tokens import SegmentEncoder, default_tokenizer

from .conftest import TEXTS


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return SegmentEncoder(default_tokenizer())


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("ab ,.'\n\t\u00a0\u2003sS1!", max_size=40))
def test_segments_encode_as_the_whole(text):
    own = _encoder()
    assert own.encode(pa.array([text]))[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def _encoder(kept=[]):  # noqa: B006  one for all examples
    if not kept:
        kept.append(SegmentEncoder(default_tokenizer()))
    return kept[0]


def test_odd_texts(encoder, plain):
    for _ in range(2):  # the second time from what is kept
        ids, offsets = encoder.encode(pa.array(TEXTS))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [plain(t) for t in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(odd_docs, plain):
    pieces = packing.pack(odd_docs, length=64, end_id=0, keep_ids=True).toPandas().sort_values(["doc_id", "start"])
    for i, t in enumerate(TEXTS):
        own, ids = pieces[pieces.doc_id == i], plain(t) + [0]
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        for p in own.itertuples():
            part = ids[p.start : p.start + p.length]
            assert p.ids_crc32 == crc(part) and np.frombuffer(p.ids, "<u4").tolist() == part
            assert p.begins == (p.start == 0) and p.ends == (p.start + p.length == len(ids))
    for s, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
        assert own.length.sum() == 64 or s == pieces.sequence_id.max()
    assert sorted(pieces.sequence_id.unique()) == list(range(pieces.sequence_id.max() + 1))


def test_sequences_are_padded_but_at_a_power_of_two(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string").coalesce(1)
    for length, n in ((16, 7), (32, 7)):
        rows = packing.sequences(packing.pack(docs, length=length, keep_ids=True), length=length, pad_id=9).collect()
        assert [r.n_tokens for r in rows] == [n] and len(rows[0].ids) == 4 * length
        assert np.frombuffer(rows[0].ids, "<u4")[n:].tolist() == [9] * (length - n)
    four = packing.sequences(packing.pack(docs.filter("doc_id = 1"), length=16, keep_ids=True), length=16).first()
    assert four.n_tokens == 4 and len(four.ids) == 16


def test_packing_without_rows(no_docs):
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(odd_docs, plain, tmp_path, bits, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 1000)  # the long text covers several blocks
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(odd_docs, path, end_id=2, bits=bits)
    rows = {r.doc_id: r for r in token_files.documents_of(token_files.read_token_files(odd_docs.sparkSession, path)).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = plain(t) + [2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_of_a_wide_vocabulary(spark, tmp_path, bits):
    """More than 65,536 ids: the files say how wide they are."""
    wide = Tokenizer.from_file(default_tokenizer())
    wide.add_tokens([f"<extra{i}>" for i in range(20_000)])
    wide.save(str(tmp_path / "wide.json"))
    texts = ["two words", "", "<extra19999>"]
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, tokenizer=str(tmp_path / "wide.json"), bits=bits)
    files = token_files.read_token_files(spark, path)
    assert {(r.id_bytes, r.bits) for r in files.collect()} == {(4, bits)}
    rows = {r.doc_id: r for r in token_files.documents_of(files).collect()}
    for i, t in enumerate(texts):
        ids = wide.encode(t, add_special_tokens=False).ids + [2]
        assert (rows[i].n_tokens, rows[i].ids_crc32) == (len(ids), crc(ids))
    assert max(wide.encode(texts[2]).ids) > 65_536
    with pytest.raises(ValueError):
        token_files.from_planes([b"a", b"b"], 1, "<u4")


def test_stores_of_other_names():
    assert token_counts._store("dbfs:/mnt/a")[1] == "/dbfs/mnt/a" and token_counts._store("file:///tmp/a")[1] == "/tmp/a"
    assert token_counts.SCHEMES["s3a"] == "s3"


def test_token_files_of_repeated_and_missing_ids(spark, tmp_path, plain):
    docs = spark.createDataFrame([(None, "b"), (1, "same"), (1, "same"), (1, "other")], "doc_id long, text string")
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(docs, path)
    rows = token_files.documents_of(token_files.read_token_files(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 1] and sum(r.n_tokens for r in rows) == rows[-1].start + rows[-1].n_tokens


def test_token_files_without_rows(no_docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(no_docs, path)
    assert token_files.documents_of(token_files.read_token_files(no_docs.sparkSession, path)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.booleans())
def test_planes_round_trip(ids, bits):
    a = np.array(ids, "<u2")
    assert token_files.from_planes(token_files.to_planes(a, bits=bits), len(a), a.dtype).tolist() == ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=50), min_size=1, max_size=5))
def test_checksums_join(parts):
    assert token_files.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_token_counts(odd_docs, plain):
    rows = {r.doc_id: r for r in token_counts.document_tokens(odd_docs, block=512).collect()}
    assert {i: rows[i].n_tokens for i in rows} == {i: len(plain(t)) for i, t in enumerate(TEXTS)}
    spans = sorted((r.start, r.n_tokens) for r in rows.values())
    assert spans[0][0] == 0 and all(a + n + 1 == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_token_counts_without_rows(no_docs):
    assert token_counts.document_tokens(no_docs).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 100])
def test_flat_files_of_others(spark, tmp_path, block):
    """Raw files: empty documents, one over many blocks, and ids after the last separator."""
    files = {"a.bin": [5, 5, 0, 0, 7, 7, 7, 7, 7, 7, 7, 7, 0, 9], "b.bin": [0], "c.bin": [1, 2, 3]}
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    blocks = token_counts.read_flat_files(spark, f"file://{tmp_path}", block=block)
    rows = token_counts.count_tokens(blocks, separator=0).orderBy("file", "ordinal").collect()
    assert [(r.file[-5:], r.local_start, r.n_tokens, r.ended) for r in rows] == [("a.bin", 0, 2, True), ("a.bin", 3, 0, True), ("a.bin", 4, 8, True), ("a.bin", 13, 1, False), ("b.bin", 0, 0, True), ("c.bin", 0, 3, False)]


def test_repeated_and_missing_ids_in_counts_and_packing(spark, plain):
    docs = spark.createDataFrame([(None, "b c"), (None, None), (1, "same text"), (1, "same text"), (1, "x " * 9_000)], "doc_id long, text string")
    sizes = sorted(len(plain(t)) for (t,) in docs.select("text").collect())
    assert sorted(r.n_tokens for r in token_counts.document_tokens(docs).collect()) == sizes
    pieces = packing.pack(docs, length=1024).collect()
    assert sum(p.length for p in pieces) == sum(sizes) + 5 and sorted(p.doc_tokens - 1 for p in pieces if p.begins) == sizes


def test_a_flat_file_is_read_by_ranges(spark, tmp_path):
    """One file, many blocks in several tasks, documents over block edges."""
    random = np.random.default_rng(1)
    ids = np.where(random.random(50_000) < 0.003, 0, random.integers(1, 9, 50_000)).astype("<u2")
    ids.tofile(tmp_path / "one.ids")
    blocks = token_counts.read_flat_files(spark, f"file://{tmp_path}", block=512)
    assert blocks.rdd.getNumPartitions() > 1 and blocks.count() == -(-50_000 // 512)
    rows = token_counts.count_tokens(blocks, separator=0).orderBy("ordinal").collect()
    ends = [*np.flatnonzero(ids == 0).tolist(), 50_000]
    assert [(r.local_start, r.n_tokens) for r in rows] == [(a + 1, b - a - 1) for a, b in zip([-1, *ends], ends)]

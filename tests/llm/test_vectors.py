"""Codes, whitening and exact search: against numpy on whole tables, with every odd case."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import _balls, _contour, vector_codes, vector_files, whitening

NAN, INF = float("nan"), float("inf")
ODD = [(9_000, None, 3), (9_050, [1.0, None] + [0.0] * 14, 3), (9_100, [NAN] * 16, 3), (9_150, [INF] + [0.0] * 15, 3), (9_200, [], 3)]


def table(n=700, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(max(n, 400), dim)) * rng.uniform(0.2, 2, size=dim) + 3
    x[50:300] = x[50]  # a vector that many rows share
    x[300:330] = -x[300]
    x[330:333] = 0
    return x[:n]


def frame(spark, x, ids=None, more=ODD):
    rows = [(int(i), v.tolist(), int(i) % 5 if i % 7 else None) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame(rows + list(more), "vec_id long, embedding array<double>, label int").withColumn("dim", F.lit("x")).withColumn("blob", F.lit(1)).repartition(5)


def whole(x, scale):
    return np.floor(np.asarray(x, np.float64) * scale).astype(np.int64)


def nearest_brute(v, ids, query, k):
    score = v @ v[query]
    found = sorted((-int(score[i]), int(ids[i])) for i in range(len(v)) if ids[i] != ids[query])
    return [(r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]


@pytest.mark.parametrize("cells, block", [(64, 4_096), (4, 64), (2, 7)])
def test_exact_search(spark, monkeypatch, cells, block):
    monkeypatch.setattr(vector_files, "CELLS", cells)
    monkeypatch.setattr(vector_files, "ROWS_IN_BLOCK", block)
    monkeypatch.setattr(vector_files, "QUERIES_IN_BLOCK", 3)
    monkeypatch.setattr(vector_files, "LEAST_PAIRS", 500)
    x = table()
    short = [(9_300, [1.0, 2.0], 1), (9_301, [3.0, -1.0], 1), (None, [1.0] * 16, 1), (None, None, None)]
    got = {}
    for r in vector_files.search(frame(spark, x, more=ODD + short), F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = whole(x, 256)
    want = {q: nearest_brute(v, np.arange(len(v)), q, 5) for q in range(0, len(v), 50)}
    want[9_300] = [(1, 9_301, 256 * 768 - 512 * 256)]
    assert {q: sorted(h) for q, h in got.items()} == want


def test_search_of_repeated_ids_and_few_rows(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.0]), (50, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vector_files.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 49152), (0, 2, 2, 16384), (0, 3, 50, -32768), (50, 1, 2, 0), (50, 2, 0, -32768), (50, 3, 1, -32768)]
    assert vector_files.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert vector_files.search(df.filter("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0
    assert vector_files.search(df.filter("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(ValueError):
        vector_files.search(spark.createDataFrame([(0, [1e12]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)


def test_search_reads_few_vectors(spark):
    x = np.random.default_rng(1).normal(size=(3_000, 16))
    assert vector_files.share_read(frame(spark, x), F.col("vec_id") % 50 == 0) < 0.05


def books_brute(v, ids, parts, entries, rounds):
    p = v.reshape(len(v), parts, -1)
    first = np.lexsort((*v.T[::-1], ids))[:entries]
    b = p[first].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((p[:, :, None, :] - b[None]) ** 2).sum(axis=-1)
        code = d.argmin(axis=-1)
        if r < rounds:
            for j in range(parts):
                for e in range(b.shape[1]):
                    own = p[code[:, j] == e, j]
                    if len(own):
                        b[j, e] = own.sum(axis=0) // len(own)
    return b, code, d.min(axis=-1).sum(axis=1)


@pytest.mark.parametrize("leaf, chunk", [(64, 1 << 18), (2, 100 * 16)])
def test_codes(spark, monkeypatch, leaf, chunk):
    monkeypatch.setattr(_balls, "LEAF", leaf)
    monkeypatch.setattr(vector_codes, "IN_CHUNK", chunk)
    x = table()
    odd = [(9_400, [1.0] * 15, 2), (9_401, [0.5] * 32, 2), (9_401, [0.5] * 32, 2), (9_402, [0.25] * 32, None)]
    rows = vector_codes.report(frame(spark, x, more=ODD + odd), parts=16, entries=64, rounds=2).collect()
    b, code, error = books_brute(whole(x, 256), np.arange(len(x)), 16, 64, 2)
    digest = hashlib.sha256(",".join(map(str, b.ravel().tolist())).encode()).hexdigest()
    labels = [i % 5 if i % 7 else None for i in range(len(x))]
    sums = {k: int(sum(e for e, own in zip(error, labels, strict=True) if own == k)) for k in set(labels)}
    own = {r.vec_id: r for r in rows if r.vec_id < 9_000}
    assert len(rows) == len(x) + 3 and len(own) == len(x)
    for i in range(len(x)):
        assert own[i].code == "".join(f"{c:02x}" for c in code[i]) and own[i].error == error[i] and own[i].codebooks_sha256 == digest
        assert own[i].label_error == sums[labels[i]]
    assert sorted((r.vec_id, r.code, r.error) for r in rows if r.vec_id > 9_000) == [(9_401, "00" * 16, 0), (9_401, "00" * 16, 0), (9_402, "02" * 16, 0)]


def test_codes_decode_and_no_rows(spark):
    x = table(100)
    df = frame(spark, x)
    codes, books = vector_codes.compress(df, entries=64)
    v = whole(x, 256)
    for r in codes.collect():
        assert ((np.array(books.decode(16, r.code)) - v[r.vec_id]) ** 2).sum() == r.error
    assert vector_codes.report(df.limit(0)).count() == 0 and vector_codes.report(df.filter("vec_id >= 9000")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-6, 6)] * 4), min_size=1, max_size=80), st.lists(st.tuples(*[st.integers(-6, 6)] * 4), min_size=1, max_size=9), st.integers(1, 8))
def test_walk_finds_the_nearest_entry(points, entries, leaf):
    before, _balls.LEAF = _balls.LEAF, leaf
    try:
        v, b = np.array(points), np.array(entries)
        books = b.reshape(len(b), 2, 2).transpose(1, 0, 2)
        trees = _balls.Trees.of(v, 2)
        codes, errors = trees.codes(books)
        d = ((v.reshape(-1, 2, 1, 2) - books[None]) ** 2).sum(axis=-1)
        assert (codes == d.argmin(axis=-1)).all() and (errors == d.min(axis=-1).sum(axis=1)).all()
        sums, counts = trees.sums(books)
        for part in range(2):
            for e in range(len(b)):
                own = v.reshape(-1, 2, 2)[codes[:, part] == e, part]
                assert counts[part, e] == len(own) and (sums[part, e] == own.sum(axis=0)).all()
    finally:
        _balls.LEAF = before


def test_balls_own_points_wholly():
    rng = np.random.default_rng(2)
    centres = rng.integers(-5_000, 5_000, size=(32, 4))
    v = (centres[rng.integers(32, size=4_000)] + rng.integers(-20, 20, size=(4_000, 4))).astype(np.int64)
    balls, _, open_, _, compared = _balls.Trees.of(v, 1).walk(centres[None])
    assert compared < 4_000 * 32 / 4 and len(open_) < 400


@pytest.mark.parametrize(
    "values",
    [np.linspace(1, 50, 40), [5.0] * 20 + [3.0] * 15 + [0.0] * 5, [1.0] * 40, 10.0 ** -np.arange(9.0), [2.0], [0.0] * 5, np.r_[np.ones(20) + 1e-11 * np.arange(20), np.full(20, 2.0)]],
    ids=["plain", "repeated", "one", "steep", "single", "nothing", "near"],
)
def test_contour_finds_all(values):
    values = np.sort(np.asarray(values, float))[::-1]
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(len(values), len(values))))
    m = (q * values) @ q.T
    cuts = _contour.intervals((m + m.T) / 2, 32)
    wanted = min(32, int((values > 1e-11).sum()))
    assert sum(c for _, _, c in cuts) >= wanted
    if cuts:
        found, u = _contour.together(m, np.concatenate([_contour.in_interval(m, *c)[1] for c in cuts], axis=1), wanted)
        assert np.abs(found - values[:wanted]).max() < 1e-12 * values[0]
        assert np.abs(u.T @ u - np.eye(wanted)).max() < 1e-12 and np.abs(m @ u - u * found).max() < 1e-12 * values[0]


def test_inertia():
    m = np.random.default_rng(5).normal(size=(30, 30))
    m += m.T
    shifts = np.linspace(-20, 20, 41)
    assert (_contour.above(_contour.tridiagonal(m), shifts) == [(np.linalg.eigvalsh(m) > s).sum() for s in shifts]).all()
    with pytest.raises(ArithmeticError):
        _contour.in_interval(np.diag([1.0, 2.0, 3.0]), 1.5, 2.5, 2)


def test_whitening(spark):
    x = table()
    extra = [(None, x[0].tolist(), 1), (5, x[5].tolist(), 1), (9_500, [1.0, 2.0], 1), (9_501, [1.0, 4.0], 1), (9_502, [7.0], 1)]
    got = whitening.whiten(frame(spark, x, more=ODD + extra), components=32).toPandas()
    v = (whole(np.concatenate([x, x[[0, 5]]]), 64) + 1_000_000).astype(object)
    n, s = len(v), v.sum(axis=0)
    z = np.array(v * n - s, float) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    w = z @ u / np.sqrt(e)
    own = got[got.n == n]
    assert len(own) == n * 16 and sorted(own.component.unique()) == list(range(1, 17)) and own.identity_error.max() < 1e-9
    ids = np.append(np.arange(len(x)), [-1, 5])
    mine = own.fillna({"vec_id": -1}).sort_values(["vec_id", "component"], kind="stable")
    order = np.argsort(ids, kind="stable")
    values = mine[~mine.vec_id.isin([5])].whitened.to_numpy().reshape(-1, 16)
    want = w[order][ids[order] != 5]
    sign = np.sign((values * want).sum(axis=0))
    assert np.abs(values * sign - want).max() < 1e-8
    deviation = [int(((v[i] * n - s) ** 2).sum()) for i in order if ids[i] != 5]
    assert mine[~mine.vec_id.isin([5])].deviation.to_numpy()[::16].tolist() == deviation
    assert mine.groupby("component").explained.first().to_numpy() == pytest.approx(e / np.trace(z.T @ z / n), rel=1e-9)
    two = got[got.vec_id.isin([9_500, 9_501])].sort_values("vec_id")
    assert two.whitened.abs().tolist() == pytest.approx([1, 1]) and two.explained.tolist() == pytest.approx([1, 1]) and not (got.vec_id == 9_502).any()


def test_whitening_of_nothing(spark):
    df = frame(spark, table(20))
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 3")).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    huge = spark.createDataFrame([(i, [float(1 << (20 * i)), 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert whitening.whiten(huge).filter("deviation is null").count() > 0

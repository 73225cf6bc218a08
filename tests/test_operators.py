"""Edge cases, and plain Python twins of the passes that depend on order."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import dates as D
from brindle.functions import text as X
from brindle.operators import bars as B
from brindle.operators import encode as E
from brindle.operators import models as M
from brindle.operators import quality as Q
from brindle.operators import rules as R
from brindle.operators import similar as S
from brindle.operators import tags as T

DAY = dt.date(2024, 1, 1)


def bars_of(spark, rows):
    return spark.createDataFrame(rows, "date date, open double, high double, low double, close double, volume long")


def test_bars_with_open_zero_and_short_window(spark):
    rows = B.moving_averages(B.daily_bars(bars_of(spark, [(DAY, 0.0, 2.0, 0.0, 1.0, 5), (DAY + dt.timedelta(1), 2.0, 3.0, 1.0, 1.0, 5)])), (2, 3)).orderBy("date").collect()
    assert rows[0].daily_change_percent is None and rows[1].daily_change_percent == -50.0
    assert [r.ma_2 for r in rows] == [None, 1.0] and [r.ma_3 for r in rows] == [None, None]


def test_empty_bars(spark):
    empty = bars_of(spark, [])
    assert B.daily_bars(empty).count() == 0 and B.worst_days(B.daily_bars(empty)).count() == 0
    assert B.series_statistics(B.with_benchmark(B.daily_bars(empty), spark.createDataFrame([], "date date, index_open double, index_close double"))).first().days == 0


def test_both_tails_overlap(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(i), float(i)) for i in range(3)], "date date, excess double")
    assert B.both_tails(df, "excess", 2).count() == 4


def test_price_movement_needs_both_bars(spark):
    bars = spark.createDataFrame([(DAY, 10.0), (DAY + dt.timedelta(8), 12.0)], "date date, close double")
    events = spark.createDataFrame([(1, DAY + dt.timedelta(3)), (2, DAY + dt.timedelta(30))], "event long, date date")
    rows = B.price_movement(events, bars, horizon=1).collect()
    assert [(r.event, r.change, r.change_percent) for r in rows] == [(1, 2.0, 20.0)]


def test_repeated_tag_counts_twice_in_one_and_once_in_the_other(spark):
    df = spark.createDataFrame([("a", "x; x; y", -2.0), ("b", "none", 4.0)], "event_key string, categories string, magnitude double")
    assert {r.tag: r.events for r in T.tag_means(df).collect()} == {"x": 2, "y": 1}
    assert {r.tag: r.mean_magnitude for r in T.tag_means_over_all(df).collect()} == {"x": 1.0, "y": 1.0}


def test_recency_begins_again_after_two_years(spark):
    got = spark.createDataFrame([(d,) for d in (-1, 0, 365, 730, 731, 5000, None)], "d int").select(R.recency(F.col("d")).alias("r")).collect()
    assert [round(r.r, 3) for r in got] == [1.0, 1.0, 0.5, 0.1, 0.499, 0.1, 0.5]


def test_strikes_differ_by_what_year_before_means(spark):
    v = spark.createDataFrame([(2019, "results", 1, 30.0), (2021, "results", 1, 30.0), (2022, "notice", 2, 90.0), (2022, "results", 1, 26.0)], "year int, kind string, place int, against_pct double")
    assert [r.strike for r in R.remuneration_strikes(v).orderBy("year").collect()] == ["first", "first", "second"]
    assert [r.strike for r in R.protest_votes(v).orderBy("year").collect()] == ["first", "second", "second"]


def test_json_out_of_text(spark):
    texts = ["```json\n{\"k\": 1}\n``` {x}", "so {\"k\": 2} end", "none", None, "{broken"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.json_in(F.col("t")).alias("j")).collect()
    assert [r.j for r in rows] == ['{"k": 1}', '{"k": 2}', None, None, None]


def test_malformed_date_field_hides_the_url(spark):
    rows = [("soon", "http://x/2024-02-03/a", ""), ("", "http://x/2024-02-03/a", ""), (None, "http://x/a", "on Feb 3, 2024"), ("2024-02-30", "", ""), (None, None, None)]
    got = spark.createDataFrame(rows, "f string, u string, s string").select(D.article_date(F.col("f"), F.col("u"), F.col("s")).alias("d")).collect()
    assert [r.d for r in got] == [None, dt.date(2024, 2, 3), dt.date(2024, 2, 3), None, None]


def test_empty_factor_name_is_the_first_factor(spark):
    names = {"": "fuel_prices", "Jet fuels": "fuel_prices", "weather": None, None: None, "wars": None, "\tMACRO_fx ": "macro_fx", "remuneration vote": "executive_comp", "cabin": "labor_union", "price wars": "competition", "macro_fx costs": "macro_fx"}
    rows = E.canonical_factors(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()
    assert {r.name: r.canonical for r in rows} == names
    few = {"price_now": ("tariff",), "cost of x": ("levy",)}
    rows = E.canonical_factors(spark.createDataFrame([("prices_now up",), ("the costs of x",)], "name string"), "name", factors=few).collect()
    assert [r.canonical for r in rows] == ["price_now", "cost of x"]


def test_scaler_must_be_fitted(spark):
    with pytest.raises(ValueError):
        E.Scaler().transform(spark.range(1))


def test_information_value_of_one_class_is_zero(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "f string, y int")
    assert Q.categorical_iv(df, "f", F.col("y") == 1).first().information_value == 0


def test_split_fractions_must_add_up(spark):
    with pytest.raises(ValueError):
        Q.temporal_split(spark.range(3), "id", train=0.5)


def test_splits_are_in_order_and_disjoint(spark):
    rows = Q.temporal_split(spark.range(100), "id", gap=3).collect()
    by = {s: [r.id for r in rows if r.split == s] for s in ("train", "validate", "test")}
    assert max(by["train"]) < min(by["validate"]) - 3 and max(by["validate"]) < min(by["test"]) - 3
    assert [len(by[s]) for s in ("train", "validate", "test")] == [70, 15, 9]


def greedy(sets, threshold):
    kept = []
    for k in sorted(sets):
        if not any(sets[k] and sets[j] and len(sets[k] & sets[j]) / len(sets[k] | sets[j]) >= threshold for j in kept):
            kept.append(k)
    return kept


def test_near_duplicates_as_the_greedy_pass(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = {i: " ".join(rng.sample(words, rng.randint(0, 6))) for i in range(200)}
    df = spark.createDataFrame(sorted(texts.items()), "pos long, text string")
    got = sorted(r.pos for r in S.without_near_duplicates(df, vocabulary=tuple(words)).collect())
    assert got == greedy({i: frozenset(t.split()) for i, t in texts.items()}, 0.7)


def vectors_of(n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 6))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_assignment_as_the_leader_pass(spark):
    n = 150
    v = vectors_of(n, 1)
    days = [int(x) for x in np.random.default_rng(2).integers(0, 90, n)]
    refused = lambda a, b: (a + b) % 5 == 0
    leaders, event = [], {}
    for i in range(n):
        best, at = 0.6, None
        for j in leaders:
            if abs(days[i] - days[j]) <= 30 and v[i] @ v[j] > best:
                best, at = v[i] @ v[j], j
        event[i] = at if at is not None and not refused(at, i) else i
        if event[i] == i:
            leaders.append(i)
    df = spark.createDataFrame([(i, v[i].tolist(), DAY + dt.timedelta(days[i])) for i in range(n)], "pos long, vector array<double>, date date")
    pairs = S.similar_pairs(df, threshold=0.6, band=S.day_band(F.col("date"), 30))
    date = {i: DAY + dt.timedelta(days[i]) for i in range(n)}
    expected = {(a, b) for a in range(n) for b in range(a + 1, n) if v[a] @ v[b] > 0.6 and abs(days[a] - days[b]) <= 30}
    near = [(r.a, r.b, r.dot) for r in pairs.collect() if abs((date[r.a] - date[r.b]).days) <= 30]
    assert {(a, b) for a, b, _ in near} == expected
    edges = spark.createDataFrame(near, "a long, b long, dot double")
    verdicts = edges.select("a", "b", ((F.col("a") + F.col("b")) % 5 != 0).alias("same"))
    assert {r.pos: r.event for r in S.assign_to_events(df, edges, verdicts=verdicts).collect()} == event


def test_merging_as_the_pass_in_order(spark):
    n = 80
    v = vectors_of(n, 4)
    pairs = [(a, b, float(v[a] @ v[b])) for a in range(n) for b in range(a + 1, n) if v[a] @ v[b] > 0.5]
    weight = {(a, b): w for a, b, w in pairs}
    taken, into = set(), {i: i for i in range(n)}
    for i in range(n):
        if i in taken:
            continue
        options = [(weight[i, j], -j) for j in range(i + 1, n) if j not in taken and (i, j) in weight]
        if options:
            j = -max(options)[1]
            if (i + j) % 4:
                taken |= {j}
                into[j] = i
            taken.add(i)
    edges = spark.createDataFrame(pairs, "a long, b long, weight double")
    verdicts = edges.select("a", "b", ((F.col("a") + F.col("b")) % 4 != 0).alias("same"))
    got = {r.pos: r.into for r in S.merged_once(spark.range(n).withColumnRenamed("id", "pos"), edges, verdicts=verdicts).collect()}
    assert got == into


@pytest.mark.parametrize("most", [2_000_000, 300])
def test_greedy_passes_on_long_chains(spark, monkeypatch, most):
    """Chains longer than any number of rounds, side by side with smaller groups, in components that are walked through and in some that aren't."""
    from brindle.operators import components as C

    n = 4_000 if most > 300 else 260
    monkeypatch.setattr(C, "MOST_EDGES", most)
    monkeypatch.setattr(S, "ROUNDS", 1 if most > 300 else 2)
    rng = random.Random(7)
    pairs = {(i, i + 1): 1.0 for i in range(n - 1)} | {(i, i + 2): 0.5 for i in range(0, n - 2, 7)}
    pairs |= {tuple(sorted(rng.sample(range(n, n + 400), 2))): rng.choice([0.5, 0.75, 1.0]) for _ in range(420)}
    refused = {p for p in pairs if (p[0] * 7 + p[1]) % 5 == 0}
    items = spark.range(n + 400).withColumnRenamed("id", "pos")
    edges = spark.createDataFrame([(a, b, w, w) for (a, b), w in pairs.items()], "a long, b long, dot double, weight double").repartition(5)
    verdicts = spark.createDataFrame([(a, b, (a, b) not in refused) for a, b in pairs], "a long, b long, same boolean")
    before = {b: [] for b in range(n + 400)}
    for (a, b), w in pairs.items():
        before[b].append((-w, a))

    gone: set = set()
    for b in range(n + 400):
        if any(a not in gone for _, a in before[b]):
            gone.add(b)
    assert {r.pos for r in S.greedy_kept(items, edges).collect()} == set(range(n + 400)) - gone

    event: dict = {}
    for b in range(n + 400):
        best = min(((w, a) for w, a in before[b] if event[a] == a), default=None)
        event[b] = best[1] if best and (best[1], b) not in refused else b
    assert {r.pos: r.event for r in S.assign_to_events(items, edges, verdicts=verdicts).collect()} == event

    into = {i: i for i in range(n + 400)}
    behind = {a: [] for a in range(n + 400)}
    for (a, b), w in pairs.items():
        behind[a].append((-w, b))
    for a in range(n + 400):
        free = [(w, b) for w, b in behind[a] if into[b] == b]
        if into[a] == a and free and (a, min(free)[1]) not in refused:
            into[min(free)[1]] = a
    assert {r.pos: r.into for r in S.merged_once(items, edges, verdicts=verdicts).collect()} == into


def test_greedy_on_chains_and_without_edges(spark):
    items = spark.range(4).withColumnRenamed("id", "pos")
    chain = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    assert sorted(r.pos for r in S.greedy_kept(items, chain).collect()) == [0, 2]
    assert S.greedy_kept(items, chain.limit(0)).count() == 4


def test_components_are_orthogonal_and_in_order_of_variance(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) * [4, 2, 1, 0.5]
    scores, variance = M.components(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>"), k=3)
    s = np.zeros((300, 3))
    for r in scores.collect():
        s[r.id, r.component] = r.score
    c = np.cov(s.T)
    assert np.allclose(c - np.diag(np.diag(c)), 0, atol=1e-6) and variance == sorted(variance, reverse=True)


def test_topic_shares_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "red ring blue stone" if i % 2 else "fast train slow boat") for i in range(20)], "id long, description string")
    shares, _ = M.lda_topics(docs, key="id", text="description", k=2, iterations=5)
    assert all(abs(r.s - 1) < 1e-6 for r in shares.groupBy("id").agg(F.sum("share").alias("s")).collect())


def test_stratified_folds_hold_every_row_once(spark):
    df = spark.range(500).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    got = M.stratified_folds(df, "y", "id").groupBy("y", "fold").count().collect()
    assert sum(r["count"] for r in got) == 500 and {r.fold for r in got} == {1, 2, 3, 4, 5}


def test_action_history_as_brute_force(spark):
    rng = random.Random(3)
    actions = [(i, y, None if i % 40 == 0 else dt.date(y, rng.randrange(1, 13), rng.randrange(1, 29)), None if i % 25 == 0 else f"t{i}", rng.choice((None, 5.0, 21.0)) if y > 2003 else 1.0) for i in range(300) for y in [rng.choice((1999, 2001, 2002, 2003, 2004, 2009))]]
    events = [(n, rng.randrange(1998, 2013)) for n in range(80)]
    got = R.action_history(spark.createDataFrame(events, "name long, year int"), spark.createDataFrame(actions, "id long, year int, date date, title string, support double").repartition(5)).collect()
    want = set()
    for n, y in events:
        own = sorted((a for a in actions if y - 2 <= a[1] <= y), key=lambda a: (a[2] is not None, -(a[2] or DAY).toordinal(), a[0]))
        if own:
            want.add((n, len(own), " | ".join(a[3] for a in own[:3] if a[3]), "partial" if any((a[4] or 0) >= 20 for a in own) else "non-responsive"))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_action_history_of_a_large_year(spark):
    """Nine hundred million pairs, of which none becomes a row."""
    n = 30_000
    actions = spark.range(n).select("id", F.lit(2001).alias("year"), F.lit(DAY).alias("date"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.lit(20.0).alias("support"))
    events = spark.range(n).select(F.col("id").alias("name"), F.lit(2003).alias("year"))
    got = R.action_history(events, actions)
    assert got.count() == n and got.drop("name").distinct().collect() == [(n, "t0 | t1 | t2", "partial")]


def test_positions_of_wide_rows(spark):
    """A million wide rows over many partitions, written out: each place from 0 on stands once, at its row."""
    from brindle.operators.quality import with_position

    n = 1_000_000
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 6).alias("wide"))
        out = S.stored(with_position(rows, "k"), "positions")
        assert out.filter("position <> k").count() == 0 and out.select("position").distinct().count() == n
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_quantiles_and_ranks_of_ties_and_nulls(spark):
    import numpy as np

    from brindle.operators.quality import quantiles
    from brindle.operators.topics import average_ranks

    values = [3.0, 1.0, 1.0, 7.0, None, 2.5, 2.5, 2.5]
    df = spark.createDataFrame([(v, "g") for v in values], "n double, g string")
    known = [v for v in values if v is not None]
    assert quantiles(df, "n", (0.0, 0.1, 0.5, 0.9, 1.0)) == pytest.approx([float(np.quantile(known, q)) for q in (0.0, 0.1, 0.5, 0.9, 1.0)])
    assert quantiles(df.filter("n > 9"), "n", (0.5,)) == [None]
    ranks = {r["n"]: r["r"] for r in average_ranks(df.filter("n is not null"), "n", "g", "r").collect()}
    assert ranks == {1.0: 1.5, 2.5: 4.0, 3.0: 6.0, 7.0: 7.0}


def test_most_similar_against_all(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(S, "BLOCK", 4)  # several blocks on both sides
    x = np.random.default_rng(3).normal(size=(60, 5)).round(3)
    x[7] = 0
    x[11] = x[12]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)], "id long, vector array<double>")
    rows = S.top_similar(df.filter("id < 15"), df, k=3).collect()
    with np.errstate(invalid="ignore"):
        c = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    for q in range(15):
        order = sorted((i for i in range(60) if i not in (q, 7)), key=lambda i: (-round(c[q, i], 6), i))[:3] if q != 7 else []
        assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query"] == q] == order


def clustered(n, dim, groups, spread=0.05, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))


def test_pairs_and_neighbours_skip_blocks(spark, monkeypatch):
    """On clustered vectors most blocks are never compared, and nothing is lost; with vectors of another length, zeros and nulls."""
    monkeypatch.setattr(S, "BLOCK", 16)
    x = clustered(600, 8, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1.0, 2.0]), (1001, [3.0, 1.0]), (1002, [0.0] * 8), (1003, None), (1004, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "pos long, vector array<double>").withColumn("id", F.col("pos")).repartition(3)
    threshold, exact = 6.0, x @ x.T
    got = {(r.a, r.b): r.dot for r in S.similar_pairs(df, threshold=threshold, band=F.lit(0)).collect()}
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if exact[i, j] > threshold}
    assert {p for p in got if p[0] < 1000} == want and len(want) > 1000 and {p for p in got if p[0] >= 1000} == set()
    assert S.share_met(df, threshold=threshold, band=F.lit(0)) < 0.35

    asked = df.filter("id % 10 = 0 or id >= 1000")
    rank = {(r["query"], r["rank"]): (r["id"], r["similarity"]) for r in S.top_similar(asked, df, k=4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 600, 10):
        c = np.round(unit @ unit[q], 6)
        order = sorted((j for j in range(600) if j != q), key=lambda j: (-c[j], j))[:4]
        assert [rank[q, r + 1][0] for r in range(4)] == order
    assert rank[1000, 1][0] == 1001 and (1000, 2) not in rank and (1002, 1) not in rank and (1004, 1) not in rank
    assert S.share_visited(asked, df, k=4) < 0.35
    assert S.top_similar(asked, df.limit(0)).count() == 0 and S.similar_pairs(df.limit(0), threshold=0.5, band=F.lit(0)).count() == 0


def test_pairs_of_long_vectors(spark):
    df = spark.createDataFrame([(1, [5.0, 0.0]), (2, [6.0, 0.0]), (3, [0.0, 1.0])], "pos long, vector array<double>")
    band = S.projection_band(F.col("vector"), 0.9, S.largest_norm(df))
    assert [(r["a"], r["b"], r["dot"]) for r in S.similar_pairs(df, threshold=0.9, band=band).collect()] == [(1, 2, 30.0)]


def test_factors_of_large_ids(spark):
    from brindle.operators.factors import topics

    docs = spark.createDataFrame([((1 << 40) + i, "river stone water" if i % 2 else "market price share") for i in range(12)] + [(5, None), (6, "")], "id long, text string")
    out, terms, _ = topics(docs, key="id", text="text", k=2)
    rows = {(r["id"], r["topic"]): r["share"] for r in out.collect()}
    assert len(rows) == 28 and rows[5, 0] == rows[5, 1] == rows[6, 0] == 0
    for i in range(12):
        assert max(rows[(1 << 40) + i, t] for t in (0, 1)) == pytest.approx(1, abs=1e-6)
        assert rows[(1 << 40) + i, 0] == pytest.approx(rows[(1 << 40) + i % 2, 0])
    found = {t: {r["term"] for r in terms.collect() if r["topic"] == t} for t in (0, 1)}
    assert sorted(map(sorted, found.values())) == [["market", "market price", "price", "price share", "share"], ["river", "river stone", "stone", "stone water", "water"]]
    assert topics(docs.limit(0), key="id", text="text", k=2)[0].count() == 0


def test_factors_as_of_the_dense_matrix(spark, monkeypatch):
    """The loss of a plain twin that stores every zero, from exact singular vectors, and blocks of any size."""
    from brindle.operators import factors as N

    monkeypatch.setattr(N, "IN_BLOCK", 7)
    monkeypatch.setattr(N, "AT_ONCE", 500)
    rng = np.random.default_rng(8)
    x = rng.random((120, 5)) ** 4 @ rng.random((5, 40)) ** 3 * (rng.random((120, 40)) < 0.5)
    x = x[(x > 0).any(axis=1)]
    rows = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r > 0].tolist()) for r in x], "numbers array<int>, weights array<double>").repartition(4)
    found = N.fit(rows, [str(i) for i in range(40)], k=5, l1=0.01, l2=0.02, tolerance=1e-5, passes=50)

    u, s, v = np.linalg.svd(x, full_matrices=False)
    h = np.abs(v[:5]) * np.sqrt(s[:5])[:, None]
    for _ in range(2000):
        g = h @ h.T
        w = np.zeros((len(x), 5)) if _ == 0 else w
        for j in range(5):
            w[:, j] = np.maximum(0, w[:, j] + (x @ h[j] - 0.01 - w @ g[:, j] - 0.02 * w[:, j]) / (g[j, j] + 0.02))
        g = w.T @ w
        for j in range(5):
            h[j] = np.maximum(0, h[j] + (w[:, j] @ x - 0.01 - g[j] @ h - 0.02 * h[j]) / (g[j, j] + 0.02))

    def loss(w, h):
        return 0.5 * ((x - w @ h) ** 2).sum() + 0.01 * (w.sum() + h.sum()) + 0.01 * ((w**2).sum() + (h**2).sum())

    own = found.shares_of(x @ found.weights.T)
    assert found.losses == sorted(found.losses, reverse=True)
    assert loss(own, found.weights) <= loss(w, h) * 1.01 and found.losses[-1] == pytest.approx(loss(own, found.weights), rel=1e-3)


@pytest.mark.parametrize("block", [7, 100_000])
def test_nearest_information_as_brute_force(spark, monkeypatch, block):
    """Ties, values of one label only, a label of one row, and distances that differ by rounding."""
    from brindle.operators import information as I

    monkeypatch.setattr(I, "IN_BLOCK", block)
    rng = random.Random(3)
    rows = [(rng.choice([round(rng.random(), 1), rng.random(), rng.randrange(3) / 3]), rng.choice("abb")) for _ in range(120)]
    rows = [(x + 2 * (y == "a"), y) for x, y in rows]
    rows += [(0.5, "alone"), (None, "a"), (1.0, None), (float("nan"), "a"), (0.25, "two"), (0.75, "two")]
    got = I.nearest_information(spark.createDataFrame(rows, "x double, y string").repartition(3), "x", "y")

    own = [(x, y) for x, y in rows if x is not None and x == x and y not in (None, "alone")]
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    total = 0.0
    for i, (x, y) in enumerate(own):
        same = sorted(abs(x - v) for j, (v, w) in enumerate(own) if w == y and j != i)
        k = min(3, len(same))
        m = sum(abs(x - v) < same[k - 1] or v == x for v, _ in own)
        total += psi(k) - psi(len(same) + 1) - psi(m)
    assert got == pytest.approx(max(0, psi(len(own)) + total / len(own)), abs=1e-9) and got > 0
    assert I.nearest_information(spark.createDataFrame([], "x double, y string"), "x", "y") == 0


@pytest.mark.parametrize("counters", [4, 64, 1 << 18])
def test_frequent_terms_as_counting_all(spark, monkeypatch, counters):
    """Few counters, which must be opened again, and ties at the last place."""
    from brindle.operators import topics as T

    monkeypatch.setattr(T, "COUNTERS", counters)
    rng = random.Random(2)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randrange(0, 60))) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    found = [(r.term, r.df) for r in T.frequent_terms(T._terms(docs, "id", "text", (), 2), least=3, most=0.5, terms=20).collect()]
    tf, df = {}, {}
    for t in texts:
        w = (t or "").split()
        own = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        for x in own:
            tf[x] = tf.get(x, 0) + 1
        for x in set(own):
            df[x] = df.get(x, 0) + 1
    order = sorted((x for x in tf if 3 <= df[x] <= len(texts) * 0.5), key=lambda x: (-tf[x], x))[:20]
    assert sorted(found) == sorted((x, df[x]) for x in order)


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(Q, "BINS", 3)
    inf = float("inf")
    for values in ([5.0], [1.0, 1.0, 2.0], [-inf, 0.0, 1e308, -1e308, inf, inf], [i * 0.1 for i in range(50)] + [3.0] * 20, [5e-324, 1e-323, 0.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert Q.order_statistics(df, "v", list(range(len(values)))) == dict(enumerate(sorted(values)))


@pytest.mark.parametrize("rare", [0, 3, 64])
def test_prior_events_as_all_pairs(spark, monkeypatch, rare):
    """A hot company, words that few or many of its events have, repeated days, long and short gaps, nulls; against every pair."""
    monkeypatch.setattr(R, "RARE", rare)
    rng = random.Random(5)
    rows = []
    for n in range(400):
        day = DAY - dt.timedelta(rng.choice([rng.randrange(8), 365, 730, 731, 1216, 1217, rng.randrange(3000)]))
        company = None if n % 57 == 0 else rng.choice(["Hot", "hot", "cold", f"c{n % 20}"])
        categories = rng.choice([["x"], ["x", "y"], [], None])
        rows.append((n, company, None if n % 61 == 0 else day, categories, rng.choice([["the", "fare"], ["strike"], [f"w{n % 90}", "fare", "strike"], [f"w{n % 90}", f"v{n}", "the"], [f"v{n}"], [], None]), rng.choice(["climate", "tax", "other"])))
    schema = "name long, company string, date date, categories array<string>, tokens array<string>, theme string"
    events = spark.createDataFrame(rows, schema)
    a = events.select("*", F.lower("company").alias("c"), F.year("date").alias("year"))
    b = events.select(F.lower("company").alias("c"), *[F.col(x).alias(f"p_{x}") for x in events.columns])
    pairs = R.theme_priority(a.join(b, "c").filter("p_date < date"), theme_col="p_theme")
    score = R.issue_similarity(F.col("categories"), F.col("p_categories"), F.col("tokens"), F.col("p_tokens")) * 0.5 + F.col("priority") * 0.3 + R.recency(F.datediff("date", "p_date")) * 0.2
    every = {}
    for r in pairs.select("name", "p_name", F.round(score, 6).alias("score")).collect():
        every.setdefault(r[0], []).append((-r[2], r[1]))
    for k in (1, 3, 4) if rare == 3 else (3,):
        wanted = sorted((name, prior, -s, i + 1) for name, found in every.items() for i, (s, prior) in enumerate(sorted(found)[:k]))
        assert sorted(tuple(r) for r in R.prior_events(events, k=k).collect()) == wanted
    assert R.prior_events(spark.createDataFrame([], schema)).count() == 0


def test_pairs_of_tiles(spark, monkeypatch):
    """Blocks are moved once for each pair of tiles, whatever they meet; each pair comes once, with the days between."""
    for name, n in (("BLOCK", 8), ("TILE", 64)):
        monkeypatch.setattr(S, name, n)
    v, moved, met = vectors_of(400, 8), [], S._met
    monkeypatch.setattr(S, "_met", lambda *a: moved.append(met(*a)) or moved[-1])
    date = [None if i % 9 == 0 else DAY + dt.timedelta(i * 7 % 50) for i in range(400)]
    df = spark.createDataFrame([(i, v[i].tolist(), date[i], i % 3) for i in range(400)], "pos long, vector array<double>, date date, band int")
    rows = S.similar_pairs(df, threshold=0.5, band=F.col("band"), day=F.col("date")).collect()
    want = {(i, j): None if date[i] is None or date[j] is None else abs((date[i] - date[j]).days) for i in range(400) for j in range(i + 1, 400) if abs(i % 3 - j % 3) <= 1 and v[i] @ v[j] > 0.5}
    assert {(r.a, r.b): r.days for r in rows} == want and len(rows) == len(want)
    assert moved[0].select(F.sum(F.size("items"))).first()[0] <= 400 * 3 * 10
    got = S.top_similar(df.select(F.col("pos").alias("id"), "vector"), df.select(F.col("pos").alias("id"), "vector"), k=3).collect()
    c = np.round(v @ v.T, 6)
    assert {(r["query"], r["rank"]): r["id"] for r in got} == {(q, n + 1): i for q in range(400) for n, i in enumerate(sorted((i for i in range(400) if i != q), key=lambda i: (-c[q, i], i))[:3])}


def test_dense_passes_in_slices(spark, monkeypatch):
    """A large component of many edges is walked through in a few slices, not in a round for each item or so."""
    from brindle.operators import components as C

    monkeypatch.setattr(C, "MOST_EDGES", 600)
    rng = random.Random(11)
    pairs = {(a, b): rng.random() for a in range(120) for b in range(a + 1, 120) if rng.random() < 0.3}
    edges = spark.createDataFrame([(a, b, w, w) for (a, b), w in pairs.items()], "a long, b long, dot double, weight double")
    verdicts = edges.select("a", "b", ((F.col("a") + F.col("b")) % 5 != 0).alias("same"))
    items, writes = spark.range(120).withColumnRenamed("id", "pos"), []
    for module in (S, C):
        monkeypatch.setattr(module, "stored", lambda df, name, f=C.stored: writes.append(name) or f(df, name))
    event, into = {}, {i: i for i in range(120)}
    for b in range(120):
        best = max(((pairs[a, b], -a) for a in range(b) if (a, b) in pairs and event[a] == a), default=None)
        event[b] = -best[1] if best and (b - best[1]) % 5 else b
    assert {r.pos: r.event for r in S.assign_to_events(items, edges, verdicts=verdicts).collect()} == event
    for a in range(120):
        best = max(((pairs[a, b], -b) for b in range(a + 1, 120) if (a, b) in pairs and into[b] == b), default=None)
        if into[a] == a and best and (a - best[1]) % 5:
            into[-best[1]] = a
    assert {r.pos: r.into for r in S.merged_once(items, edges, verdicts=verdicts).collect()} == into
    assert writes.count("slices") == 2 and len(writes) < 60


def test_price_movement_looks_days_up(spark):
    """Events are neither spread over days nor shuffled: each one, a repeated one too, looks its day up."""
    bars = spark.createDataFrame([(DAY + dt.timedelta(i), float(i)) for i in range(0, 60, 3)], "date date, close double")
    events = spark.createDataFrame([(i, DAY + dt.timedelta(i % 50)) for i in [*range(200), 7]], "event long, date date")
    found = B.price_movement(events, bars, horizon=7)
    rows = found.collect()
    assert len(rows) == 201 and all((r.start_price, r.end_price) == (r.event % 50 // 3 * 3, -(-(r.event % 50 + 7) // 3) * 3) for r in rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_forest_uses_all_cores(spark, monkeypatch):
    """A table in one file is one partition, and a tree learner would pass over it in one task."""
    from brindle.plans import modelling

    seen = []
    monkeypatch.setattr(M, "Pipeline", lambda stages: type("P", (), {"fit": lambda self, df: seen.append(df.rdd.getNumPartitions())})())
    one = spark.createDataFrame([(float(i % 7), float(i)) for i in range(50)], "x double, target double").coalesce(1)
    M.fit(one, ("x",))
    assert seen[0] >= spark.sparkContext.defaultParallelism
    assert modelling.rows(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_trees_grow_on_sums_of_equal_rows(spark, monkeypatch, tmp_path):
    """What a learner passes over is as many rows as there are different features, and it learns what it learns from the rows themselves."""
    rng = random.Random(5)
    rows = [(float(rng.randrange(4)), float(rng.randrange(3))) for _ in range(3000)]
    df = spark.createDataFrame([(a, b, 10 * a + 3 * b * b + rng.gauss(0, 5)) for a, b in rows], "a double, b double, target double")
    drawn = {r.a * 10 + r.b: r for r in M.drawn(df.repartition(3), ("a", "b"), trees=20).collect()}
    assert len(drawn) == 12 and drawn == {r.a * 10 + r.b: r for r in M.drawn(df.repartition(5, "target"), ("a", "b"), trees=20).collect()}
    assert all(abs(sum(r[f"w{t}"] for r in drawn.values()) - 3000) < 6 * 3000**0.5 for t in range(20))
    assert len({sum(r[f"w{t}"] for r in drawn.values()) for t in range(20)}) > 10

    monkeypatch.setattr(M, "regressor", lambda kind: M.RandomForestRegressor(numTrees=25, maxDepth=6, seed=1, labelCol="target", featureSubsetStrategy="all") if kind == "forest" else M.GBTRegressor(maxIter=5, maxDepth=3, seed=1, labelCol="target"))
    plain = lambda kind: M.Pipeline(stages=[M.VectorAssembler(inputCols=["a", "b"], outputCol="features"), M.regressor(kind)]).fit(df)
    said = lambda model: {(r.a, r.b): r.prediction for r in model.transform(df.select("a", "b").distinct()).collect()}
    seen = []
    monkeypatch.setattr(M, "dealt", lambda x: seen.append(x.count()) or x)
    boosted, forest = M.fit(df, ("a", "b"), kind="boosted"), M.fit(df, ("a", "b"))
    assert seen == [12]
    one, other = said(boosted), said(plain("boosted"))
    assert all(one[k] == pytest.approx(other[k], rel=1e-9) for k in one) and len(one) == 12
    one, other = said(forest), said(plain("forest"))
    assert forest.stages[-1].getNumTrees == 25 and all(one[k] == pytest.approx(other[k], abs=1.5) for k in one)
    asked = M.predicted(forest, df.filter("a < 3"), ("a", "b")).collect()
    assert len(asked) == sum(a < 3 for a, _ in rows) and all(r.prediction == one[r.a, r.b] for r in asked)
    M.save(forest, str(tmp_path / "model"))
    assert said(M.load(str(tmp_path / "model"))) == one and sum(forest.stages[-1].featureImportances.toArray()) == pytest.approx(1)


@pytest.mark.parametrize("terms", [3, 40])
def test_tfidf_without_a_table_of_terms(spark, monkeypatch, terms):
    """Weights as counting all terms gives them, with counters that many terms share; rows of one key are one document, without pairs between them."""
    from collections import Counter
    from math import log

    from brindle.operators import topics as T

    monkeypatch.setattr(T, "COUNTERS", 1)
    monkeypatch.setattr(T, "HELD", 5)
    rng = random.Random(4)
    rows = [(i % 110, " ".join(rng.choice(["Été", "the", "x", "Straße", "a_1", "二三", *[f"w{int(rng.paretovariate(0.7))}" for _ in range(3)]]) for _ in range(rng.randrange(12)))) for i in range(120)] + [(200, None)]
    whole, taken = {}, []
    monkeypatch.setattr(T, "stored", lambda df, name: taken.append((name, df.columns)) or df)
    for key, text in rows:
        words = [w for w in (text or "").lower().split(" ") if len(w) > 1 and w != "the"]
        whole.setdefault(key, Counter()).update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df, tf = Counter(t for c in whole.values() for t in c), sum(whole.values(), Counter())
    kept = sorted((t for t in tf if 2 <= df[t] <= 0.5 * len(rows)), key=lambda t: (-tf[t], t.encode()))[:terms]
    want = {}
    for key, c in whole.items():
        raw = {t: c[t] * (log((len(rows) + 1) / (df[t] + 1)) + 1) for t in kept if c[t]}
        want |= {(key, t): v / sum(x * x for x in raw.values()) ** 0.5 for t, v in raw.items()}
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = T.tfidf(docs, key="id", text="text", stop=("the",), most=0.5, terms=terms)
    assert got.columns == ["id", "term", "weight"] and {(r.id, r.term): r.weight for r in got.collect()} == pytest.approx(want, rel=1e-9)
    only = spark.createDataFrame([(5,), (7,), (7,)], "id long")
    got = T.tfidf(docs, key="id", text="text", stop=("the",), most=0.5, terms=terms, only=only).collect()
    assert {(r.id, r.term): r.weight for r in got} == pytest.approx({k: v for k, v in want.items() if k[0] in (5, 7)}, rel=1e-9)
    assert all("term" not in columns for _, columns in taken)


@pytest.mark.parametrize("slab, numbers", [(1 << 19, 1 << 62), (7, 1 << 62), (1 << 19, 3), (7, 1)])
def test_words_of_a_slab_as_one_by_one(monkeypatch, slab, numbers):
    """Words, pairs and counts as a pattern finds them text by text, in small slabs and where words share their number."""
    import re
    from collections import Counter

    import pyarrow as pa

    from brindle.operators import words as W

    own = W._numbers
    monkeypatch.setattr(W, "SLAB", slab)
    monkeypatch.setattr(W, "_numbers", lambda *a: own(*a) % np.uint64(numbers))
    monkeypatch.setattr(W, "_stopped", W.Terms)
    rng = random.Random(3)
    some = ["the", "x", "été", "straße", "a_1", "二三", "b²c", "٣٤", "x\u0301y", "\U0001d400\U0001d401", "w" * 3000, *(f"w{i}" for i in range(9))]
    rows = [["".join(rng.choice(some) + rng.choice(" ,\n—") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(3))] for _ in range(40)]
    want = {g: [Counter() for _ in rows] for g in (1, 2)}
    for r, texts in enumerate(rows):
        for t in texts:
            w = [x for x in re.findall(r"\w{2,}", t) if x not in ("the", "w3")]
            want[1][r].update(w)
            want[2][r].update(f"{a} {b}" for a, b in zip(w, w[1:]))
    for g in (1, 2):
        tf, df, met = Counter(), Counter(), Counter()
        looked = sorted(sum(want[g], Counter()))[::3] + ["never", "never there", "w3"]
        for texts, row in W.slabs(pa.array(rows, pa.list_(pa.string()))):
            c = W.cut(texts, ("the", "w3"))
            names, often, docs = W.counted(c, row, np.ones(8, bool), g)
            tf.update(dict(zip(names, often.tolist())))
            df.update(dict(zip(names, docs.tolist())))
            i, which = W.Terms(looked).found(c, g)
            met.update((row[c.text[a]], looked[b]) for a, b in zip(i.tolist(), which.tolist()))
        assert tf == sum(want[g], Counter()) and df == Counter(t for c in want[g] for t in c)
        assert met == Counter({(r, t): n for r, c in enumerate(want[g]) for t, n in c.items() if t in looked})


def test_words_are_cut_faster_than_one_by_one():
    """Cutting and numbering a slab takes less CPU time than a pattern and a filter take for its words."""
    import re
    import time

    from brindle.operators import topics as T
    from brindle.operators import words as W

    rng = random.Random(5)
    some = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 10))) for _ in range(30_000)] + list(T.STOP_WORDS) * 40
    texts = [" ".join(rng.choice(some) for _ in range(500)) for _ in range(150)]
    none = frozenset(T.STOP_WORDS)

    def plain():
        return [hash(w) for t in texts for w in re.findall(r"\w{2,}", t) if w not in none]

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: W.cut(texts, T.STOP_WORDS, 1)) < 0.7 * least(plain)


def test_characters_of_texts(spark):
    """Lengths and kinds as counting characters gives them, whatever the text; no text counts as an empty one."""
    from brindle.operators import words as W

    texts = ["", None, "aeiou, the; e\u0301t\u00e9", "\U0001d400.\U0001d401:", "x" * 70_000 + "a", "\x00a", "二三,"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {r.id: (r.n, *r.counts) for r in W.characters(docs, key="id", text="text", kinds=("aeiou", ",;:.")).collect()}
    assert got == {i: (len(t or ""), *(sum(c in kind for c in t or "") for kind in ("aeiou", ",;:."))) for i, t in enumerate(texts)}
    assert W.characters(docs.limit(0), key="id", text="text", kinds=("a",)).count() == 0


def test_factors_of_many_rows_are_solved_together():
    """As many steps for 2,000 rows as for one, and each row's result is that which it has alone."""
    from brindle.operators import factors as N

    class Steps(np.ndarray):
        n = 0

        def __getitem__(self, at):
            Steps.n += 1
            return super().__getitem__(at)

    rng = np.random.default_rng(2)
    h = rng.random((8, 60)) * (rng.random((8, 60)) < 0.4)
    t, g = (rng.random((2000, 60)) * (rng.random((2000, 60)) < 0.3)) @ h.T, (h @ h.T).view(Steps)
    whole = N.descend(t, g, np.zeros_like(t), 0.05, 0.05, 40, 1e-4)
    steps, Steps.n = Steps.n, 0
    alone = np.concatenate([N.descend(t[i : i + 1], g, np.zeros((1, 8)), 0.05, 0.05, 40, 1e-4) for i in range(0, 2000, 50)])
    assert np.allclose(whole[::50], alone, atol=1e-12)
    assert steps < Steps.n / 10


def test_topics_read_the_texts_twice(spark, monkeypatch):
    """Texts are cut into words once and not for each iteration; shares of some documents are those that they have among all."""
    cut = spark.sparkContext.accumulator(0)
    words = F.udf(lambda t: cut.add(1) or t.split(" "), "array<string>").asNondeterministic()
    monkeypatch.setattr(M, "words_of", words)
    docs = spark.createDataFrame([(i, "red ring blue stone" if i % 2 else "fast train slow boat") for i in range(40)], "id long, description string")
    shares, _ = M.lda_topics(docs, key="id", text="description", k=2, iterations=8)
    whole = {(r.id, r.topic): r.share for r in shares.collect()}
    assert cut.value <= 80
    some, _ = M.lda_topics(docs, key="id", text="description", k=2, iterations=8, only=docs.filter("id < 5"))
    assert {(r.id, r.topic) for r in some.collect()} == {k for k in whole if k[0] < 5}


def test_style_cuts_a_text_once(spark):
    """Sixteen features, and one cut into words and two into sentences and their words."""
    from brindle.operators import topics as T

    docs = spark.createDataFrame([(1, "I can. You can't go!  Ab 12"), (2, None), (3, "")], "id long, text string")
    got = T.with_style(docs, key="id", text="text")
    assert sorted(got.collect()) == sorted(docs.select("id", *T.style_features(F.col("text"))).collect())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 3


def test_prior_events_of_small_companies_shuffle_little(spark, monkeypatch):
    """Companies of few events are put together once; only what is left is looked up by days and kinds."""
    taken = []
    monkeypatch.setattr(R, "stored", lambda df, name: taken.append(name) or df)
    rows = [(n, f"c{n // 5}", DAY + dt.timedelta(n % 5), [f"k{n}"], ["fare"], "tax") for n in range(100)]
    found = R.prior_events(spark.createDataFrame(rows, "name long, company string, date date, categories array<string>, tokens array<string>, theme string"))
    assert taken == ["events", "crowded"]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3
    got = {}
    for r in found.collect():
        got.setdefault(r.name, []).append(r.prior)
    assert got == {n: [n - 1 - i for i in range(min(3, n % 5))] for n in range(100) if n % 5}


def test_lines_are_dealt_by_order_once(spark, monkeypatch):
    """A task sums a bounded number of lines however many there are, in one pass over them."""
    from brindle import plans
    from brindle.plans import views as V

    monkeypatch.setattr(V, "LINES", 100)
    lines = V.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    found = plans.QUERIES["Q26_factor_features"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == -(-lines // 100) > spark.sparkContext.defaultParallelism
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_factor_features_without_documents(spark):
    """The documents are those of the factors, with zeros where no factor is known."""
    rows = [(1, "fx", "positive", "primary", True, 0.5), (1, "fx", "negative", "other", False, 0.5), (2, None, "positive", "primary", True, 0.5), (None, "fx", "positive", "primary", False, 1.0)]
    f = spark.createDataFrame(rows, "id int, canonical string, direction string, centrality string, causal boolean, confidence double")
    got = {r.id: (r.fx__pos, r.fx__neg, r.fx__causal) for r in E.factor_features(None, f, "id", names=("fx",)).collect()}
    assert got == {1: (0.5, 0.25, 0.5), 2: (0.0, 0.0, 0.0), None: (1.0, 0.0, 0.0)}


def test_forests_of_folds_grow_together(spark, monkeypatch):
    """All folds are drawn in one pass, and each forest sees the draws of its own folds alone."""
    rng = random.Random(6)
    rows = [(i % 4, float(rng.randrange(4)), float(rng.randrange(3)), rng.gauss(0, 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, target double").withColumn("target", F.col("target") + 10 * F.col("a") + 50 * (F.col("fold") == 3).cast("int"))
    forests = {1: [0, 2, 3], 2: [0, 1, 3], 3: [0, 1, 2], 9: [0, 1, 2, 3]}
    got = {(r.forest, r.a, r.b): r for r in M.drawn(df.repartition(3), ("a", "b"), trees=5, forests=forests).collect()}
    again = {(r.forest, r.a, r.b): r for r in M.drawn(df.repartition(5), ("a", "b"), trees=5, forests=forests).collect()}
    assert got == again and len(got) == 4 * 12
    for a, b in {(a, b) for _, a, b, _ in rows}:
        w = {f: got[f, a, b].w3 for f in forests}
        assert w[1] + w[2] + w[3] <= 3 * w[9] and got[3, a, b].y3 < 10 * a + 5 < got[9, a, b].y3
        only = [w[9] - w[f] for f in (1, 2, 3)]
        assert all(x > 0 for x in only) and sum(only) < w[9]
    calls, own = [], M.drawn
    monkeypatch.setattr(M, "drawn", lambda *x, **k: calls.append(1) or own(*x, **k))
    monkeypatch.setattr(M, "regressor", lambda kind: M.RandomForestRegressor(numTrees=8, maxDepth=5, seed=1, labelCol="target", featureSubsetStrategy="all"))
    for expanding in (False, True):
        found = {r.fold: r for r in M.cross_validated(df, ("a", "b"), expanding=expanding).collect()}
        assert len(calls) == 1 + expanding and set(found) == {1, 2, 3}
        assert 45 < found[3].rmse < 55 and (found[2].rmse < 3) == expanding  # the third fold's targets lie 50 higher, and only later folds may not know


def test_nearest_information_reads_no_frame_to_the_end(spark, monkeypatch):
    """A frame from a row to the end of its range is the square of the range; only the one over a row for each range is left."""
    from brindle.operators import information as I

    spaced = spark.createDataFrame([("a", float(i), 1, 9, 3, 1.0) for i in range(9)], "label string, value double, n long, size long, k int, d double")
    monkeypatch.setattr(I, "stored", lambda df, name: df.localCheckpoint())
    found = I._with_neighbours(spaced, spaced.select("value", "n"))
    assert {r.value: r.m for r in found.collect()} == {float(i): 1 for i in range(9)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unboundedfollowing$()") == 1


def test_component_confidence_scores_texts_once(spark, monkeypatch):
    """Scores and tails are made once, as each of them reads all texts."""
    from brindle import plans
    from brindle.plans import labelling as L

    taken, own = [], L.S.stored
    monkeypatch.setattr(L.S, "stored", lambda df, name: taken.append(name) or own(df, name))
    assert plans.QUERIES["M11_component_confidence"](spark, "/root/testdata/sf0.001").count() == 3
    assert taken == ["scores", "tails", "keywords"]


def test_models_to_choose_from_grow_beside_each_other(spark, monkeypatch):
    """Each kind waits until the other has begun."""
    import threading

    from brindle.plans import modelling as P

    both = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(P, "rows", lambda spark, d: spark.createDataFrame([(1.0,)], "target double"))
    monkeypatch.setattr(P, "forest", lambda spark, d: both.wait() * 0 + 1.0)
    monkeypatch.setattr(P.M, "fit", lambda r, features, kind: both.wait() * 0 + 2.0)
    monkeypatch.setattr(P.M, "predicted", lambda m, r, features: r.withColumn("prediction", F.lit(m)))
    assert {r.model: r.mae for r in P.m26(spark, "").collect()} == {"forest": 0, "boosted": 1}


def test_tiles_without_a_block(spark, monkeypatch):
    """Blocks are dealt to tiles by hash, which may leave a tile without any: what would meet it is no pair of a tile with itself."""
    for name, n in (("BLOCK", 8), ("TILE", 8), ("PIVOTS", 2)):
        monkeypatch.setattr(S, name, n)
    v = vectors_of(100, 8)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(100)], "id long, vector array<double>")
    blocks = S._blocks(df, F.lit(0), "id", "vector", None)
    assert S._tiles(blocks)[0].select("tile").distinct().count() < 13  # ceil(100 / 8)
    rows = S.similar_pairs(df, threshold=0.3, band=F.lit(0), key="id").collect()
    assert sorted((r.a, r.b) for r in rows) == [(i, j) for i in range(100) for j in range(i + 1, 100) if v[i] @ v[j] > 0.3]
    c = np.round(v @ v.T, 6)
    got = S.top_similar(df, df, k=3).collect()
    assert {(r["query"], r["rank"]): r["id"] for r in got} == {(q, n + 1): i for q in range(100) for n, i in enumerate(sorted((i for i in range(100) if i != q), key=lambda i: (-c[q, i], i))[:3])}


def test_similarities_are_rounded_like_sql(spark):
    import duckdb

    values = [n / 1000 + 0.0005 for n in range(-1000, 1000)]
    df = spark.createDataFrame([(n, n, v, 1) for n, v in enumerate(values)], "query long, id long, similarity double, rank int")
    got = S.default_prediction(df.select(F.col("query").alias("id")), df, df.select("id", F.lit("x").alias("label")))
    sql = duckdb.sql("select n || ':' || cast(round(v, 3) as varchar) from (select unnest(range(2000)) as n, (n - 1000) / 1000 + 0.0005 as v)").fetchall()
    assert sorted(r.neighbours for r in got.collect()) == sorted(r[0] for r in sql)
    x = np.array([0.5, 1.5, 2.5, -0.5, -2.5, 0.4999999, 0.49999999999999994])
    assert S._rounded(x, 0).tolist() == [1.0, 2.0, 3.0, -1.0, -3.0, 0.0, 0.0]


def test_prior_events_by_subsets_of_words(spark, monkeypatch):
    """A company of many frequent words: both ways as every pair, and subsets ask for few."""
    monkeypatch.setattr(R, "RARE", 2)
    rng, rows = random.Random(7), []
    for n in range(500):
        day = DAY - dt.timedelta(rng.choice([rng.randrange(8), 730, 731, 1216, 1217, rng.randrange(3000)]))
        company = "hot" if n % 3 else rng.choice(["few", "all"])
        more = [f"w{rng.randrange(60)}", rng.choice("abc"), "the"] if company != "all" else ["fare"]
        words = rng.choice([more, more, more + [f"v{n}"], [*more, f"u{n % 40}"], [], None]) if company != "all" else more + rng.sample("abc", rng.randrange(3))
        rows.append((n, company, day, rng.choice([["x"], ["x", "y"], None]), words, rng.choice(["climate", "tax"])))
    schema = "name long, company string, date date, categories array<string>, tokens array<string>, theme string"
    events = spark.createDataFrame(rows, schema)
    a, b = events.withColumn("year", F.year("date")), events.select("company", *[F.col(x).alias(f"p_{x}") for x in events.columns if x != "company"])
    pairs, own = R.theme_priority(a.join(b, "company").filter("p_date < date"), theme_col="p_theme"), R.theme_priority
    every = {}
    for r in pairs.select("name", F.col("p_name").alias("prior"), R._score(F.col("categories"), F.col("tokens"))).collect():
        every.setdefault(r[0], []).append((-r[2], r[1]))
    wanted = sorted((name, prior, -s, i + 1) for name, found in every.items() for i, (s, prior) in enumerate(sorted(found)[:3]))
    scored = []
    monkeypatch.setattr(R, "theme_priority", lambda df, **k: scored.append(df) or own(df, **k))
    for dearer in (0, 2, 1e9):
        monkeypatch.setattr(R, "DEARER", dearer, raising=False)
        assert sorted(tuple(r) for r in R.prior_events(events).collect()) == wanted
    assert 2 * scored[1].filter("company = 'hot'").count() < scored[-2].filter("company = 'hot'").count()


def test_factor_passes_ship_the_topics_once(spark, monkeypatch):
    """What a pass hands to its tasks is one matrix of topics, without the names of the terms; numbers of either width are added alike."""
    from pyspark import cloudpickle

    from brindle.operators import factors as N

    sizes, own = [], N._sums
    monkeypatch.setattr(N, "_sums", lambda rows, n, k, left, extra: sizes.append(len(cloudpickle.dumps(left))) or own(rows, n, k, left, extra))
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(sorted(rng.choice(900, 30, replace=False).tolist()), rng.random(30).tolist()) for _ in range(40)], "numbers array<int>, weights array<double>")
    found = N.fit(rows, [f"term{i}" for i in range(900)], k=8, passes=2)
    assert len(found.losses) == 2 and max(sizes[6:]) < 1.5 * 900 * 8 * 8
    terms, values, starts, r = rng.integers(900, size=300), rng.random(300), np.arange(0, 300, 30), rng.random((10, 8))
    narrow, wide = np.zeros((900, 8)), np.zeros((70_000, 8))
    N._add_turned(narrow, terms, values, starts, r)
    N._add_turned(wide, terms, values, starts, r)
    assert (narrow == wide[:900]).all() and not wide[900:].any()


@pytest.mark.parametrize("kind", ["near or far", "apart"])
def test_merging_without_a_table_of_pairs(spark, monkeypatch, kind):
    """Each event knows a few options; where all are taken they are looked for anew.  As the pass in order over every pair, in slices too."""
    from brindle.operators import components as C

    for module, name, n in ((S, "OPTIONS", 6), (S, "HELD", 300), (S, "BLOCK", 16), (S, "TILE", 32), (C, "MOST_EDGES", 400)):
        monkeypatch.setattr(module, name, n)
    n, v, asked, own = 160, vectors_of(160, 9), [], S.best_pairs
    v[20:24] = v[19]  # equal weights
    day = [None if i % 23 == 0 else i * 37 % 700 for i in range(n)]
    monkeypatch.setattr(S, "best_pairs", lambda *a, **k: asked.append(own(*a, **k)) or asked[-1])
    weigh, same = (S.near_or_far(near=0.2, far=0.35), lambda a, b: (a + b) % 5 != 0) if kind == "near or far" else (S.apart(least=0.2), None)
    df = spark.createDataFrame([(i, v[i].tolist(), None if day[i] is None else DAY + dt.timedelta(day[i])) for i in range(n)] + [(n, None, DAY)], "pos long, vector array<double>, date date")
    into = {}
    for a in range(n):
        options = []
        for b in range(a + 1, n):
            dot = float(np.cumsum(v[a] * v[b])[-1])
            days = np.nan if day[a] is None or day[b] is None else float(abs(day[a] - day[b]))
            weight = float(weigh(np.array([dot]), np.array([days]))[0]) if dot > 0.2 else np.nan
            if b not in into and not np.isnan(weight):
                options.append((-weight, b))
        if a not in into and options and (same is None or same(a, min(options)[1])):
            into[min(options)[1]] = a
    got = S.merged_similar(df, threshold=0.2, band=F.lit(0), weigh=weigh, same=same).collect()
    assert {r.pos: r.into for r in got} == {i: into.get(i, i) for i in range(n + 1)} and len(got) == n + 1
    assert len(asked) > 1 and all(o.count() <= 6 * n or o.agg(F.max("place")).first()[0] > 6 for o in asked)


def test_words_of_topics_are_counted_in_the_texts(spark, monkeypatch):
    """As the words that are cut one by one; no table of all words is made, and of equal words the first by name count."""
    docs = [(1, "Red ring, RED stone a"), (2, "red ring été blue"), (3, None), (4, "Été stone ring blue"), (4, "ring red_1 red_1 only"), (5, "ring")]
    df = spark.createDataFrame(docs, "id long, description string").repartition(2)
    monkeypatch.setattr(M, "words_of", None)
    rows, vocabulary = M._counted(df, key="id", text="description", terms=3)
    assert vocabulary == ["red", "blue", "stone"]  # ring is in five of six
    got = sorted((r.id, r.counts.toArray().tolist()) for r in rows.collect())
    assert got == [(1, [2.0, 0.0, 1.0]), (2, [1.0, 1.0, 0.0]), (3, [0.0] * 3), (4, [0.0] * 3), (4, [0.0, 1.0, 1.0]), (5, [0.0] * 3)]

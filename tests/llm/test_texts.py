"""Fingerprints, near-duplicates, mixing, quality, toxicity, URLs and neighbours."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import _components, _shingles, fingerprints, mixing, near_dedup, neighbours, quality, toxicity, url_filter

from .conftest import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("width", [1, 2, 5])
def test_shingle_sets(width):
    sets = list(_shingles.shingle_sets(pa.array(TEXTS), width))
    assert [len(s) for s in sets] == [len(shingles(t, width)) for t in TEXTS]
    for a, x in zip(sets, TEXTS, strict=True):
        for b, y in zip(sets, TEXTS, strict=True):
            assert len(np.intersect1d(a, b)) == len(shingles(x, width) & shingles(y, width))


def test_shingles_do_not_depend_on_the_chunk(monkeypatch):
    whole = [s.tolist() for s in _shingles.shingle_sets(pa.array(TEXTS), 2)]
    monkeypatch.setattr(_shingles.chunks, "__defaults__", (5,))
    assert [s.tolist() for s in _shingles.shingle_sets(pa.array(TEXTS), 2)] == whole
    assert [s.tolist() for s in _shingles.shingle_sets(pa.array(["cut", *TEXTS, "off"]).slice(1, len(TEXTS)), 2)] == whole


def test_edit_report(odd_docs):
    rows = {r.doc_id: r for r in fingerprints.edit_report(odd_docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        text, after = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(rows[i].near_edited - jaccard(shingles(text, 5), shingles(edited, 5))) < 0.2
        assert abs(rows[i].near_next - jaccard(shingles(text, 5), shingles(after, 5))) < 0.2
    assert rows[4].fingerprint == rows[5].fingerprint and len({len(r.fingerprint) for r in rows.values()}) == 1


def test_edit_report_of_one_and_of_none(spark, no_docs):
    one = fingerprints.edit_report(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.edited_sha256) for r in one] == [(3, hashlib.sha256(b"abcabc").hexdigest())]
    assert fingerprints.edit_report(no_docs).count() == 0


def test_fingerprints_estimate_similarity():
    rng = random.Random(1)
    errors = []
    for share in np.linspace(0, 1, 40):
        a = [str(rng.random()) for _ in range(400)]
        b = [w if rng.random() < share else str(rng.random()) for w in a]
        x, y = fingerprints._prints([" ".join(a), " ".join(b)], 1)
        errors.append(x.like(y) - jaccard(set(a), set(b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def brute_components(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            for j in texts:
                if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label, sets


def family(rng, n, words, edits):
    """Copies of a text with a few words changed in each."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_as_brute_force(spark, monkeypatch, block):
    """A small block makes regions and families be cut, so that links cross the cuts."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(7)
    texts = [*TEXTS, *family(rng, 60, 80, 12), *family(rng, 40, 60, 6), *family(rng, 20, 30, 1), *family(rng, 30, 50, 40)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    texts = dict(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, region string, size long")
    rows = {r.doc_id: r for r in near_dedup.near_duplicates(docs, width=2, percent=80).collect()}
    label, sets = brute_components(texts, 2, 80)
    assert {i: rows[i].component_id for i in rows} == label
    assert all(rows[i].n_shingles == len(sets[i]) and rows[i].kept == (label[i] == i) for i in texts)


def test_near_duplicates_of_repeated_and_missing_ids(spark, no_docs):
    docs = spark.createDataFrame([(2, "a b c"), (1, "a b c"), (2, "d e f"), (3, "d e f"), (None, "a b c"), (None, None)], "doc_id long, text string")
    rows = near_dedup.near_duplicates(docs, width=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id) == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False)]
    assert [r.kept for r in rows if r.doc_id is None] == [True, True]
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_deduplicated_keeps_the_columns(odd_docs):
    kept = near_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(TEXTS))) - {5, 13}


def test_deduplicated_keeps_one_row_of_a_component_whatever_the_ids(spark):
    a, b, c, d = ("one two three four five six", "red blue green pink grey gold", "sun moon star sky rain wind", "cat dog cow hen pig ram")
    rows = [(5, a, "p"), (1, a, "q"), (1, a, "r"), (None, a, "s"), (None, b, "t"), (None, b, "u"), (2, c, "v"), (2, d, "w"), (None, None, "x"), (None, "", "y")]
    kept = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, _row string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (0, b), (2, c), (2, d), (0, ""), (0, "")])


def test_components_of_a_path_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    got = {r.node: r.component for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in range(100, 120)}}
    assert _components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("order", ["ascending", "mixed"])
def test_components_of_a_long_path_in_few_rounds(spark, monkeypatch, order):
    n = 10_000
    names = list(range(n))
    if order == "mixed":
        random.Random(3).shuffle(names)
    steps, kept = [], _components.written
    monkeypatch.setattr(_components, "written", lambda df, name: steps.append(name) or kept(df, name))
    edges = spark.createDataFrame([(names[i], names[i + 1]) for i in range(n - 1)], "a long, b long").repartition(4)
    found = _components.components(edges)
    assert found.count() == n and found.agg(F.max("component")).first()[0] == 0
    assert steps.count("jumped") <= 20 or order == "mixed" and steps.count("moved") <= 20


def water_fill(sizes, weights, share, epochs):
    target, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while open_ and left > 1e-9:
        per = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * per >= epochs * sizes[s] - 1e-12}
        if not over:
            return target | {s: weights[s] * per for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), rng.choice("aaaaaaaabbbbccde" + "Z") if i % 50 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.repetitions(docs).toPandas()
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    goal = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    taken = {}
    for r in got.itertuples():
        s = source[r.doc_id]
        assert abs(r.target - goal[s]) < 1e-6 * goal[s] and r.source_size == sizes[s] and r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - goal[s]) < 0.03 * goal[s] + 60 for s in goal)
    again = mixing.repetitions(docs.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_mixed_takes_rows_with_repeated_and_missing_ids(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "one two three four", "s", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tag int").repartition(3)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = {i: 0 for i in range(300)}
    for r in out.collect():
        assert (r.doc_id, r.text, r.source, r.tag) == rows[r.tag]
        copies[r.tag] += 1
    assert set(copies.values()) == {1, 2} and abs(sum(copies.values()) - 450) <= 1


def test_mixing_of_odd_and_no_texts(odd_docs, no_docs):
    rows = {r.doc_id: r for r in mixing.repetitions(odd_docs).collect()}
    assert [rows[i]["size"] for i in range(len(TEXTS))] == [len(WORD.findall(t or "")) for t in TEXTS]
    assert mixing.mixed(odd_docs).columns == odd_docs.columns and mixing.repetitions(no_docs).count() == 0


def test_mixing_as_its_sql(spark, sf_dir):
    from tests.compare import connect, rows_of, rows_of_sql

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(mixing.repetitions(docs).drop("times", "key")) == rows_of_sql(connect(sf_dir), mixing.ORACLE_SQL)


def labelled(spark, n=400):
    rng = random.Random(4)
    good, bad = [f"{a}{b}" for a in ("tion", "re", "an", "on") for b in ("al", "er", "ing")], ["$$$", "###", "!!!", "%%%"]
    rows, labels = [], []
    for i in range(n):
        junk, toxic = i % 5 == 0, i % 4 == 1
        w = [rng.choice(good) + (rng.choice(bad) if junk else "") for _ in range(rng.randrange(20, 60))]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(("scum", "moronic", "moron"))
        rows.append((i, " ".join(w), "ab"[i % 2], "s", 1.0, True))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, kept boolean"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    rows = quality.resampling(docs, labels).join(labels, "doc_id").collect()
    assert all(r.kept == bool(r.quality) for r in rows)
    kept = quality.resampled(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 320


def test_quality_of_odd_texts_and_without_labels(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id for r in quality.resampling(odd_docs, none).filter("not kept").collect()} == {0, 1}
    nulls = spark.createDataFrame([(None, 1), (3, None), (12, 1), (12, 1), (10, 0)], "doc_id long, quality int")
    assert quality.resampling(odd_docs, nulls).count() == len(TEXTS)
    assert quality.resampling(no_docs, none).count() == 0


def test_quality_as_brute_force(spark):
    """Weights, keys and the draw from plain counts of hashed n-grams."""
    docs, labels = labelled(spark, 120)
    rows, good = docs.collect(), {r.doc_id for r in labels.filter("quality = 1").collect()}
    mask = (1 << 64) - 1

    def mix(h):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * factor & mask
        return h ^ h >> 33

    def slots(text):
        raw, words = text.encode(), WORD.findall(text.translate(LOWER))
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                h = 0
                for c in raw[i : i + n]:
                    h = (h * 0x100000001B3 + c + 1) & mask
                yield 0, mix(h + n) % quality.SLOTS
        yield from ((1, int(a == b)) for a, b in zip(words, words[1:]))

    def model(texts):
        counts = [np.full(quality.SLOTS, 0.5), np.full(2, 0.5)]
        for t in texts:
            for kind, slot in slots(t):
                counts[kind][slot] += 1
        return [np.log(c / c.sum()) for c in counts]

    raw, target = model([r.text for r in rows]), model([r.text for r in rows if r.doc_id in good])
    want = {r.doc_id: np.mean([target[k][x] - raw[k][x] for k, x in slots(r.text)]) for r in rows}
    got = quality.resampling(docs, labels).collect()
    assert all(abs(r.weight - want[r.doc_id]) < 1e-5 for r in got)
    k = sum(r.kept for r in got)
    assert 0 < k < 120 and {r.doc_id for r in got if r.kept} == {r.doc_id for r in sorted(got, key=lambda r: -r.key)[:k]}


def test_resampled_and_without_toxic_judge_rows_with_repeated_and_missing_ids(spark, no_docs):
    docs, labels = labelled(spark, 300)
    none, shared = (docs.withColumn("new", F.lit(x).cast("long")) for x in (None, 5000))
    more = none.unionByName(shared).drop("doc_id").withColumnRenamed("new", "doc_id").select(docs.columns)
    both = docs.union(more).withColumn("a.b", F.lit(1)).withColumn("_row", F.lit("x")).withColumn("_gone", F.lit(0))
    junk, toxic = r"[$#!%]{3}", "scum|moron"
    for kept, bad in ((quality.resampled(both, labels), junk), (toxicity.without_toxic(both, labels), toxic)):
        assert kept.columns == both.columns
        rows = kept.collect()
        assert not [r for r in rows if re.search(bad, r.text)] and len(rows) == 3 * docs.filter(~F.col("text").rlike(bad)).count()
    assert quality.resampled(no_docs, labels).count() == 0 and toxicity.without_toxic(no_docs, labels).count() == 0


def test_mixed_and_deduplicated_with_clashing_names(spark, no_docs):
    rows = [(i, f"w{i} a b c d e", "s", 1, "x", 2.0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copy int, `a.b` string, _row double")
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == 60
    assert near_dedup.deduplicated(docs).columns == docs.columns and near_dedup.deduplicated(docs).count() == 40
    assert mixing.mixed(no_docs).count() == 0 and near_dedup.deduplicated(no_docs).count() == 0


def test_gumbel_draw_takes_k(spark):
    rows = spark.createDataFrame([(float(i % 97), 1.0 if i % 3 else -1.0) for i in range(1000)], "key double, weight double")
    least = quality._draw(rows, 0.0)
    k = rows.filter("weight >= 0").count()
    over, more = rows.filter(F.col("key") > least + 1e-6).count(), rows.filter(F.col("key") >= least).count()
    assert over <= k <= more  # ties of the key are all kept


def test_toxicity(spark):
    docs, labels = labelled(spark, 900)
    rows = toxicity.held_out_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) == sum(1 for r in rows if toxicity_third(r.doc_id)) and all(toxicity_third(r.doc_id) for r in held)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 640 <= kept.count() <= 710


def toxicity_third(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_toxicity_of_odd_texts_and_without_labels(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.held_out_scores(odd_docs, none).collect()} == {0.0}
    docs, labels = labelled(spark, 300)
    rows = toxicity.held_out_scores(docs.select("doc_id", "text").union(odd_docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text")), labels).collect()
    assert len(rows) == 300 + len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.held_out_scores(no_docs, none).count() == 0


def test_toxicity_of_few_toxic_labels(spark):
    """The toxic ones are at no place that every fifth document by id would hold back."""
    docs, labels = labelled(spark, 400)
    toxic = F.col("doc_id").isin(*range(1, 24 * 16, 16))
    docs = docs.withColumn("text", F.when(toxic, F.concat("text", F.lit(" scum"))).otherwise(F.regexp_replace("text", "scum|moronic|moron", "tional")))
    for ids in ([1, 33, 97, 129], [1, 17], [17]):
        some = labels.filter(~toxic | F.col("doc_id").isin(*ids)).withColumn("toxic", toxic.cast("int"))
        places = [i for i, r in enumerate(some.select("doc_id").sort("doc_id").collect()) if r.doc_id in ids]
        assert any(p % toxicity.HOLD for p in places)
        net, cuts = toxicity.fit(docs, some)
        rows = toxicity.with_score(docs, net).withColumn("toxic", toxic).collect()
        assert not net.empty and set(cuts) == {None}
        assert np.mean([r.score for r in rows if r.doc_id in ids]) > np.mean([r.score for r in rows if not r.toxic])


def test_thresholds_by_language():
    p, y = np.array([0.1, 0.2, 0.8, 0.9] * 10), np.array([0, 0, 1, 1] * 10)
    cuts = toxicity.thresholds(np.concatenate([p, p / 2]), np.concatenate([y, y]), ["a"] * 40 + ["b"] * 40)
    assert cuts["a"] == pytest.approx(0.5) and cuts["b"] == pytest.approx(0.25) and None in cuts


URLS = [None, "", "no scheme", "http://ORG/x", "https://a.b.org/y?z", "http://example.org/es/1", "http://sub.example.org/es", "http://example.org/en/1", "http://example.org/en/2", "http://forg/x", "ftp://x.com/fr/", "x://y.com/de/q#f", "http://com?x", "a://b://c.com/de/", "http://org", "http://ü.org/ß"]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", True) for i, u in enumerate(URLS)], "page_id long, url string, html string, rule boolean")
    rows = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute_rule(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == verdict or verdict is None and rows[i].verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [3, 4096])
def test_url_scores_as_brute_force(spark, monkeypatch, chunk):
    """Scores and verdicts from plain counts of contexts, with repeated rows, missing ids and a very long url."""
    monkeypatch.setattr(url_filter, "CHUNK_URLS", chunk)
    urls = [f"http://{h}/{p}" for h in ("a.good", "b.good", "x.bad", "y.bad", "q.net", "z.net") for p in ("", "article/1", "casino", "article/22", "ü")]
    urls += ["http://a.good/" + "long/" * 2_000, "http://q.net/" + "long/" * 2_000, "http://x.bad/casino", "http://x.bad/casino", None, ""]
    rules = (("allow", "good", "/"), ("block", "bad", "/"))
    pages = spark.createDataFrame([(i if i % 7 else None, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)

    def signs(url):
        s = [1] * url_filter.ORDER + [c + 2 for c in (url or "").encode()] + [0]
        return [(tuple(s[i - k : i]), s[i]) for i in range(url_filter.ORDER, len(s)) for k in range(url_filter.ORDER + 1)]

    counts = [{}, {}]
    for u in urls:
        import zlib

        host = (u or "").split("://")[-1].split("/")[0]
        kind = 0 if host.endswith(".good") else 1 if host.endswith(".bad") else None
        if kind is not None and zlib.crc32(u.encode()) % url_filter.CALIBRATE:
            for context, sign in signs(u):
                for key in ((context, sign), (context,)):
                    counts[kind][key] = counts[kind].get(key, 0) + 1

    def score(url):
        logs, n = [0.0, 0.0], len((url or "").encode()) + 1
        for kind in (0, 1):
            p = 1 / 257
            for context, sign in signs(url):
                p = 1 / 257 if not context else p
                p = (counts[kind].get((context, sign), 0) + url_filter.STRENGTH * p) / (counts[kind].get((context,), 0) + url_filter.STRENGTH)
                if len(context) == url_filter.ORDER:
                    logs[kind] += np.log(p)
        return (logs[0] - logs[1]) / n if url else 0.0

    rows = url_filter.judge(pages, rules=rules).collect()
    assert len(rows) == len(urls)
    assert sorted(r.score for r in rows) == pytest.approx(sorted(score(u) for u in urls), abs=1e-9)
    free = [r for r in rows if r.rule is None]
    assert max([r.score for r in free if r.verdict == "block"], default=-9) < min([r.score for r in free if r.verdict == "allow"], default=9)


def test_language_models_tell_urls_apart(spark):
    rng = random.Random(5)
    bad = lambda: f"http://x{rng.randrange(99)}.net/casino-{rng.randrange(999)}"
    good = lambda: f"http://y{rng.randrange(99)}.net/article/{rng.randrange(999)}"
    known = [(bad().replace(".net", ".bad"), i) for i in range(200)] + [(good().replace(".net", ".good"), 200 + i) for i in range(200)]
    new = [(bad(), 400 + i) for i in range(100)] + [(good(), 500 + i) for i in range(100)]
    pages = spark.createDataFrame(known + new, "url string, page_id long")
    rows = url_filter.judge(pages, rules=(("block", "bad", "/"), ("allow", "good", "/"))).filter("page_id >= 400").collect()
    assert np.mean([(r.verdict == "block") == (r.page_id < 500) for r in rows]) > 0.95


@pytest.mark.parametrize("in_bucket", [24, 192])
def test_neighbours(spark, monkeypatch, in_bucket):
    monkeypatch.setattr(neighbours, "ROWS_IN_BUCKET", in_bucket)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [1.0, None] + [0.0] * 14, 1), (2060, [float("nan")] * 16, 1), (2080, [float("inf")] * 16, 1), (None, [1.0] * 16, 1), (2100, [], 1), (2120, [1.0, 2.0], 1), (2121, [3.0, 1.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, bucket int").repartition(5)
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=20).toPandas().sort_values(["query_id", "rank"])
    hits = total = 0
    for q in range(0, 1500, 20):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(1500), -score))[:20]
        own = got[got.query_id == q]
        assert own["rank"].tolist() == list(range(1, 21)) and (own.score.to_numpy() == score[own.vec_id.to_numpy()]).all()
        assert [tuple(t) for t in own[["score", "vec_id"]].to_numpy()] == sorted((tuple(t) for t in own[["score", "vec_id"]].to_numpy()), key=lambda t: (-t[0], t[1]))
        hits, total = hits + len(set(want) & set(own.vec_id)), total + 20
    assert hits / total >= 0.9
    assert set(got.query_id) == set(range(0, 1500, 20)) | {2120} and got[got.query_id == 2120][["vec_id", "score"]].to_numpy().tolist() == [[2121, 5.0]]


def test_few_and_no_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [0.0, -1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, -0.5), (20, 3, 2, -0.5)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_smallest_table_goes_through_the_index(spark, sf_dir):
    """500 vectors: several buckets in every table, and most of the true neighbours."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    _, entries, visits, _ = neighbours._candidates(v, F.col("vec_id") % 20 == 0, 20, 11, "vec_id", "embedding")
    assert entries.select("bucket").distinct().count() > neighbours.TABLES and visits.select("bucket").distinct().count() > neighbours.TABLES
    rows = v.select("vec_id", "embedding").toPandas()
    x, ids = np.array(rows.embedding.tolist(), np.float64), rows.vec_id.to_numpy()
    got = neighbours.search(v, F.col("vec_id") % 20 == 0).toPandas()
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(got[got.query_id == q].vec_id))
    assert len(got) == (ids % 20 == 0).sum() * 20 and hits / len(got) >= 0.9


def test_visits_are_packed_where_they_are_made(spark, sf_dir):
    """The queries that visit a bucket are one row for each batch and block of them, not one each."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").coalesce(1)
    _, entries, visits, _ = neighbours._candidates(v, F.col("vec_id") % 20 == 0, 20, 11, "vec_id", "embedding")
    assert visits.count() == visits.select("bucket").distinct().count() <= entries.select("bucket").distinct().count() + 8
    assert visits.select(F.explode("left.vec_id")).count() > 2 * visits.count()
    assert visits.select(F.max(F.size("left"))).first()[0] <= neighbours.QUERIES_IN_BLOCK


@pytest.fixture
def shared_ids(spark):
    """Rows without ids, with shared ids, and equal ones."""
    texts = ["a few words of text", "other words in a longer text than that", "one", None]
    rows = [(None if i % 3 == 0 else i % 7, texts[i * i % 4] if i % 5 else f"text number {i}", f"s{i % 2}", i // 9) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, more int")


def test_numbers_do_not_depend_on_partitions(spark, shared_ids):
    """What has no id of its own is drawn by its contents, however the rows are dealt."""
    from brindle.llm._common import keyed

    found = []
    for parts in (1, 3, 16):
        df = shared_ids.repartition(parts, "text") if parts > 1 else shared_ids.coalesce(1)
        rows, key = keyed(df, "doc_id")
        numbers = {r[key]: tuple(r)[:4] for r in rows.collect()}
        mix = sorted(map(repr, mixing.mixed(df).collect()))
        found.append((numbers, mix))
    assert len(found[0][0]) == 200 and found[0] == found[1] == found[2]


def test_draw_does_not_depend_on_partitions(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    found = [sorted(map(repr, quality.resampled(d, labels).collect())) for d in (docs.coalesce(1), docs.repartition(7))]
    assert found[0] == found[1] and 0 < len(found[0]) < docs.count()


def test_one_long_document_does_not_keep_others_from_being_learned(spark, sf_dir, monkeypatch):
    assert toxicity.fitting(np.array([50, 3, 4, 90, 2]), 10).tolist() == [1, 2, 4] and toxicity.fitting(np.array([50, 30, 40]), 10).tolist() == [1]
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(toxicity, "SLOT_BYTES", 20_000)
    rows = toxicity.held_out_scores(docs, labels).collect()
    assert len(rows) == docs.count() and len({r.score for r in rows}) > 10


def test_toxicity_scores_as_a_plain_pass(spark, sf_dir):
    """Scores from loops over words, filters and their widths; and held-out labels."""
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    net, _ = toxicity.fit(docs, labels, where=~toxicity.held_out(F.col("_labelled")))
    some = [r.text for r in docs.orderBy(F.length("text")).limit(40).collect()] + [None, "", "one"]
    got = {r.doc_id: r.score for r in toxicity.with_score(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), net).collect()}
    for i, text in enumerate(some):
        _, raw, offsets = next(iter(toxicity.chunks(pa.array([text], pa.string()))))
        slots, _ = toxicity.term_slots(raw, offsets)
        vectors = [sum(net.tables[k][slots[k, w]].astype(float) for k in range(len(slots))) for w in range(slots.shape[1])]
        total = net.out_bias
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = max(0.0, net.bias[k][f])  # what stands behind a text is zeros
                for start in range(len(vectors)):
                    value = net.bias[k][f] + sum(float(vectors[start + j] @ net.filters[k][j][:, f]) for j in range(width) if start + j < len(vectors))
                    best = max(best, value)
                total += best * net.out[k * toxicity.FILTERS + f]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(net.scale[0] * total + net.scale[1], -30, 30))), abs=1e-4)
    held = toxicity.held_out_scores(docs, labels).filter("held_out").join(labels.filter("toxic is not null"), "doc_id").toPandas()
    pos, neg = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert ((pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2) > 0.9

"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on full shingle sets.

1. Each document's set of distinct word shingles gives a digest, which finds equal sets, and a signature of MinHash
   values.  Only one document for each set goes on.
2. A tree orders the documents by its own rotation of the signature.  Documents that share the first DEPTH values of a
   rotation are a region.  A region is walked in order and cut where neighbours share the shortest prefix, so that dense
   regions are taken at a greater depth; inside a cut, neighbours whose signatures agree well enough are likely links.
3. Likely links make families.  The full sets of a family are compared in blocks; what passes the exact test is a link.
4. Where a region or a family was cut, a link may cross the cut.  It can only matter where the parts did not become one
   component by other links; so in such groups every member outside of the largest component is compared with all members,
   block by block.  No list of pairs is made at any point: a task emits links that join components, at most one for each
   member and component it meets.

Signature values of a pair agree with the probability of its similarity, J: a pair at the threshold shares a region in
at least one tree with probability 1 - (1 - 0.8 ** DEPTH) ** TREES = 0.999997.

Cases: a null or empty text has no shingles and is linked with nothing; a text of fewer words than a shingle is one
shingle; rows that share a doc_id are one document with all their links; rows without a doc_id are linked with nothing
and kept; no rows give no rows; further columns are not read.  Where rows are dropped, each row is a document, whatever its id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, column, few, keyed, named, ranges_for, written
from ._components import components
from ._shingles import shingle_sets

TREES, DEPTH = 32, 5
VALUES = TREES * DEPTH
#: Share of equal signature values from which two documents are a likely link: 4.7 standard deviations below 0.8.
LIKELY = 0.65
#: Documents that are compared with each other at once, and about the most bytes of shingles that they have.
BLOCK, BLOCK_BYTES = 256, 16 << 20

_RANDOM = np.random.default_rng(20240229)
_FACTOR = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    """The top 16 bits of each MinHash value, big-endian, so that binary order is the order of the values."""
    least = np.full(VALUES, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 2048):
        np.minimum(least, (_FACTOR[:, None] * shingles[None, k : k + 2048] + _SHIFT[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(48)).astype(">u2").tobytes()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest, sig): number of distinct shingles, a digest of the set and its signature, both null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sigs = [], [], []
            for shingles in shingle_sets(batch.column(1), width):
                n.append(len(shingles))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                sigs.append(signature(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n", "digest", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, sig binary")


def _alike(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Which of the signatures agree in LIKELY of their values at least."""
    x, y = (np.frombuffer(b"".join(s), ">u2").reshape(-1, VALUES) for s in (a, b))
    return np.stack([(row[None, :] == y).sum(axis=1) for row in x]) >= LIKELY * VALUES


def _overlapping(percent: int) -> Callable[[list[bytes], list[bytes]], np.ndarray]:
    """Which of the full sets meet the threshold: 100 * intersection >= percent * union, in whole numbers."""

    def test(a: list[bytes], b: list[bytes]) -> np.ndarray:
        left, right = ([np.frombuffer(s, np.uint64) for s in side] for side in (a, b))
        sizes = np.array([len(s) for s in right])
        flat = np.concatenate(right)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(right)), sizes)[order]
        out = np.empty((len(left), len(right)), bool)
        for k, s in enumerate(left):
            low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            n = high - low
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            both = np.bincount(owner[at], minlength=len(right))
            out[k] = 100 * both >= percent * (len(s) + sizes - both)
        return out

    return test


def _star(ids: list[int], linked: np.ndarray) -> list[tuple[int, int]]:
    """Links from the members of each component of a square of links to its smallest member."""
    label = np.array(ids)
    while True:
        least = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        least = np.minimum(least, label)
        if (least == label).all():
            return [(i, int(x)) for i, x in zip(ids, label, strict=True) if i != x]
        label = least


def _cut_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks (region, members, label, doc_id, sig) in order: likely links inside each cut, and the regions that were cut."""
    region, members = None, 0
    ids: list[int] = []
    sigs: list[bytes] = []
    labels: list[bytes] = []

    def done(n: int):
        nonlocal ids, sigs, labels
        links = _star(ids[:n], _alike(sigs[:n], sigs[:n])) if n > 1 else []
        cut = n < members
        ids, sigs, labels = ids[n:], sigs[n:], labels[n:]
        a, b = [x for x, _ in links] + [None] * cut, [x for _, x in links] + [None] * cut
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(links) + [region] * cut, pa.int64())], ["a", "b", "region"])

    for batch in batches:
        for r, m, label, doc, sig in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if r != region or len(ids) == BLOCK:
                if r != region:
                    if ids:
                        yield done(len(ids))
                    region, members = r, m
                else:  # the shallowest place in the second half
                    common = [next((k for k in range(len(x)) if x[k] != y[k]), len(x)) for x, y in zip(labels[BLOCK // 2 - 1 :], labels[BLOCK // 2 :], strict=False)]
                    yield done(BLOCK // 2 + int(np.argmin(common)))
            ids.append(doc)
            sigs.append(sig)
            labels.append(label)
    if ids:
        yield done(len(ids))


def _blocks(members: Column, size: Column) -> Column:
    """Into how many blocks members of so many bytes together are dealt."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1))


def _within(rows: DataFrame, test: Callable, blocks: Column) -> DataFrame:
    """Links (a, b) between members of a group that fall into the same block; rows: (group, doc_id, payload)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc_id", "payload"])
        links = _star(pdf["doc_id"].tolist(), test(pdf["payload"].tolist(), pdf["payload"].tolist())) if len(pdf) > 1 else []
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks)).select("group", "block", "doc_id", "payload").groupBy("group", "block").applyInPandas(run, "a long, b long")


def _rest(rows: DataFrame, labels: DataFrame, test: Callable) -> DataFrame:
    """Links (a, b) between different components of the same group that no block has seen.

    rows: (group, doc_id, payload); labels: (node, component).  Any link between two components has an end outside of the
    group's largest one, so members outside of it are compared with all, in blocks of about BLOCK members by as many.
    """
    rows = rows.join(labels, rows["doc_id"] == labels["node"], "left").select("group", "doc_id", "payload", F.coalesce("component", "doc_id").alias("component"))
    rows = written(rows, "rest")
    sizes = rows.groupBy("group", "component").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))
    groups = sizes.groupBy("group").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.max_by(F.struct("n", "bytes"), F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    groups = groups.filter("parts > 1").select("group", "largest", _blocks(F.col("n"), F.col("bytes")).alias("blocks"), _blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("parts"))
    rows = rows.join(groups, "group")
    packed = F.collect_list(F.struct("doc_id", "component", "payload"))
    all_blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).groupBy("group", "block").agg(packed.alias("right"))
    others = rows.filter("component <> largest").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).groupBy("group", "part").agg(packed.alias("left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                linked = test([x["payload"] for x in left], [x["payload"] for x in right])
                found = {}  # one link for each component and component met
                for i, j in np.argwhere(linked).tolist():
                    x, y = left[i], right[j]
                    if x["component"] != y["component"]:
                        found.setdefault((x["component"], y["component"]), (x["doc_id"], y["doc_id"]))
                if found:
                    a, b = zip(*found.values(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return others.join(all_blocks, "group").select("left", "right").mapInArrow(run, "a long, b long")


def _families(reps: DataFrame) -> DataFrame:
    """(node, component): groups of documents that hold every pair that may be a link."""
    keys = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 2 * DEPTH * t + 1, 2 * DEPTH)) for t in range(TREES)])
    trees = reps.select("doc_id", F.posexplode(keys).alias("tree", "region"))
    # written first, so that the join on a hot region can be split
    shared = written(trees.groupBy("region").agg(F.count("*").alias("members")).filter("members > 1"), "shared")
    shared = written(trees.join(shared, "region"), "regions")
    label = F.expr(f"concat(substring(sig, 1 + {2 * DEPTH} * tree), substring(sig, 1, {2 * DEPTH} * tree))")
    # 24 values order a region well enough; what ties after that is cut as one
    walk = shared.join(reps.select("doc_id", "sig"), "doc_id").select("region", "members", F.substring(label, 1, 48).alias("label"), "doc_id", "sig")
    n = ranges_for(shared, F.lit(2 * DEPTH * TREES + 64))  # what a row of the walk has
    walk = walk.repartitionByRange(n, "region", "label", "doc_id").sortWithinPartitions("region", "label", "doc_id")
    found = written(walk.mapInArrow(_cut_regions, "a long, b long, region long"), "likely")
    links, cut = found.filter("a is not null").select("a", "b"), found.filter("region is not null").select("region").distinct()
    labels = components(links)
    if not cut.limit(1).count():
        return labels
    rows = shared.join(cut, "region", "left_semi").join(reps.select("doc_id", "sig"), "doc_id").select(F.col("region").alias("group"), "doc_id", F.col("sig").alias("payload"))
    more = _rest(rows, labels, _alike)
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document: its set's size, the smallest doc_id that links lead to, and whether it is that one."""
    docs = named(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(signatures(docs, width), "signatures")
    # only sets that several documents have; written first, so that a join on a hot set can be split
    classes = sets.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "rep")
    classes = written(classes, "classes")
    rep = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    members = sets.join(classes, "digest", "left").select("doc_id", "n", rep.alias("rep"), F.when(F.col("doc_id") == rep, F.col("sig")).alias("sig"))
    members = written(members, "members")
    reps = members.filter("sig is not null").select("doc_id", "sig")

    family = _families(reps)
    sizes = family.groupBy("component").agg(F.count("*").alias("size"))
    family = written(family.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("group"), "size"), "families")
    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = pa.array([s.tobytes() for s in shingle_sets(batch.column(3), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], payload], ["group", "size", "doc_id", "payload"])

    texts = docs.join(few(family), "doc_id").select("group", "size", "doc_id", "text")
    full = written(texts.mapInArrow(full_sets, "group long, size long, doc_id long, payload binary"), "sets")
    test = _overlapping(percent)
    weights = full.groupBy("group").agg(F.sum(F.octet_length("payload")).alias("bytes"))
    full = full.join(few(weights), "group")
    links = written(_within(full, test, _blocks(F.col("size"), F.col("bytes"))), "links")
    labels = components(links)
    large = full.filter(_blocks(F.col("size"), F.col("bytes")) > 1).select("group", "doc_id", "payload")
    if large.limit(1).count():
        more = _rest(large, labels, test)
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    # rows that share a doc_id join the classes of all their texts
    twice = members.groupBy("doc_id").agg(F.countDistinct("rep").alias("reps"), F.min("rep").alias("least")).filter("reps > 1")
    if twice.limit(1).count():
        tied = members.join(twice, "doc_id").select(F.col("rep").alias("a"), F.col("least").alias("b"))
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(tied))
    out = members.join(labels, members["rep"] == labels["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, all columns as they were: that with the least doc_id, and one without an id only if none has one.

    Rows may share an id or have none; they are linked by their texts alone.
    """
    id_col = options.pop("id_col", "doc_id")
    rows, key = keyed(docs, id_col)
    linked = near_duplicates(rows, id_col=key, **options).filter(~F.col("kept"))
    linked = written(linked.select(F.col("doc_id").alias("_member"), F.col("component_id").alias("_group")), "linked")
    members = linked.union(linked.select("_group", "_group").distinct().toDF("_member", "_group"))
    small = linked.count() <= BROADCAST_ROWS // 2
    ids = rows.select(rows[key].alias("_key"), column(rows, id_col).cast("long").alias("_id"))
    known = ids.join(F.broadcast(members) if small else members, F.col("_key") == F.col("_member"))
    stays = known.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_key"))["_key"].alias("_stays"))
    gone = written(members.join(stays.select("_stays"), F.col("_member") == F.col("_stays"), "left_anti").select(F.col("_member").alias("_gone")), "gone")
    return rows.join(few(gone), rows[key] == gone["_gone"], "left_anti").drop(key)


#: The query over word pairs at 80 percent, by all pairs that share one.
ORACLE_SQL = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, unnest(list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end)) as s from words),
sizes as (select d.doc_id, count(s) as n from documents d left join sets using (doc_id) group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, ways.b from reach join ways on reach.b = ways.a)
select doc_id, n as n_shingles, least as component_id, doc_id = least as kept from sizes join (select a as doc_id, min(b) as least from reach group by 1) using (doc_id)
"""

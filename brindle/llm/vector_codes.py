"""Vectors as short codes: each part of a vector is named by the nearest entry of its position's codebook.

Components become whole numbers, floor(scale * x), so that sums, distances and codebooks are exact and the same in
whatever order rows come.  Every task packs its rows into chunks and builds, for each position of a part, a metric tree over
the chunk's parts (an anchors hierarchy, from the middle out) whose balls cache the sum and the number of their points.
The trees are written once.  A round sends the codebooks to all chunks; a ball inherits the entries that may be nearest
to some point in it, the list shrinks on the way down, and where one entry is left its cached sum counts for the whole ball.
Chunks meet in sums by position and entry only.  Codes come from the same walk, so no vector is ever shuffled.

Cases: vectors that are null, empty, or hold a null or a number that isn't finite take no part, neither do those
whose length isn't a multiple of the number of parts.  Vectors of each length have codebooks of their own.  Codebooks begin with the
rows of the smallest ids, those without an id last and equal ids ordered by vector; fewer rows than entries make a smaller
codebook.  Repeated rows count as often as they come.  Labels may be null, which is a label.  No rows give no rows; further columns are not
read.  Components whose squared distances could pass 64 bits raise a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._balls import Trees, node_kind
from ._common import few, named, written
from ._vectors import by_length, finite, matrix, narrow, ranges, whole

#: Components of a chunk, and rows of it at least: a chunk of vectors of 64 components has 4,096.
IN_CHUNK, LEAST_ROWS = 1 << 18, 64
#: Labels whose sums are sent to every executor at most.
MOST_LABELS = 100_000


class Codebooks:
    """The entries (parts, entries, width) for the vectors of each length."""

    def __init__(self, entries: dict[int, np.ndarray]):
        self.entries = entries

    def digest(self, dim: int) -> str:
        """SHA-256 of all numbers in decimal, by part, entry and position, between commas."""
        return hashlib.sha256(",".join(map(str, self.entries[dim].ravel().tolist())).encode()).hexdigest()

    def decode(self, dim: int, code: str) -> list[int]:
        """The whole numbers that a code stands for."""
        return [v for part, entry in enumerate(bytes.fromhex(code)) for v in self.entries[dim][part, entry].tolist()]


def _trees(rows: DataFrame, parts: int, scale: float, kinds: dict[int, np.dtype]) -> DataFrame:
    """(dim, ids, labels, nodes, roots, points, orders) of each chunk, written."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def packed(dim: int) -> pa.RecordBatch:
            ids, labels, vectors = zip(*waiting.pop(dim), strict=True)
            trees, ids, labels = Trees.of(np.concatenate(vectors), parts), pa.concat_arrays(ids), pa.concat_arrays(labels)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, labels)]
            binary = [pa.array([a.tobytes()], pa.binary()) for a in (trees.nodes, trees.roots.astype("<i4"), trees.points.astype(kinds[dim]), trees.order.astype("<i4"))]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *lists, *binary], ["dim", "ids", "labels", "nodes", "roots", "points", "orders"])

        for batch in batches:
            for at, x in by_length(batch, 2):
                dim, at = x.shape[1], pa.array(at)
                own = waiting.setdefault(dim, [])
                own.append((batch.column(0).take(at), batch.column(1).take(at), whole(x, scale)))
                if sum(len(o[2]) for o in own) >= max(LEAST_ROWS, IN_CHUNK // dim):
                    yield packed(dim)
        for dim in list(waiting):
            yield packed(dim)

    label = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), *[T.StructField(c, T.BinaryType()) for c in ("nodes", "roots", "points", "orders")]])
    return written(rows.select("vec_id", "label", "vector").mapInArrow(build, schema), "trees")


def _read(batch: pa.RecordBatch, r: int, width_of: dict[int, int], kinds: dict[int, np.dtype]) -> tuple[int, Trees]:
    dim = batch.column("dim")[r].as_py()
    raw = {c: batch.column(c)[r].as_buffer() for c in ("nodes", "roots", "points", "orders")}
    points = np.frombuffer(raw["points"], kinds[dim]).reshape(-1, width_of[dim]).astype(np.int64)
    return dim, Trees(np.frombuffer(raw["nodes"], node_kind(width_of[dim])), np.frombuffer(raw["roots"], "<i4"), points, np.frombuffer(raw["orders"], "<i4"))


def compress(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> tuple[DataFrame, Codebooks]:
    """(dim, vec_id, label, code, error), a row for each vector that takes part, written, and the codebooks."""
    rows = named(vectors, id_col, label_col, vector_col).toDF("vec_id", "label", "vector").withColumn("vec_id", F.col("vec_id").cast("long"))
    rows = rows.filter(finite(F.col("vector")) & (F.size("vector") % parts == 0))
    found = ranges(rows, scale)
    for dim, (_, low, high) in found.items():
        if dim * (int(high.max()) - int(low.min()) + 1) ** 2 * entries >= 2**63:
            raise ValueError("squared distances could pass 64 bits")
    kinds = {d: narrow(int(low.min()), int(high.max()), signed=True) for d, (_, low, high) in found.items()}
    widths = {d: d // parts for d in found}
    books: dict[int, np.ndarray] = {}
    for dim in found:
        least = rows.filter(F.size("vector") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().combine_chunks()
        first = whole(matrix(least.column(0).chunk(0)), scale)
        books[dim] = np.ascontiguousarray(first.reshape(len(first), parts, widths[dim]).transpose(1, 0, 2))
    trees = _trees(rows, parts, scale, kinds)
    for _ in range(rounds if found else 0):
        shared = rows.sparkSession.sparkContext.broadcast(books)  # as many numbers as ``entries`` vectors have

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for r in range(batch.num_rows):
                    dim, tree = _read(batch, r, widths, kinds)
                    own = tree.sums(shared.value[dim])
                    total[dim] = [a + b for a, b in zip(total[dim], own, strict=True)] if dim in total else list(own)
            for dim, (sums, counts) in total.items():
                part, entry = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dim, np.int32)), pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], ["dim", "part", "entry", "n", "sums"])

        added = trees.select("dim", "nodes", "roots", "points", "orders").mapInArrow(add, "dim int, part int, entry int, n long, sums array<bigint>")
        each = added.select("dim", "part", "entry", "n", F.posexplode("sums").alias("place", "s"))
        means = each.groupBy("dim", "part", "entry", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        books = {d: b.copy() for d, b in books.items()}
        for r in means.collect():  # at most as many as the codebooks have numbers
            books[r["dim"]][r["part"], r["entry"], r["place"]] = r["s"] // r["n"]
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, tree = _read(batch, r, widths, kinds)
                codes, errors = tree.codes(shared.value[dim])
                text = codes.astype(np.uint8).tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), dim, np.int32)), batch.column("ids")[r].values, batch.column("labels")[r].values, pa.array([text[a : a + step] for a in range(0, len(text), step)], pa.string()), pa.array(errors)], ["dim", "vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return written(trees.mapInArrow(name, schema), "codes"), Codebooks(books)


def report(vectors: DataFrame, **more) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all vectors that take part."""
    codes, books = compress(vectors, **more)
    sums = few(written(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors"), MOST_LABELS)
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    digests = [x for dim in books.entries for x in (F.lit(dim), F.lit(books.digest(dim)))]
    digest = F.element_at(F.create_map(*digests), F.col("dim")) if digests else F.lit(None).cast("string")
    return out.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


_ROUND = """
a{i} as (
  select p.r, p.part, min((p.xx - 2 * list_inner_product(p.x, b.x) + b.xx)::bigint * 64 + b.entry) as key
  from p join b{i} b on p.part = b.part group by all
), s{i} as (
  select p.part, key % 64 as entry, place, sum(p.x[place]::bigint)::bigint as s, count(*) as n
  from a{i} join p on p.r = a{i}.r and p.part = a{i}.part, (select unnest(range(1, (select any_value(w) from p) + 1)) as place) group by all
), b{j} as (
  select part, entry, x, list_inner_product(x, x) as xx from (
    select b.part, b.entry, coalesce(m.x, b.x) as x from b{i} b left join (
      select part, entry, list(((s - ((s % n) + n) % n) // n)::double order by place) as x from s{i} group by part, entry
    ) m on m.part = b.part and m.entry = b.entry
  )
),"""

ORACLE_SQL = (
    """
with v as (
  select row_number() over () as r, vec_id, label, [floor(256 * x::double) for x in embedding] as x, len(embedding) // 16 as w from embeddings
  where embedding is not null and len(embedding) > 0 and len(embedding) % 16 = 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), p as (
  select *, list_inner_product(x, x) as xx from (select r, vec_id, w, part, x[part * w + 1 : part * w + w] as x from v, (select unnest(range(16)) as part))
), b0 as (
  select part, entry, x, xx from (select part, x, xx, row_number() over (partition by part order by vec_id nulls last, x) - 1 as entry from p) where entry < 64
),"""
    + _ROUND.format(i=0, j=1)
    + _ROUND.format(i=1, j=2)
    + """
a2 as (
  select p.r, p.part, min((p.xx - 2 * list_inner_product(p.x, b.x) + b.xx)::bigint * 64 + b.entry) as key
  from p join b2 b on p.part = b.part group by all
), e as (
  select v.vec_id, v.label, string_agg(printf('%02x', key % 64), '' order by part) as code, sum(key // 64)::bigint as error
  from a2 join v on v.r = a2.r group by v.r, v.vec_id, v.label
), h as (
  select sha256(string_agg(x::bigint::varchar, ',' order by part, entry, place)) as codebooks_sha256
  from (select part, entry, unnest(x) as x, generate_subscripts(x, 1) as place from b2)
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from e, h
"""
)

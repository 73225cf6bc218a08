"""Exact largest inner products by vector-approximation files.

Components become whole numbers, floor(scale * x).  The range of each place is cut into CELLS cells of equal width.  A block
of the file holds, for some thousands of different vectors, their cells (one byte a place), and in a further column what the
cells leave open, so that cells and rests together are the exact vectors.

A query's inner product with the cells of a vector bounds its true score from both sides, and the width of that bound is
the same for all vectors: a scan is one product of matrices over the bytes.  What can't reach the k-th score known so far goes
no further; of the others the exact vectors are read in the descending order of their upper bounds, until the next bound is below the
k-th exact score.  This is done block by block in each task, with the scores found so far carried along, so that
candidates are never rows of a table: a task hands on k results for each query.

Work is dealt over a grid of stripes of the file and groups of queries; both sides are repeated only along the
other's axis, and the grid is shaped so that the two repetitions weigh the same.  Equal vectors are one entry with its k + 1
smallest ids, which no result can need more of; they are put together within tasks before the one shuffle of the vectors, so a vector
that a third of all rows share is some entries a task.  Queries are dealt by id; equal ones in a group are scanned once.

Cases: vectors that are null, empty, or hold a null or a number that isn't finite take no part, neither do rows without an
id; zero vectors do.  Vectors of different length never meet.  Equal scores are ordered by id.  Rows with the query's id are
not its candidates; rows that are equal in id and vector count once; rows that share an id but not the vector are rows (and queries) of
their own.  Fewer candidates than k are all returned; no rows give no rows; further columns are not read.  Components whose
scores could pass 64 bits raise a ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import named, partitions, written
from ._vectors import blobs, by_length, finite, narrow, ranges, whole

#: Cells of a place; at most 256, since a cell is a byte.
CELLS = 64
ROWS_IN_BLOCK, QUERIES_IN_BLOCK = 4_096, 512
#: Pairs of a query and a row in one field of the grid: at most, and at least as long as there are fewer fields than tasks.
MOST_PAIRS, LEAST_PAIRS = 1 << 28, 1 << 22
#: Results that a task holds before it hands them on, and repeated vectors whose least ids it remembers.
HELD, REMEMBERED = 1_000_000, 50_000
#: Bytes of exact vectors that are read at once.
AT_ONCE = 16 << 20


def entries(batches: Iterator[pa.RecordBatch], scale: float, kinds: dict[int, np.dtype], most: int) -> Iterator[pa.RecordBatch]:
    """(dim, vec_id, blob) of whole vectors; of equal ones within a task little more than the ``most`` smallest ids."""
    known: dict[bytes, np.ndarray] = {}
    for batch in batches:
        for at, x in by_length(batch, 1):
            ids, kind = batch.column(0).take(pa.array(at)).to_numpy(), kinds[x.shape[1]]
            v = np.ascontiguousarray(whole(x, scale), kind)
            _, own = np.unique(v.view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel(), return_inverse=True)
            order = np.lexsort((ids, own))
            own, ids, v = own[order], ids[order], v[order]
            new = np.ones(len(ids), bool)
            new[1:] = (own[1:] != own[:-1]) | (ids[1:] != ids[:-1])
            own, ids, v = own[new], ids[new], v[new]
            first = np.searchsorted(own, own)
            keep = np.arange(len(own)) - first < most
            sizes = np.bincount(own)
            for c in np.flatnonzero(sizes > 1):
                a = np.searchsorted(own, c)
                b = a + min(sizes[c], most)
                key = v[a].tobytes()
                old = known.get(key)
                if old is None and len(known) >= REMEMBERED:
                    continue
                if old is not None:
                    keep[a:b] &= ~np.isin(ids[a:b], old) & ((len(old) < most) | (ids[a:b] < old[-1]))
                known[key] = np.union1d(ids[a:b], old if old is not None else ids[a:b])[:most]
            ids, v = ids[keep], v[keep]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), v.shape[1], np.int32)), pa.array(ids, pa.int64()), blobs(v, kind)], ["dim", "vec_id", "blob"])


def _objects(lists: list) -> np.ndarray:
    out = np.empty(len(lists), object)
    for i, x in enumerate(lists):
        out[i] = x
    return out


class Best:
    """The k best different vectors of each of some queries: score, smallest id, and all ids that are kept of it."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k, self.read = queries, k, 0
        self.query, self.score, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, object)
        self.kth = np.full(len(queries), -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
        self.read += len(query)
        query, score, first, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.first, first), (self.ids, ids)))
        order = np.lexsort((first, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[place < self.k]
        self.query, self.score, self.first, self.ids = query[place < self.k], score[keep], first[keep], ids[keep]
        last = place == self.k - 1
        self.kth[query[last]] = score[order[last]]

    def scan(self, codes: np.ndarray, rests: np.ndarray, ids: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        """One block of the file."""
        q, n = self.queries, len(codes)
        first = np.array([i[0] for i in ids], np.int64)
        sizes = float(np.abs(q).max(initial=0)) * float(width.max()) * 255 * q.shape[1]
        exact = np.float32 if sizes < 2**24 else np.float64
        inner = (q * width).astype(exact) @ codes.T.astype(exact)
        base = (q.astype(np.float64) * low).sum(axis=1)
        slack = 1e-12 * (np.abs(q.astype(np.float64)) * (np.abs(low) + width * 256.0)).sum(axis=1)
        upper = base + (np.maximum(q, 0).astype(np.float64) * (width - 1)).sum(axis=1) + slack
        lower = base + (np.minimum(q, 0).astype(np.float64) * (width - 1)).sum(axis=1) - slack
        least = self.kth.copy()  # what a vector's upper bound must reach
        open_ = np.flatnonzero(np.isinf(least))
        if len(open_) and n >= self.k:
            least[open_] = np.partition(inner[open_], n - self.k, axis=1)[:, n - self.k] + lower[open_]
        # rounding the border down to the products' type only lets more through
        border = np.nextafter((least - upper).astype(exact), exact(-np.inf))
        i, j = np.nonzero(inner >= border[:, None])
        bound = inner[i, j].astype(np.float64) + upper[i]
        order = np.lexsort((-bound, i))
        i, j, bound = i[order], j[order], bound[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        begin, many = 0, self.k
        while len(i):
            now = place < begin + many
            for part in np.array_split(np.flatnonzero(now), max(1, math.ceil(now.sum() * q.shape[1] * 24 / AT_ONCE))):
                exact_rows = low + codes[j[part]].astype(np.int64) * width + rests[j[part]].astype(np.int64)
                self.add(i[part], (exact_rows * q[i[part]]).sum(axis=1), ids[j[part]], first[j[part]])
            left = ~now & (bound >= self.kth[i])
            i, j, bound, place = i[left], j[left], bound[left], place[left]
            begin, many = begin + many, many * 4


def _grid(n: int, n_queries: int, row_bytes: int, query_bytes: int, tasks: int) -> tuple[int, int]:
    """(stripes, groups)."""
    pairs = n * n_queries
    fields = max(math.ceil(pairs / MOST_PAIRS), min(math.ceil(pairs / LEAST_PAIRS), tasks))
    groups = round(math.sqrt(fields * n_queries * query_bytes / (n * row_bytes)))
    groups = min(max(1, groups), math.ceil(n_queries / 64), fields)
    return min(math.ceil(fields / groups), math.ceil(n / ROWS_IN_BLOCK) if fields > tasks else math.ceil(n / 64)), groups


def _file(rows: DataFrame, scale: float, found: dict[int, tuple[int, np.ndarray, np.ndarray]], kinds: dict[int, np.dtype], widths: dict[int, np.ndarray], most: int, tasks: int) -> DataFrame:
    """The blocks (dim, block, codes, rests, ids) of the vector-approximation file, written."""
    blocks = {d: max(math.ceil(n / ROWS_IN_BLOCK), min(tasks, math.ceil(n / 64))) for d, (n, _, _) in found.items()}
    number = F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), F.col("dim"))
    single = rows.mapInArrow(lambda b: entries(b, scale, kinds, most), "dim int, vec_id long, blob binary")
    dealt = single.withColumn("block", F.pmod(F.xxhash64("blob"), number).cast("int")).groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "blob")).alias("members"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, members = batch.column(0)[r].as_py(), batch.column(2)[r].values
                vectors: dict[bytes, list[int]] = {}
                for i, v in zip(members.field("vec_id").to_pylist(), members.field("blob").to_pylist(), strict=True):
                    vectors.setdefault(v, []).append(i)
                ids = [sorted(set(i))[:most] for i in vectors.values()]
                x = np.frombuffer(b"".join(vectors), kinds[dim]).reshape(-1, dim).astype(np.int64) - found[dim][1]
                codes = x // widths[dim]
                rest = (x - codes * widths[dim]).astype(narrow(0, int(widths[dim].max()) - 1, signed=False))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), batch.column(1).slice(r, 1), pa.array([codes.astype(np.uint8).tobytes()], pa.binary()), pa.array([rest.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.list_(pa.int64())))], ["dim", "block", "codes", "rests", "ids"])

    return written(dealt.mapInArrow(pack, "dim int, block int, codes binary, rests binary, ids array<array<bigint>>"), "vector-file")


def _results(vectors: DataFrame, is_query: Column, k: int, scale: float, id_col: str, vector_col: str) -> DataFrame | None:
    """(query_id, own, near, read): the k best of each query in each stripe, and how many exact vectors were read for its group."""
    spark = vectors.sparkSession
    rows = named(vectors, id_col, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite(F.col("vector")))
    found, tasks = ranges(rows, scale), partitions(spark)
    if not found:
        return None
    for dim, (_, low, high) in found.items():
        if dim * max(abs(int(low.min())), abs(int(high.max()))) ** 2 >= 2**62:
            raise ValueError("inner products could pass 64 bits")
    kinds = {d: narrow(int(low.min()), int(high.max()), signed=True) for d, (_, low, high) in found.items()}
    widths = {d: (high - low) // CELLS + 1 for d, (_, low, high) in found.items()}
    file = _file(rows, scale, found, kinds, widths, k + 1, tasks)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch, 1):
                v = np.ascontiguousarray(whole(x, scale), kinds[x.shape[1]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x.shape[1], np.int32)), batch.column(0).take(pa.array(at)), blobs(v, v.dtype)], ["dim", "query_id", "blob"])

    queries = written(rows.filter(is_query).mapInArrow(asked, "dim int, query_id long, blob binary").distinct(), "queries")
    counts = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length
    grids = {d: _grid(found[d][0], n, 2 * d, d * kinds[d].itemsize, tasks) for d, n in counts.items()}
    if not grids:
        return None
    shape = spark.createDataFrame([(d, s, g, math.ceil(counts[d] / g / QUERIES_IN_BLOCK)) for d, (s, g) in grids.items()], "dim int, stripes int, groups int, parts int")
    hashed = F.xxhash64("query_id", "blob")
    left = queries.join(F.broadcast(shape), "dim").withColumn("group", F.pmod(hashed, F.col("groups"))).withColumn("part", F.pmod(F.shiftright(hashed, 20), F.col("parts")))
    left = left.groupBy("dim", "group", "part", "stripes").agg(F.collect_list(F.struct("query_id", "blob")).alias("asked"))
    left = left.select("dim", "group", "part", "asked", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"))
    right = file.join(F.broadcast(shape), "dim").withColumn("stripe", F.pmod("block", "stripes"))
    right = right.select("dim", "stripe", "codes", "rests", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups").cast("long") - 1)).alias("group"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[Best, np.ndarray, np.ndarray]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for best, query_ids, own in held.values():
                starts = np.searchsorted(best.query, np.arange(len(best.queries) + 1))
                near = []
                for i, query in zip(own, query_ids, strict=True):
                    a, b = starts[i], starts[i + 1]
                    hits = [(-int(s), int(v)) for s, ids in zip(best.score[a:b], best.ids[a:b], strict=True) for v in ids if v != query]
                    near.append([{"cost": c, "vec_id": v} for c, v in sorted(hits)[:k]])
                kind = pa.list_(pa.struct([("cost", pa.int64()), ("vec_id", pa.int64())]))
                read = np.zeros(len(query_ids), np.int64)
                read[0] = best.read
                yield pa.RecordBatch.from_arrays([pa.array(query_ids, pa.int64()), pa.array([hash_of(best.queries[i]) for i in own], pa.int64()), pa.array(near, kind), pa.array(read)], ["query_id", "own", "near", "read"])
            held.clear()

        def hash_of(v: np.ndarray) -> int:
            return xxhash.xxh64_intdigest(v.tobytes()) >> 1

        for batch in batches:
            for r in range(batch.num_rows):
                dim, group, part = (batch.column(c)[r].as_py() for c in range(3))
                _, low, _ = found[dim]
                if (dim, group, part) not in held:
                    some = batch.column(3)[r].values
                    q = np.frombuffer(b"".join(some.field("blob").to_pylist()), kinds[dim]).reshape(-1, dim).astype(np.int64)
                    different, own = np.unique(q, axis=0, return_inverse=True)
                    held[dim, group, part] = Best(different, k + 1), some.field("query_id").to_numpy(), own.ravel()
                codes = np.frombuffer(batch.column(4)[r].as_buffer(), np.uint8).reshape(-1, dim)
                rests = np.frombuffer(batch.column(5)[r].as_buffer(), narrow(0, int(widths[dim].max()) - 1, signed=False)).reshape(-1, dim)
                ids = _objects(batch.column(6)[r].as_py())
                held[dim, group, part][0].scan(codes, rests, ids, low, widths[dim])
                if sum(len(b.query) for b, _, _ in held.values()) > HELD:
                    yield from handed_on()
        yield from handed_on()

    met = left.join(right, ["dim", "stripe", "group"]).select("dim", "group", "part", "asked", "codes", "rests", "ids")
    return met.mapInArrow(scan, "query_id long, own long, near array<struct<cost: bigint, vec_id: bigint>>, read long")


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row that is_query, which is a condition on ``vec_id``."""
    found = _results(vectors, is_query, k, scale, id_col, vector_col)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    near = found.groupBy("query_id", "own").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))  # k for each stripe
    out = near.select("query_id", F.posexplode("near").alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.cost")).alias("score"))


def share_read(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Exact vectors that were read, as a share of all pairs of a query and a row."""
    found = _results(vectors, is_query, k, scale, id_col, vector_col)
    if found is None:
        return 0.0
    rows = named(vectors, id_col, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector")).filter(F.col("vec_id").isNotNull() & finite(F.col("vector")))
    return (found.agg(F.sum("read")).first()[0] or 0) / max(1, rows.count() * rows.filter(is_query).count())


ORACLE_SQL = """
with v as (
  select vec_id, [floor(256 * x::double) for x in embedding] as x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

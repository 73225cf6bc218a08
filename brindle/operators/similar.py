"""Similarity of articles and events: pairs over a threshold, greedy passes in order, merging, and nearest neighbours.

The greedy passes depend on the order of the items.  They begin with a few rounds over a table of edges: in a round every item
decides whose earlier neighbours have all decided, which is what the pass would have found at its turn.  What is undecided then lies in
chains.  Its connected components are found by doubling, and the pass walks through each of them in order, many components side by side; a
component too large for a task is walked through in slices of its order, each of which knows what the ones before have decided.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ship
from ..sources.articles import few, stored
from .components import slices, split, walked

#: Vectors in a block, others that they are grouped around at most, and blocks that a query meets before it has bounds.
BLOCK, PIVOTS, FIRST = 512, 1_024, 2
#: Vectors of a tile of blocks at most, tiles that a side is cut into at least, and partitions of pairs of tiles at most.
TILE, TILES, MEETINGS = 16_384, 8, 4_096
#: Words in one whole number of a mask, and masks in a block.
BITS, MASKS = 62, 2_048
#: Options of an event that a merging pass knows at first, and rows of options that a task holds before it cuts them.
OPTIONS, HELD = 32, 6_000_000
#: Rounds of a greedy pass before its components are walked through.
ROUNDS = 3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _packed(rows: DataFrame, name: str, *, most: int, unit: bool = False) -> DataFrame:
    """(band, dim, id, items, centre, length, radius) of blocks of about ``most`` vectors (k, v, band, day) each, written.

    Vectors are grouped around pivots, which are some of them, so that a block is a small ball; the centre's length and the
    ball's radius bound what a vector of one block and one of another can have in common.  With ``unit`` balls are of directions.
    """
    ship(rows.sparkSession)
    rows = rows.withColumn("dim", F.size("v"))
    pivots = min(PIVOTS, 4 * rows.count() // most)
    some: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("k"), "k").limit(pivots).select("v").collect() if pivots > 1 else []:  # PIVOTS at most
        some.setdefault(len(r["v"]), []).append(r["v"])
    around = {dim: _directions(np.array(v)) if unit else np.array(v) for dim, v in some.items()}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = batch.column(3).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim, p in around.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    x = batch.column(1).take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)
                    x = _directions(x) if unit else x
                    cells[at] = ((p * p).sum(axis=1)[None] - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], ["k", "v", "band", "dim", "day", "cell"])

    dealt = rows.select("k", "v", "band", "dim", "day")
    dealt = dealt.mapInArrow(near, "k long, v array<double>, band long, dim int, day int, cell int") if around else dealt.withColumn("cell", F.lit(0))
    dealt = stored(dealt, f"{name}-cells")
    sizes = few(dealt.groupBy("band", "dim", "cell").agg(F.count("*").alias("n")))
    part = F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / most))
    blocks = dealt.join(sizes, ["band", "dim", "cell"]).groupBy("band", "dim", F.concat_ws("-", "band", "dim", "cell", part).alias("id")).agg(F.collect_list(F.struct("k", "v", "day")).alias("items"))

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                _, x = _items(batch.column(3)[n])
                x = _directions(x) if unit else x
                centre = x.mean(axis=0)
                radius = np.sqrt(((x - centre) ** 2).sum(axis=1).max()) * (1 + 1e-9)
                yield pa.RecordBatch.from_arrays([*[c.slice(n, 1) for c in batch.columns], pa.array([centre.tolist()]), pa.array([float(np.sqrt(centre @ centre))]), pa.array([float(radius)])], ["band", "dim", "id", "items", "centre", "length", "radius"])

    schema = "band long, dim int, id string, items array<struct<k: bigint, v: array<double>, day: int>>, centre array<double>, length double, radius double"
    return stored(blocks.mapInArrow(balls, schema), f"{name}-blocks")


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _items(scalar) -> tuple[np.ndarray, np.ndarray]:
    items = scalar.values
    keys, vectors = items.field("k").to_numpy(), items.field("v")
    return keys, vectors.flatten().to_numpy().reshape(len(keys), -1)


def _ball(blocks: DataFrame, side: str) -> DataFrame:
    return blocks.select("band", "dim", F.col("id").alias(f"{side}_id"), F.col("centre").alias(f"{side}_c"), F.col("length").alias(f"{side}_l"), F.col("radius").alias(f"{side}_r"))


def _bound() -> Column:
    """What a vector of the left ball and one of the right can have as a dot product at most."""
    c = dot(F.col("left_c"), F.col("right_c")) + F.col("left_r") * F.col("right_l") + F.col("right_r") * F.col("left_l") + F.col("left_r") * F.col("right_r")
    return c + 1e-9 * (1 + F.abs(c))


def _blocks(df: DataFrame, band: Column, key: str, vector: str, day: Column | None) -> DataFrame:
    day = F.lit(None).cast("int") if day is None else F.unix_date(day)
    rows = df.select(F.col(key).cast("long").alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"), band.cast("long").alias("band"), day.alias("day"))
    return _packed(rows.filter("v is not null and k is not null and size(v) > 0 and band is not null"), "vector", most=BLOCK)


def _tiles(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks with ``tile``, a number within their band and length, and (band, dim, tile) of the tiles that have a block."""
    sized = blocks.withColumn("_n", F.size("items"))
    each = sized.groupBy("band", "dim").agg(F.sum("_n").alias("_all"))
    most = max(BLOCK, min(TILE, (sized.agg(F.sum("_n")).first()[0] or 0) // TILES))
    each = few(each.select("band", "dim", F.ceil(F.col("_all") / most).alias("_tiles")))
    tiled = blocks.join(each, ["band", "dim"]).withColumn("tile", F.pmod(F.xxhash64("id"), "_tiles")).drop("_tiles")
    return tiled, tiled.select("band", "dim", "tile").distinct()


def _met(left: DataFrame, right: DataFrame, pairs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """(pair, side, items, centre, length, radius, …) of the blocks of both tiles of each pair, a pair in one partition and its left side first.

    pairs have band, dim, tile, right_band, right_tile, and may have a ``square``: pairs of one are one task's.  A block is shuffled once for each pair of its tile, not once for each block that it meets.
    """
    in_order = Window.orderBy("band", "dim", "tile", "right_band", "right_tile")
    square = F.dense_rank().over(Window.orderBy("square")) if "square" in pairs.columns else F.row_number().over(in_order)
    pairs = stored(pairs.withColumn("pair", F.row_number().over(in_order) - 1).withColumn("task", square - 1), "tile-pairs")  # numbers of tiles only
    n = min((pairs.agg(F.max("task")).first()[0] or 0) + 1, MEETINGS)
    own = ("items", "centre", "length", "radius")
    ours = left.join(few(pairs.select("band", "dim", "tile", "pair", "task")), ["band", "dim", "tile"]).select("pair", F.lit(0).alias("side"), *own, *columns, "task")
    there = pairs.filter("right_band is not null").select(F.col("right_band").alias("band"), "dim", F.col("right_tile").alias("tile"), "pair", "task")
    theirs = right.join(few(there), ["band", "dim", "tile"]).select("pair", F.lit(1).alias("side"), *own, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns], "task")
    return ours.unionByName(theirs).repartitionById(n, F.pmod("task", F.lit(n)).cast("int")).sortWithinPartitions("pair", "side").drop("task")


class _Side:
    """The blocks of one tile: what they hold, one after the other, and their balls."""

    def __init__(self, blocks: list[dict]):
        self.blocks = blocks
        parts = [_items(b["items"]) for b in blocks]
        self.sizes = np.array([len(k) for k, _ in parts])
        self.keys, self.vectors = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])
        self.days = np.concatenate([b["items"].values.field("day").to_numpy(zero_copy_only=False).astype(float) for b in blocks])
        self.centres = np.array([b["centre"].values.to_numpy() for b in blocks])
        self.lengths, self.radii = (np.array([b[c].as_py() for b in blocks]) for c in ("length", "radius"))

    def chunks(self) -> Iterator[tuple[np.ndarray, slice]]:
        """Neighbouring blocks of about BLOCK vectors, and the place of what they hold."""
        ends = np.cumsum(self.sizes)
        group = (ends - self.sizes) // BLOCK
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            yield at, slice(int(ends[at[0]] - self.sizes[at[0]]), int(ends[at[-1]]))

    def bounds(self, at: np.ndarray, other: _Side) -> np.ndarray:
        """As ``_bound``: what vectors of these blocks and of those of another side can have as a dot product at most."""
        c = self.centres[at] @ other.centres.T + self.radii[at, None] * other.lengths + other.radii * self.lengths[at, None] + self.radii[at, None] * other.radii
        return c + 1e-9 * (1 + np.abs(c))


def _by_pair(kernel, names: list[str]):
    """A function of the batches of ``_met``: the kernel gets both sides of a pair, or one and None where a tile meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if sides[0]:
                for found in kernel(_Side(sides[0]), _Side(sides[1]) if sides[1] else None):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in found], names)

        for batch in batches:
            pairs, which = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for n in range(batch.num_rows):
                if pairs[n] != now:
                    yield from done()
                    now, sides = pairs[n], ([], [])
                sides[which[n]].append({c: batch.column(c)[n] for c in batch.schema.names[2:]})
        yield from done()

    return run


def _tile_pairs(tiles: DataFrame) -> DataFrame:
    """(band, dim, tile, right_band, right_tile) of the tiles that meet: those of a band and of the next one, each pair once; right_band is null where a tile meets itself."""
    other = tiles.withColumnRenamed("band", "right_band").withColumnRenamed("tile", "right_tile")
    same = (F.col("right_band") == F.col("band")) & (F.col("right_tile") == F.col("tile"))
    pairs = tiles.withColumn("right_band", F.explode(F.array(F.col("band"), F.col("band") + 1))).join(other, ["dim", "right_band"])
    return pairs.filter((F.col("right_band") > F.col("band")) | (F.col("right_tile") >= F.col("tile"))).withColumn("right_band", F.when(~same, F.col("right_band")))


def _over(left: _Side, right: _Side | None, threshold: float) -> Iterator[tuple]:
    """(a, b, dot, days) for a < b of the vectors of two tiles, or of one, whose dot product is over the threshold; days are NaN where unknown."""
    own = right is None
    right = right or left
    for at, place in left.chunks():
        near = (left.bounds(at, right) > threshold).any(axis=0)
        to = np.flatnonzero(np.repeat(near, right.sizes))
        a, b = left.vectors[place], right.vectors if near.all() else right.vectors[to]
        i, j = np.nonzero(a @ b.T > threshold - 1e-9)
        i, j = i + place.start, to[j]
        if own:
            i, j = i[i < j], j[i < j]
        for p, q in zip(*(np.array_split(x, max(1, len(i) // 20_000)) for x in (i, j)), strict=True):
            exact = np.cumsum(left.vectors[p] * right.vectors[q], axis=1)[:, -1]
            x, y = left.keys[p], right.keys[q]
            ok = (exact > threshold) & (x != y)
            yield np.minimum(x, y)[ok], np.maximum(x, y)[ok], exact[ok], np.abs(left.days[p] - right.days[q])[ok]


def similar_pairs(df: DataFrame, *, threshold: float, band: Column, key: str = "pos", vector: str = "vector", day: Column | None = None) -> DataFrame:
    """(a, b, dot) for a < b whose dot product is over the threshold and whose bands differ by 1 at most; with ``day``, a date, also the ``days`` between.

    ``band`` is a whole number that items over the threshold can't differ in by more.  Items of a band are packed into balls and these into
    tiles; tiles of the band and of the next one meet, each pair in one task, and in it balls do unless the triangle inequality keeps
    all their dot products under the threshold.  Only pairs over it become rows, each once.  Vectors of different length never meet.
    """
    blocks, tiles = _tiles(_blocks(df, band, key, vector, day))

    def kernel(left: _Side, right: _Side | None) -> Iterator[tuple]:
        for a, b, dots, days in _over(left, right, threshold):
            yield a, b, dots, pa.array(days, pa.float64(), mask=np.isnan(days)).cast(pa.int32())

    found = _met(blocks, blocks, _tile_pairs(tiles)).mapInArrow(_by_pair(kernel, ["a", "b", "dot", "days"]), "a long, b long, dot double, days int")
    return found if day is not None else found.drop("days")


def _best(a: np.ndarray, b: np.ndarray, weight: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` rows of each a with the greatest weights, ties to the smaller b."""
    order = np.lexsort((b, -weight, a))
    a, b, weight = a[order], b[order], weight[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a) < most
    return a[kept], b[kept], weight[kept]


def best_pairs(df: DataFrame, *, threshold: float, band: Column, weigh: Callable, most: int, key: str = "pos", vector: str = "vector", day: Column | None = None) -> DataFrame:
    """(a, b, weight, place): of the ``similar_pairs`` of each a the ``most`` with the greatest weights, ties to the smaller b, written.

    ``weigh`` makes from dot products and days, NaN where unknown, the weights, NaN where a pair doesn't count.  Pairs never become rows: a task meets a square of
    pairs of tiles and hands on what is best in it, so what is written grows with the items.
    """
    blocks, tiles = _tiles(_blocks(df, band, key, vector, day))
    tiles = stored(tiles, "tiles")
    side = max(1, tiles.count() // TILES)  # pairs of tiles on a side of a square
    numbers = tiles.withColumn("n", F.floor((F.row_number().over(Window.orderBy("band", "dim", "tile")) - 1) / side))  # numbers of tiles only
    there = numbers.select(F.col("band").alias("right_band"), "dim", F.col("tile").alias("right_tile"), F.col("n").alias("m"))
    pairs = _tile_pairs(tiles).join(numbers, ["band", "dim", "tile"]).join(there, ["right_band", "dim", "right_tile"], "left")
    pairs = pairs.withColumn("square", F.struct("n", F.coalesce("m", "n"))).drop("n", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def cut() -> tuple:
            return _best(*[np.concatenate(x) for x in zip(*held, strict=True)], most)

        def kernel(left: _Side, right: _Side | None) -> Iterator[tuple]:
            nonlocal held, n
            for a, b, dots, days in _over(left, right, threshold):
                weight = weigh(dots, days)
                ok = ~np.isnan(weight)
                held.append((a[ok], b[ok], weight[ok]))
                n += int(ok.sum())
                if n > HELD:
                    held = [cut()]
                    n = len(held[0][0])
                    if n > 3 * HELD // 4:  # so many items that they don't fit
                        yield held[0]
                        held, n = [], 0

        yield from _by_pair(kernel, ["a", "b", "weight"])(batches)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cut()], ["a", "b", "weight"])

    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
    found = _met(blocks, blocks, pairs).mapInArrow(run, "a long, b long, weight double")
    return stored(found.withColumn("place", place).filter(F.col("place") <= most), "best-pairs")


def share_met(df: DataFrame, *, threshold: float, band: Column, key: str = "pos", vector: str = "vector") -> float:
    """The pairs of blocks whose bound lets them meet in ``similar_pairs``, as a share of all pairs of blocks in neighbouring bands."""
    blocks = _blocks(df, band, key, vector, None)
    left = _ball(blocks, "left").withColumn("other", F.explode(F.array(F.col("band"), F.col("band") + 1))).withColumnRenamed("band", "own")
    met = left.join(_ball(blocks, "right").withColumnRenamed("band", "other"), ["other", "dim"]).filter((F.col("other") > F.col("own")) | (F.col("left_id") <= F.col("right_id")))
    r = met.select(_bound().alias("bound")).agg(F.count("*").alias("all"), F.count_if(F.col("bound") > threshold).alias("met")).first()
    return r["met"] / max(1, r["all"])


def day_band(date: Column, days: int) -> Column:
    return F.floor(F.unix_date(date) / (days + 1))


def largest_norm(df: DataFrame, vector: str = "vector") -> float:
    return float(df.agg(F.max(F.sqrt(dot(F.col(vector), F.col(vector))))).first()[0] or 0.0)


def projection_band(vector: Column, threshold: float, radius: float = 1.0) -> Column:
    """A band by the first coordinate, for vectors no longer than ``radius``: those with a greater dot product differ in it by less than its width.

    The squared distance of two such vectors is 2 * radius ** 2 less twice their dot product at most.
    """
    return F.floor(F.get(vector, F.lit(0)).cast("double") / math.sqrt(max(2 * radius * radius - 2 * threshold, 1e-6)))


def _masks(hit: Column, vocabulary: list[str]) -> Column:
    """The words of the vocabulary that were hit: an array of whole numbers with a bit for each of BITS words."""
    bits = [F.when(F.array_contains(hit, w), F.lit(1 << i % BITS).cast("long")).otherwise(F.lit(0).cast("long")) for i, w in enumerate(vocabulary)]
    return F.array(*[sum(bits[p + 1 : p + BITS], bits[p]) for p in range(0, len(bits), BITS)])


def _bit(masks: Column, i: int) -> Column:
    return F.call_function("shiftright", masks[i // BITS], F.lit(i % BITS)).bitwiseAND(1)


def keyword_pairs(df: DataFrame, *, vocabulary: tuple[str, ...], threshold: float, key: str, text: str, within: Column | None = None) -> DataFrame:
    """(a, b, similarity) for a < b: pairs whose sets of vocabulary words have at least this Jaccard similarity.

    A set is a bit mask, and items with the same mask are one.  Masks meet on the rarest words that two sets over the threshold must
    share one of, in blocks, so that a frequent word is many tasks; a pair is counted where its rarest common word is met.
    ``within`` is a group that pairs must not cross.
    """
    ship(df.sparkSession)
    words = sorted(set(vocabulary))
    hit = F.array_intersect(F.array(*[F.lit(w) for w in words]), F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))
    rows = df.select(F.col(key).alias("k"), hit.alias("hit"), (within if within is not None else F.lit(0)).alias("g")).filter(F.size("hit") > 0)
    rows = rows.select("k", _masks(F.col("hit"), words).alias("m"), "g")
    rows = stored(rows, "keyword-sets")
    sets = stored(rows.groupBy("g", "m").agg(F.min("k").alias("first")), "masks")
    spread = sets.agg(*[F.sum(_bit(F.col("m"), i)).alias(f"n{i}") for i in range(len(words))]).first()
    rarest = sorted(range(len(words)), key=lambda i: (spread[f"n{i}"] or 0, i))  # the vocabulary's places, the rarest word first
    held = F.filter(F.array(*[F.when(_bit(F.col("m"), i) == 1, F.lit(r)) for r, i in enumerate(rarest)]), lambda x: x.isNotNull())
    size = F.size("held")
    heads = sets.withColumn("held", held).withColumn("w", F.explode(F.slice("held", F.lit(1), (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))))
    most = few(heads.groupBy("g", "w").agg(F.count("*").alias("n")))
    blocks = heads.join(most, ["g", "w"]).withColumn("block", F.pmod(F.xxhash64("m"), F.ceil(F.col("n") / MASKS))).groupBy("g", "w", "block").agg(F.collect_list(F.struct("first", "m")).alias("masks"))
    blocks = stored(blocks, "mask-blocks")
    other = blocks.select("g", "w", F.col("block").alias("right_block"), F.col("masks").alias("right"))
    met = blocks.withColumnRenamed("masks", "left").join(other, ["g", "w"]).filter(F.col("block") <= F.col("right_block")).select("w", "left", "right", (F.col("block") == F.col("right_block")).alias("own"))
    order = np.array(rarest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                w, own = order[batch.column(0)[n].as_py()], batch.column(3)[n].as_py()
                (ka, a), (kb, b) = (_masked(batch.column(c)[n]) for c in (1, 2))
                both = sum(np.bitwise_count(a[:, None, i] & b[None, :, i]).astype(np.int32) for i in range(a.shape[1]))
                sizes = [np.bitwise_count(x).sum(axis=1, dtype=np.int32) for x in (a, b)]
                either = sizes[0][:, None] + sizes[1][None, :] - both
                i, j = np.nonzero(both >= either * (threshold - 1e-9))
                similarity = both[i, j] / either[i, j]
                common = a[i] & b[j]
                rarer = np.zeros(len(i), bool)  # a rarer word that both have: the pair is met there
                for r in order[: int(np.flatnonzero(order == w)[0])]:
                    rarer |= (common[:, r // BITS] >> (r % BITS)) & 1 == 1
                ok = (similarity >= threshold) & ~rarer & ((ka[i] < kb[j]) if own else (ka[i] != kb[j]))
                low, high = np.minimum(ka[i], kb[j])[ok], np.maximum(ka[i], kb[j])[ok]
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(similarity[ok])], ["a", "b", "similarity"])

    between = met.mapInArrow(run, "a long, b long, similarity double")
    firsts = sets.withColumnRenamed("first", "_first")
    same = rows.join(firsts, ["g", "m"]).filter(F.col("k") > F.col("_first")).select(F.col("_first").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("similarity"))
    return between.unionByName(same)


def _masked(scalar) -> tuple[np.ndarray, np.ndarray]:
    items = scalar.values
    return items.field("first").to_numpy(), items.field("m").flatten().to_numpy().reshape(len(items), -1)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _removal():
    gone: set[int] = set()

    def step(*edge):
        if edge and edge[1] not in gone and edge[0] not in gone:
            gone.add(edge[1])
            return [(edge[1],)]
        return []

    return step


def greedy_kept(items: DataFrame, edges: DataFrame, *, key: str = "pos") -> DataFrame:
    """The items that stay when each in order goes if it is similar to an earlier one that stayed; edges (a, b) have a < b."""
    spark = items.sparkSession
    ship(spark)
    open_, gone, rounds = stored(edges.select("a", "b"), "open-edges"), [], 0
    while open_.limit(1).count():
        if rounds and rounds % ROUNDS == 0:
            small, large = split(open_, open_, "b")
            gone.append(walked(small, [F.col("b"), F.col("a")], ("a", "b"), _removal, "k long"))
            found: list[DataFrame] = []
            for part in slices(large, "b"):
                if found:
                    part = part.join(few(_union(found).withColumnRenamed("k", "a")), "a", "left_anti")
                found.append(walked(part, [F.col("b"), F.col("a")], ("a", "b"), _removal, "k long"))
            gone += found
            break
        rounds += 1
        # who has no earlier neighbour left undecided stays; its later neighbours go
        stay = open_.select(F.col("a").alias("k")).distinct().join(open_.select(F.col("b").alias("k")).distinct(), "k", "left_anti")
        drop = stored(open_.join(stay.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct(), "dropped")
        gone.append(drop)
        open_ = stored(open_.join(drop.withColumnRenamed("k", "a"), "a", "left_anti").join(drop.withColumnRenamed("k", "b"), "b", "left_anti").join(stay.withColumnRenamed("k", "a"), "a", "left_anti").select("a", "b"), "open-edges")
    dropped = _union(gone) if gone else spark.createDataFrame([], "k long")
    return items.join(dropped, items[key] == dropped["k"], "left_anti")


def without_near_duplicates(items: DataFrame, *, vocabulary: tuple[str, ...], threshold: float = 0.7, key: str = "pos", text: str = "text", within: Column | None = None) -> DataFrame:
    """Keeps an item unless its keyword set is similar to that of an earlier one that was kept.

    Items with the same set, after the first, go in any case; what is left is decided among the first ones.
    """
    pairs = keyword_pairs(items, vocabulary=vocabulary, threshold=threshold, key=key, text=text, within=within)
    pairs = stored(pairs, "keyword-pairs")
    same = pairs.filter("similarity = 1").select(F.col("b").alias("_same"))
    return greedy_kept(items.join(same, items[key] == same["_same"], "left_anti"), pairs.filter("similarity < 1"), key=key)


def prioritized(items: DataFrame, *, month: str, score: str, key: str = "pos", text: str = "text", vocabulary: tuple[str, ...], threshold: float = 0.7, least: float = 2.0, most: int = 10) -> DataFrame:
    """Near-duplicates go within each month ('unknown' where there is none), then low scores; the best of each month stay."""
    rows = items.withColumn(month, F.coalesce(F.col(month), F.lit("unknown")))
    kept = without_near_duplicates(rows, vocabulary=vocabulary, threshold=threshold, key=key, text=text, within=F.col(month)).filter(F.col(score) >= least)
    place = F.row_number().over(Window.partitionBy(month).orderBy(F.desc(score), key))
    return kept.withColumn("place", place).filter(F.col("place") <= most)


def month_consistent(items: DataFrame, *, found: str, searched: str, score: str, key: str, least: float = 2.0, most: int = 10) -> DataFrame:
    """Rows whose own month is unknown or the one that was searched, with enough score; the best of each searched month."""
    ok = items.filter((F.col(found).isNull() | (F.col(found) == F.col(searched))) & (F.col(score) >= least))
    place = F.row_number().over(Window.partitionBy(searched).orderBy(F.desc(score), key))
    return ok.withColumn("place", place).filter(F.col("place") <= most)


def assign_to_events(items: DataFrame, edges: DataFrame, *, verdicts: DataFrame | None = None, key: str = "pos") -> DataFrame:
    """(pos, event): each item in order joins the event of the best earlier leader, or leads a new one.

    edges (a, b, dot) hold the pairs over the threshold and within the days, a < b.  The best leader has the greatest dot
    product, the first of equals; if ``verdicts`` (a, b, same) refuse it, no other is tried.
    """
    e = edges.select("a", "b", "dot")
    if verdicts is not None:
        e = e.join(verdicts.select("a", "b", "same"), ["a", "b"], "left").withColumn("same", F.coalesce("same", F.lit(True)))
    else:
        e = e.withColumn("same", F.lit(True))
    ship(items.sparkSession)
    open_, rounds = stored(e, "assign-edges"), 0
    done = []  # decided items that are no leaders, with their leader
    leaders: DataFrame = stored(items.select(F.col(key).alias("k")).join(open_.select(F.col("b").alias("k")).distinct(), "k", "left_anti"), "leaders")
    pending = stored(open_.select(F.col("b").alias("k")).distinct(), "pending")
    while pending.limit(1).count():
        if rounds and rounds % ROUNDS == 0:
            left = open_.join(pending.withColumnRenamed("k", "b"), "b", "left_semi").join(leaders.select(F.col("k").alias("a"), F.lit(1).cast("long").alias("leads")), "a", "left")
            linked = left.select("a", "b").join(pending.withColumnRenamed("k", "a"), "a", "left_semi")
            small, large = split(left.select("a", "b", "dot", F.col("same").cast("long").alias("same"), F.coalesce("leads", F.lit(0)).alias("leads")), linked, "b")
            order, columns, schema = [F.col("b"), F.desc("dot"), F.col("a")], ("a", "b", "same", "leads"), "k long, leader long"
            found = [walked(small, order, columns, _assignment, schema)]
            for part in slices(large, "b"):
                lead = few(_union(found).filter("leader is null").select(F.col("k").alias("a"), F.lit(True).alias("_leads")))
                part = part.join(lead, "a", "left").withColumn("leads", F.when(F.col("_leads"), 1).otherwise(F.col("leads")).cast("long"))
                found.append(walked(part, order, columns, _assignment, schema))
            done.append(_union(found).filter("leader is not null"))
            leaders = leaders.union(_union(found).filter("leader is null").select("k"))
            break
        rounds += 1
        waiting = open_.join(pending.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct()
        ready = pending.join(waiting, "k", "left_anti")
        options = open_.join(ready.withColumnRenamed("k", "b"), "b", "left_semi").join(leaders.withColumnRenamed("k", "a"), "a", "left_semi")
        best = options.groupBy("b").agg(F.max_by(F.struct("a", "same"), F.struct("dot", -F.col("a"))).alias("best"))
        decided = stored(ready.join(best, ready["k"] == best["b"], "left").select("k", F.when(F.coalesce(F.col("best.same"), F.lit(False)), F.col("best.a")).alias("leader")), "decided")
        done.append(decided.filter("leader is not null"))
        leaders = stored(leaders.union(decided.filter("leader is null").select("k")), "leaders")
        pending = stored(pending.join(decided.select("k"), "k", "left_anti"), "pending")
    out = leaders.select(F.col("k").alias(key), F.col("k").alias("event"))
    for d in done:
        out = out.union(d.select(F.col("k").alias(key), F.col("leader").alias("event")))
    return out


def _assignment():
    """Edges come by item, best first: the first one to a leader counts."""
    leaders: set[int] = set()
    now, open_ = None, False

    def step(*edge):
        nonlocal now, open_
        out = []
        if now is not None and open_ and (not edge or edge[1] != now):  # no leader was near
            leaders.add(now)
            out.append((now, None))
            open_ = False
        if edge:
            a, b, same, leads = edge
            if b != now:
                now, open_ = b, True
            if open_ and (leads or a in leaders):
                open_ = False
                if same:
                    out.append((b, a))
                else:
                    leaders.add(b)
                    out.append((b, None))
        return out

    return step


def merged_once(events: DataFrame, edges: DataFrame, *, verdicts: DataFrame | None = None, key: str = "pos") -> DataFrame:
    """(pos, into): in order, each event that wasn't taken takes the best later one that is free; a refused best is not replaced.

    edges (a, b, weight) are the pairs that may merge, a < b; of equal weights the first counts.  An event decides when no
    undecided earlier event could take it or any of its candidates.
    """
    e = edges.select("a", "b", "weight")
    if verdicts is not None:
        e = e.join(verdicts.select("a", "b", "same"), ["a", "b"], "left").withColumn("same", F.coalesce("same", F.lit(True)))
    else:
        e = e.withColumn("same", F.lit(True))
    ship(events.sparkSession)
    open_, taken, rounds = stored(e, "merge-edges"), [], 0
    while open_.limit(1).count():
        if rounds and rounds % ROUNDS == 0:
            order, columns, schema = [F.col("a"), F.desc("weight"), F.col("b")], ("a", "b", "same"), "k long, into long"
            small, large = split(open_.select("a", "b", "weight", F.col("same").cast("long").alias("same")), open_, "a")
            taken.append(walked(small, order, columns, _merging, schema))
            found: list[DataFrame] = []
            for part in slices(large, "a"):
                for side in ("a", "b") if found else ():
                    part = part.join(few(_union(found).select(F.col("k").alias(side))), side, "left_anti")
                found.append(walked(part, order, columns, _merging, schema))
            taken += found
            break
        rounds += 1
        # the earliest undecided event that may take each event
        first = open_.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("first"))
        blocked_self = open_.select(F.col("a").alias("k")).distinct().join(first, "k", "left_semi")
        checked = open_.join(first.select(F.col("k").alias("b"), "first"), "b")
        blocked = checked.filter("first < a").select(F.col("a").alias("k")).distinct().union(blocked_self)
        ready = stored(open_.select(F.col("a").alias("k")).distinct().join(blocked, "k", "left_anti"), "ready")
        chosen = open_.join(ready.withColumnRenamed("k", "a"), "a", "left_semi").groupBy("a").agg(F.max_by(F.struct("b", "same"), F.struct("weight", -F.col("b"))).alias("best"))
        took = stored(chosen.filter("best.same").select(F.col("best.b").alias("k"), F.col("a").alias("into")), "taken")
        taken.append(took)
        used = took.select("k")
        open_ = stored(open_.join(ready.withColumnRenamed("k", "a"), "a", "left_anti").join(used.withColumnRenamed("k", "a"), "a", "left_anti").join(used.withColumnRenamed("k", "b"), "b", "left_anti"), "merge-edges")
    out = events.select(key)
    if not taken:
        return out.withColumn("into", F.col(key))
    all_taken = _union(taken)
    return out.join(all_taken, out[key] == all_taken["k"], "left").select(key, F.coalesce("into", key).alias("into"))


def _merging():
    """Edges come by event, best first: the first one to a free event counts, unless the event itself was taken."""
    taken: set[int] = set()
    done = None

    def step(*edge):
        nonlocal done
        if not edge:
            return []
        a, b, same = edge
        if a == done or a in taken or b in taken:
            return []
        done = a
        if not same:
            return []
        taken.add(b)
        return [(b, a)]

    return step


def merged_similar(events: DataFrame, *, threshold: float, band: Column, weigh: Callable, same: Callable[[Column, Column], Column] | None = None, key: str = "pos", vector: str = "vector", day: str = "date") -> DataFrame:
    """(pos, into) as ``merged_once`` of all pairs over the threshold gives it, without a table of them.

    ``weigh`` is that of ``best_pairs``; ``same`` is the verdict on a pair.  An event's best options are enough until all of them are taken.  The pass
    walks through them in slices of its order and stops at such an event; options of the events that are left are then looked for anew.  Where
    it stops early, events know four times as many.
    """
    ship(events.sparkSession)
    every = stored(events.select(key, vector, day, band.alias("_band")), "events")
    left, taken, most, n = every, [], OPTIONS, every.count()
    while True:
        options = best_pairs(left, threshold=threshold, band=F.col("_band"), weigh=weigh, most=most, key=key, vector=vector, day=F.col(day))
        rows = options.select("a", "b", "weight", (F.lit(1) if same is None else same(F.col("a"), F.col("b")).cast("long")).cast("long").alias("same"), (F.col("place") == most).cast("long").alias("last"))
        found: list[DataFrame] = []
        for part in slices(rows, "a"):
            if found:
                gone = few(_union(found).select("k"))
                part = part.join(gone.withColumnRenamed("k", "a"), "a", "left_anti").join(gone.select(F.col("k").alias("b"), F.lit(1).alias("_gone")), "b", "left")
                part = part.withColumn("gone", F.coalesce("_gone", F.lit(0)).cast("long"))
            else:
                part = part.withColumn("gone", F.lit(0).cast("long"))
            found.append(walked(part, [F.col("a"), F.desc("weight"), F.col("b")], ("a", "b", "same", "gone", "last"), _merging_known, "k long, into long"))
            stop = found[-1].filter("into is null").first()
            if stop:
                found[-1] = found[-1].filter("into is not null")
                break
        taken += found
        if not found or not stop:
            break
        left = stored(left.filter(F.col(key) >= stop["k"]).join(few(_union(found).select(F.col("k").alias(key))), key, "left_anti"), "left-events")
        rest = left.count()
        most, n = (4 * most if rest > 3 * n / 4 else most), rest
    if not taken:
        return events.select(key, F.col(key).alias("into"))
    return every.select(F.col(key).alias("k")).join(few(_union(taken)), "k", "left").select(F.col("k").alias(key), F.coalesce("into", "k").alias("into"))


def _merging_known():
    """As ``_merging``, for options of which some may be gone before and the last of a full list may not be the last that there is."""
    taken: set[int] = set()
    done, stopped = None, False

    def step(*edge):
        nonlocal done, stopped
        if stopped or not edge:
            return []
        a, b, same, gone, last = edge
        if a == done or a in taken:
            return []
        if gone or b in taken:
            stopped = bool(last)
            return [(a, None)] if last else []
        done = a
        if not same:
            return []
        taken.add(b)
        return [(b, a)]

    return step


def near_or_far(*, near: float, far: float) -> Callable:
    """The weights of ``merge_weights`` for ``best_pairs``."""
    return lambda dots, days: np.where(dots > np.where(days > 365, far, near), dots * (1 - np.fmin(days / 365, 0.5)), np.nan)


def apart(*, least: float, days: int = 90) -> Callable:
    """The weights of ``apart_weights`` for ``best_pairs``."""
    return lambda dots, between: np.where((between > days) & (dots > least), dots, np.nan)


def merge_weights(pairs: DataFrame, *, near: float = 0.4, far: float = 0.7) -> DataFrame:
    """(a, b, weight) of pairs (a, b, dot, days): the dot product less up to half of it by the days between; pairs over a year apart need more."""
    rows = pairs.filter(F.col("dot") > F.when(F.col("days") > 365, far).otherwise(near))
    return rows.select("a", "b", (F.col("dot") * (1 - F.least(F.col("days") / 365, F.lit(0.5)))).alias("weight"))


def apart_weights(pairs: DataFrame, *, least: float = 0.75, days: int = 90) -> DataFrame:
    """(a, b, weight) of the pairs (a, b, dot, days) that are more than so many days apart."""
    return pairs.filter((F.col("days") > days) & (F.col("dot") > least)).select("a", "b", F.col("dot").alias("weight"))


def _directed(df: DataFrame, name: str) -> DataFrame:
    rows = df.select(F.col("id").cast("long").alias("k"), F.transform("vector", lambda x: x.cast("double")).alias("v"), F.lit(0).cast("long").alias("band"), F.lit(None).cast("int").alias("day"))
    return _packed(rows.filter(F.col("k").isNotNull() & F.exists("v", lambda x: x != 0)), name, most=BLOCK, unit=True)


def top_similar(queries: DataFrame, history: DataFrame, *, k: int = 5) -> DataFrame:
    """(query, id, rank, similarity): the k rows of the history with the greatest cosine to each query, itself left out.

    Both sides are packed into balls of directions.  A block of queries first meets the FIRST blocks that may hold the nearest rows; the
    k-th similarity that its queries have then closes all blocks whose bound lies below it, and the others are met, tile by tile.  Ties go to the
    smaller id.  A null vector and one of zeros are like nothing, and vectors of different length are not alike.
    """
    return _searched(queries, history, k)[0]


def share_visited(queries: DataFrame, history: DataFrame, *, k: int = 5) -> float:
    """The pairs of blocks whose bounds let them meet in ``top_similar``, as a share of all."""
    _, every, bottom = _searched(queries, history, k)
    open_ = every.filter(F.col("place") > FIRST).join(few(bottom), "left_id").filter(F.col("bound") >= F.col("bottom") - 2e-6)
    return (every.filter(F.col("place") <= FIRST).count() + open_.count()) / max(1, every.count())


def _searched(queries: DataFrame, history: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``top_similar``, (left_id, right_id, bound, place) of all pairs of blocks, and (left_id, bottom) of the query blocks."""
    left, right = _directed(queries, "query"), _directed(history, "history")
    every = _ball(left, "left").drop("band").join(_ball(right, "right").drop("band"), "dim").select("left_id", "right_id", _bound().alias("bound"))
    place = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("bound"), "right_id"))
    every = stored(every.withColumn("place", place), "visits")
    a, b = left.select(F.col("id").alias("left_id"), F.col("items").alias("left")), right.select(F.col("id").alias("right_id"), F.col("items").alias("right"))

    def nearest(ka: np.ndarray, a: np.ndarray, kb: np.ndarray, b: np.ndarray, least: np.ndarray | float) -> tuple:
        na, nb = (np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) for x in (a, b))
        rough = a @ b.T / (na[:, None] * nb[None, :])
        rough[ka[:, None] == kb[None, :]] = -np.inf
        kth = np.partition(rough, max(len(kb) - k, 0), axis=1)[:, max(len(kb) - k, 0)]
        i, j = np.nonzero((rough >= np.maximum(kth, least)[:, None] - 2e-6) & (rough > -np.inf))
        # in the order in which SQL adds, and rounded like it, so that ties are ties
        exact = _rounded(np.cumsum(a[i] * b[j], axis=1)[:, -1] / (na[i] * nb[j]), 6) if len(i) else np.empty(0)
        return ka[i], kb[j], exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                found = nearest(*_items(batch.column(0)[n]), *_items(batch.column(1)[n]), -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query", "id", "similarity"])

    def kernel(left_: _Side, right_: _Side) -> Iterator[tuple]:
        bottom = np.array([b["bottom"].as_py() for b in left_.blocks])
        least = np.concatenate([b["least"].values.to_numpy() for b in left_.blocks])
        for at, place in left_.chunks():
            near = (left_.bounds(at, right_) >= bottom[at, None] - 2e-6).any(axis=0)
            if near.any():
                to = np.flatnonzero(np.repeat(near, right_.sizes))
                yield nearest(left_.keys[place], left_.vectors[place], right_.keys[to], right_.vectors[to], least[place])

    schema = "query long, id long, similarity double"
    by_score = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)

    first = every.filter(F.col("place") <= FIRST).select("left_id", "right_id").join(a, "left_id").join(b, "right_id").select("left", "right").mapInArrow(run, schema)
    first = stored(best(first), "first")
    kth = first.filter(F.col("rank") == k).select(F.col("query").alias("k"), F.col("similarity").alias("least"))
    asked = left.select("id", F.posexplode("items.k").alias("place", "k")).join(kth, "k", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    least = stored(asked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "least"))), lambda x: x["least"]).alias("least"), F.min("least").alias("bottom")), "least")
    ours, ours_tiles = _tiles(left.join(least, "id"))
    theirs, their_tiles = _tiles(right)
    pairs = ours_tiles.join(their_tiles.select("dim", F.col("band").alias("right_band"), F.col("tile").alias("right_tile")), "dim")
    # what the first blocks gave is found again, so that each pair counts once
    more = _met(ours, theirs, pairs, ("least", "bottom")).mapInArrow(_by_pair(kernel, ["query", "id", "similarity"]), schema)
    rows = more.union(first.select("query", "id", "similarity")).distinct()
    return best(rows), every, least.select(F.col("id").alias("left_id"), "bottom")


def _rounded(x: np.ndarray, places: int) -> np.ndarray:
    """As SQL rounds: the number times a power of ten, its halves away from 0."""
    x = x * 10.0**places
    whole = np.trunc(x)
    return np.where(np.abs(x - whole) == 0.5, whole + np.sign(x), np.rint(x)) / 10.0**places


def default_prediction(queries: DataFrame, similar: DataFrame, facts: DataFrame) -> DataFrame:
    """(query, label, confidence, neighbours): the label of the most similar, 'Unknown' where there is none, and the three nearest."""
    rows = similar.join(facts.select("id", "label"), "id")
    short = (F.round(F.col("similarity") * 1000, 0) / 1000).alias("similarity")  # as SQL: F.round(…, 3) would round the decimal that is printed
    best = rows.groupBy("query").agg(F.min_by("label", "rank").alias("label"), F.min_by("similarity", "rank").alias("confidence"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "id", short)))).alias("n"))
    listed = F.array_join(F.transform("n", lambda x: F.concat_ws(":", x["id"].cast("string"), x["similarity"].cast("string"))), ", ")
    out = queries.select(F.col("id").alias("query")).join(best, "query", "left")
    return out.select("query", F.coalesce(F.col("label").cast("string"), F.lit("Unknown")).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce(listed, F.lit("")).alias("neighbours"))


def phrase_sections(sections: DataFrame, phrases: DataFrame, *, least: float = 0.4, k: int = 10) -> DataFrame:
    """The k sections with the greatest cosine to any phrase, over a least one; sections meet phrases in balls, however many there are."""
    below = F.lit((sections.agg(F.min("id")).first()[0] or 0) - 1) - F.monotonically_increasing_id()  # ids that no section has
    named = stored(phrases.select("vector").withColumn("id", below), "phrases")
    best = top_similar(sections.select("id", "vector"), named, k=1).select(F.col("query").alias("id"), "similarity")
    return best.filter(F.col("similarity") > least).orderBy(F.desc("similarity"), "id").limit(k)


# Words that tell of an older event, and nouns of historic events.
TEMPORAL_WORDS = ("recalling", "anniversary", "years ago", "previously", "in 20", "decade", "earlier", "past", "remembering")
RECENT_TEMPORAL_WORDS = ("in 20", "years ago", "previously", "recalling", "anniversary", "decade", "earlier", "past")
CONFUSION_WORDS = ("recalling", "anniversary", "previously", "years ago")
HISTORIC_NOUNS = ("grounding", "strike", "fine", "scandal", "incident", "accident", "crash", "dispute", "controversy")


def suspicious_dates(events: DataFrame, articles: DataFrame, *, temporal: tuple[str, ...] = TEMPORAL_WORDS, recent: tuple[str, ...] = RECENT_TEMPORAL_WORDS, confusion: tuple[str, ...] = CONFUSION_WORDS, nouns: tuple[str, ...] = HISTORIC_NOUNS) -> DataFrame:
    """(event, suspicious): whether an event's date is far from its articles', or near and told of as past.

    events (event, name, date), articles (event, date, text).  Whether a word occurs in any article is found in each.
    """
    from ..functions.text import any_word

    text = F.lower("text")
    rows = articles.select("event", F.col("date").alias("_d"), *[any_word(text, w).alias(n) for n, w in (("_t", temporal), ("_r", recent), ("_c", confusion))]).join(events.select("event", F.col("date").alias("_e")), "event")
    days = F.abs(F.datediff("_e", "_d"))
    g = rows.groupBy("event").agg(F.max(days).alias("far"), F.min(days).alias("near"), F.min(F.year("_d")).alias("year"), F.bool_or("_t").alias("t"), F.bool_or("_r").alias("r"), F.bool_or("_c").alias("c"))
    out = events.join(g, "event", "left")
    flag = F.when(F.col("far") > 180, True).when((F.col("near") <= 7) & F.col("t"), True)
    flag = flag.when((F.col("year") >= 2024) & (F.year("date") >= 2024) & F.col("r") & any_word(F.lower("name"), nouns), True).when((F.col("far") >= 30) & F.col("c"), True).otherwise(False)
    return out.select("event", flag.alias("suspicious"))


def corrected_dates(events: DataFrame, verified: DataFrame) -> DataFrame:
    """Flagged events take the verified date where there is another one; ``changed`` tells where."""
    rows = events.join(verified.select("event", F.col("date").alias("_v")), "event", "left")
    use = F.col("suspicious") & F.col("_v").isNotNull() & (F.col("_v") != F.col("date"))
    return rows.withColumn("changed", F.coalesce(use, F.lit(False))).withColumn("date", F.when(F.col("changed"), F.col("_v")).otherwise(F.col("date"))).drop("_v")


def relevant_events(events: DataFrame, articles: DataFrame, *, term: str, off_topic: tuple[str, ...]) -> DataFrame:
    """Events that name the term, are flagged, or have an article that does; off-topic names without the term go."""
    from ..functions.text import any_word

    mention = articles.filter(F.contains(F.lower("text"), F.lit(term))).select(F.col("event").alias("_m")).distinct()
    named = F.contains(F.lower("name"), F.lit(term)) | F.contains(F.lower("entity"), F.lit(term))
    rows = events.join(mention, events["event"] == mention["_m"], "left")
    keep = (named | F.col("flag") | F.col("_m").isNotNull()) & ~(any_word(F.lower("name"), off_topic) & ~named)
    return rows.filter(keep).drop("_m")


def event_rollup(articles: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """By event: number of articles, mean scores, and the stakeholders, responses and urls of its articles in order.

    ``events`` (event, stakeholders, responses) may know more stakeholders and responses of its own.  Sets are made distinct
    before they are collected.
    """
    out = articles.groupBy("event").agg(F.count("*").alias("num_articles"), F.round(F.avg("damage"), 2).alias("mean_damage"), F.round(F.avg("response"), 2).alias("mean_response"), F.array_sort(F.collect_list("url")).alias("urls"))
    for c in ("stakeholders", "responses"):
        if c in articles.columns:
            rows = articles.select("event", F.explode(c).alias("_item"))
            if events is not None:
                rows = rows.union(events.select("event", F.explode(c)))
            sets = rows.filter("_item is not null").distinct().groupBy(F.col("event").alias("_event")).agg(F.array_sort(F.collect_list("_item")).alias(c))
            out = out.join(sets, F.col("event").eqNullSafe(F.col("_event")), "left").drop("_event").withColumn(c, F.coalesce(c, F.array().cast(dict(articles.dtypes)[c])))
    return out

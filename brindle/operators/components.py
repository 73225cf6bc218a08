"""Connected components, and passes in order inside each of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.articles import few, stored

#: Edges of a component that one task walks through in order at once; a larger one is walked through in slices of about as many.
MOST_EDGES = 2_000_000
#: Edges a node from which on a graph is taken for one large component.
DENSE = 8


def _roots(to: DataFrame) -> DataFrame:
    """(node, to) with every node at the end of its chain: what each points to is replaced by what that points to, until nothing changes.

    Chains halve each time.
    """
    while True:
        next_ = to.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        jumped = to.join(few(next_), "to", "left").select("node", F.coalesce("_next", "to").alias("to"), (F.col("_next") != F.col("to")).alias("_moved"))
        jumped = stored(jumped, "jumped")
        to = jumped.select("node", "to")
        if not jumped.filter("_moved").limit(1).count():
            return to


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); a component is named by its smallest node.

    In each round every node points to its smallest neighbour, if that is smaller; chains of such pointers are followed to
    their ends by doubling, and the edges move along.  The nodes that are left fall by half or more in every two rounds, and a path of n
    nodes takes about log2(n) doublings in whatever order its nodes are numbered.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        moved = _roots(stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")), "moved"))
        from_, to = few(moved.select(F.col("node").alias("a"), F.col("to").alias("ta"))), few(moved.select(F.col("node").alias("b"), F.col("to").alias("tb")))
        edges = stored(edges.join(from_, "a").join(to, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = moved.select("node", F.col("to").alias("component"))
        else:
            step = few(moved.select(F.col("node").alias("component"), "to"))
            labels = stored(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def split(edges: DataFrame, linked: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """The edges of the components that a task can walk through, with their component, and the edges of larger ones.

    Components are those of ``linked`` edges; an edge belongs to the component of its ``node``, which may be one of its own.
    The components of a dense graph are not looked for: it is taken for a large one.
    """
    if edges.count() > DENSE * edges.select(node).distinct().count():
        return edges.limit(0).withColumn("component", F.lit(0).cast("long")), edges
    found = components(linked).withColumnRenamed("node", "_node")
    placed = edges.join(few(found), F.col(node) == F.col("_node"), "left").withColumn("component", F.coalesce("component", F.col(node))).drop("_node")
    placed = stored(placed, "placed-edges")
    large = few(placed.groupBy("component").agg(F.count("*").alias("_n")).filter(F.col("_n") > MOST_EDGES).select("component"))
    return placed.join(large, "component", "left_anti"), placed.join(large, "component", "left_semi").drop("component")


def slices(edges: DataFrame, node: str) -> Iterator[DataFrame]:
    """The edges in slices of about MOST_EDGES, in the order of their ``node``; all edges of a node are in one slice."""
    edges = stored(edges, "unsliced")
    n = math.ceil(edges.count() / MOST_EDGES)
    if not n:
        return
    cuts = sorted(set(edges.approxQuantile(node, [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    ordered = stored(edges.repartitionByRange(n, node).sortWithinPartitions(node), "slices") if cuts else edges
    at = F.col(node).cast("double")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        one = ordered if low is None else ordered.filter(at > low)
        yield (one if high is None else one.filter(at <= high)).withColumn("component", F.lit(0).cast("long"))


def walked(edges: DataFrame, order: list[Column], columns: tuple[str, ...], step: Callable[[], Callable], schema: str) -> DataFrame:
    """The decisions of a pass over the edges of each component in order, written.

    ``step()`` is a new state for a component: a function of an edge's columns, or of nothing at the component's end, that returns the
    decisions it comes to.  A task holds the state of one component at a time, and not its edges.
    """
    rows = edges.repartition("component").sortWithinPartitions("component", *order).select("component", *columns)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def packed(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

        for batch in batches:
            found: list[tuple] = []
            for component, *edge in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or component != now:
                    if state is not None:
                        found += state()
                    now, state = component, step()
                found += state(*edge)
            if found:
                yield packed(found)
        if state is not None and (found := state()):
            yield packed(found)

    return stored(rows.mapInArrow(run, schema), "decisions")

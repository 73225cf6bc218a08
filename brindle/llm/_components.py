"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import few, written


def _roots(to: DataFrame) -> DataFrame:
    """(node, to) with every node at the end of its chain: what each points to is replaced by what that points to, until nothing changes.

    Chains halve each time.
    """
    while True:
        next_ = to.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        jumped = to.join(few(next_), "to", "left").select("node", F.coalesce("_next", "to").alias("to"), (F.col("_next") != F.col("to")).alias("_moved"))
        jumped = written(jumped, "jumped")
        to = jumped.select("node", "to")
        if not jumped.filter("_moved").limit(1).count():
            return to


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); a component is named by its smallest node.

    In each round every node points to its smallest neighbour, if that is smaller; chains of such pointers are followed to
    their ends by doubling, and the edges move along.  A node that has a neighbour is merged with one in every two rounds at
    least, so the nodes that are left fall by half or more, and a path of n nodes takes about log2(n) doublings in whatever
    order its nodes are numbered.  The smallest node of a component never moves, so it is what is left when no edge is.  Each
    step is written to the shared folder, which cuts the lineage.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        moved = _roots(written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")), "moved"))
        from_, to = few(moved.select(F.col("node").alias("a"), F.col("to").alias("ta"))), few(moved.select(F.col("node").alias("b"), F.col("to").alias("tb")))
        edges = written(edges.join(from_, "a").join(to, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = moved.select("node", F.col("to").alias("component"))
        else:
            step = few(moved.select(F.col("node").alias("component"), "to"))
            labels = written(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels

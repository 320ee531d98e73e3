"""Relations of elements beyond one edge: ancestors, common ancestors and distances in the trees of screens.

A node's id is its path of places from the root (0, 0.0, 0.1, ...), so its ancestors are the prefixes of the
path: no recursion, and the work is the number of nodes times their depth. Nodes of different screens never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.sources.scratch import save

#: Nodes of a task, about: saved ids are so alike that their files say little about the memory they take.
TASK_NODES = 100_000


def steps(path: Column) -> Column:
    return F.split(path, r"\.")


def depth(path: Column) -> Column:
    """0 at the root."""
    return F.size(steps(path)) - 1


def common_depth(a: Column, b: Column) -> Column:
    """Number of steps that two paths share from the root; their lowest common ancestor is one less deep."""
    same = F.zip_with(steps(a), steps(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def common_ancestor(a: Column, b: Column) -> Column:
    """Path of the lowest common ancestor, which may be one of both; null for nodes without a common root."""
    n = common_depth(a, b)
    return F.when(n > 0, F.array_join(F.slice(steps(a), F.lit(1), F.greatest(n, F.lit(1))), "."))


def distance(a: Column, b: Column) -> Column:
    """Edges between two nodes of a tree."""
    return F.size(steps(a)) + F.size(steps(b)) - 2 * common_depth(a, b)


def relation(a: Column, b: Column) -> Column:
    """What b is to a: self, ancestor, descendant, sibling (of one parent) or other."""
    n, na, nb = common_depth(a, b), F.size(steps(a)), F.size(steps(b))
    kind = F.when((n == na) & (n == nb), "self").when(n == nb, "ancestor").when(n == na, "descendant")
    return kind.when((na == nb) & (n == na - 1), "sibling").otherwise("other")


def lineage(nodes: DataFrame, limit: int | None = None, *more: str) -> DataFrame:
    """screen_id, node_id, ancestor_id and up (edges between them) for each node and each of its ancestors, itself included (up 0); `limit` is the most edges, `more` the node's columns to keep."""
    n = F.size(steps(F.col("node_id")))
    lowest = F.lit(1) if limit is None else F.greatest(n - limit, F.lit(1))
    rows = nodes.where("screen_id IS NOT NULL AND node_id IS NOT NULL").select("screen_id", "node_id", *more, F.explode(F.sequence(lowest, n)).alias("k"))
    path = F.array_join(F.slice(steps(F.col("node_id")), F.lit(1), F.col("k")), ".")
    return rows.select("screen_id", "node_id", path.alias("ancestor_id"), (n - F.col("k")).alias("up"), *more)


def by_screen(nodes: DataFrame) -> DataFrame:
    """Nodes saved, and dealt by screen into so many tasks as their number asks for; what groups by screen needs no more shuffles."""
    kept = save(nodes.where("screen_id IS NOT NULL AND node_id IS NOT NULL"))
    return kept.repartition(kept.count() // TASK_NODES + 1, "screen_id")


def subtrees(nodes: DataFrame, *more: str) -> DataFrame:
    """screen_id, node_id, n_below (nodes under it), height (edges to the deepest of them) and the node's own columns `more`."""
    own = F.when(F.col("up") == 0, F.struct(*more)) if more else None
    found = lineage(nodes, None, *more).groupBy("screen_id", F.col("ancestor_id").alias("node_id"))
    below = found.agg((F.count("*") - 1).alias("n_below"), F.max("up").alias("height"), *([F.max(own).alias("own")] if more else []))
    return below.select("screen_id", "node_id", "n_below", "height", *(F.col("own")[c].alias(c) for c in more))


def around(nodes: DataFrame, is_anchor: Column, limit: int) -> DataFrame:
    """Nodes (screen_id, node_id, ord and others) at most `limit` edges from their screen's anchor, the first node by ord that is one, with anchor_id, ancestor_id and distance.

    One window over a screen's nodes: nothing is joined, so no side can be taken for small and broadcast.
    """
    first = F.min(F.when(is_anchor, F.struct("ord", "node_id"))).over(Window.partitionBy("screen_id"))
    anchor, node = F.col("anchor_id"), F.col("node_id")
    met = nodes.where("screen_id IS NOT NULL AND node_id IS NOT NULL").withColumn("anchor_id", first["node_id"]).withColumns({"ancestor_id": common_ancestor(anchor, node), "distance": distance(anchor, node)})
    return met.where((F.col("distance") <= limit) & F.col("ancestor_id").isNotNull())


def within(anchors: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """screen_id, anchor_id, node_id, ancestor_id and distance of nodes at most `limit` edges from an anchor of their screen.

    anchors: screen_id and anchor_id, a few for each screen. Both sides go up at most `limit` edges and
    meet in their lowest common ancestor alone: where they meet, the next steps down must differ.
    """
    below = lambda own: F.when(F.col("up") > 0, F.get(steps(F.col(own)), F.size(steps(F.col(own))) - F.col("up")))
    theirs = lineage(nodes.select("screen_id", "node_id"), limit).withColumn("step", below("node_id"))
    mine = lineage(anchors.select("screen_id", F.col("anchor_id").alias("node_id")), limit).withColumn("mine", below("node_id"))
    mine = mine.select("screen_id", "ancestor_id", F.col("node_id").alias("anchor_id"), F.col("up").alias("own_up"), "mine")
    met = mine.join(theirs.hint("shuffle_merge"), ["screen_id", "ancestor_id"])  # files of ids are far smaller than their rows: neither side may be broadcast by that size
    lowest = F.col("mine").isNull() | F.col("step").isNull() | (F.col("mine") != F.col("step"))
    return met.where(lowest & (F.col("own_up") + F.col("up") <= limit)).select("screen_id", "anchor_id", "node_id", "ancestor_id", (F.col("own_up") + F.col("up")).alias("distance"))

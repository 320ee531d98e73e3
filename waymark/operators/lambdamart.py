"""LambdaMART: regression trees fitted to the gradients of NDCG, by rounds of distributed histograms.

Every query has one right candidate. In a round, each other candidate of the query makes a pair with it: the
pair's weight is how much NDCG would change if both swapped places, its pull the logistic loss of their
scores. Pulls add up to a gradient and a curvature for each candidate; a tree is fitted to them by
Newton steps and its leaves are added to the scores.

* Gradients are rounded to whole numbers of 2^-24, so that sums don't depend on the order in which tasks
  end: a retried or repeated job grows the same trees.
* Features are cut into BINS bins of about equal numbers of rows, by counts of CELLS cells of equal width
  (exact, over all rows). Splits are found from sums for (node, feature, bin); only these, at most
  2^DEPTH * features * BINS rows, come to the driver.
* The binned rows are written once, in buckets of query_id: the window of a round needs no exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators.rank import top
from waymark.sources.scratch import save_by

ROUNDS, DEPTH, RATE = 8, 3, 0.5
BINS, CELLS, LEAST_ROWS = 32, 1024, 20
#: One in gradients and curvatures, and what is added to curvatures of a node (in that unit).
UNIT = 1 << 24
RIDGE = UNIT


class Axis(NamedTuple):
    """How a feature is binned: its range, and the bin of each cell."""

    name: str
    low: float
    high: float
    bins: list[int]

    def cell(self) -> Column:
        """Number of the value's cell; -1 for null and NaN, which always go left."""
        x = F.col(self.name).cast("double")
        if self.high <= self.low:
            return F.when(x.isNotNull() & ~F.isnan(x), 0).otherwise(-1)
        at = F.floor((x - self.low) / (self.high - self.low) * CELLS)
        return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.least(at, F.lit(CELLS - 1)), F.lit(0))).otherwise(-1).cast("int")

    def bin(self) -> Column:
        """Number of the value's bin, -1 for null and NaN."""
        return F.when(self.cell() < 0, -1).otherwise(F.get(F.array(*map(F.lit, self.bins)), self.cell()))


class Split(NamedTuple):
    feature: int
    bin: int


class Tree(NamedTuple):
    """Splits by node (1 is the root, n has 2n and 2n + 1 below it) and the values of the 2^depth leaves."""

    depth: int
    splits: dict[int, Split]
    values: dict[int, float]

    def node(self, level: int, bin_of: Callable[[int], Column]) -> Column:
        """The node at a level that a row comes to; a node without a split hands all to its left."""
        at = F.lit(1)
        for upper in range(level):
            for n in reversed(range(1 << upper, 2 << upper)):
                split = self.splits.get(n)
                left = F.lit(True) if split is None else bin_of(split.feature) <= split.bin
                own = F.when(left, 2 * n).otherwise(2 * n + 1)
                below = own if n == (2 << upper) - 1 else F.when(at == n, own).otherwise(below)
            at = below
        return at

    def value(self, bin_of: Callable[[int], Column], n: int = 1) -> Column:
        """What the tree adds to a row's score."""
        if n >= 1 << self.depth:
            return F.lit(self.values.get(n, 0.0))
        split = self.splits.get(n)
        if split is None:
            return self.value(bin_of, 2 * n)
        return F.when(bin_of(split.feature) <= split.bin, self.value(bin_of, 2 * n)).otherwise(self.value(bin_of, 2 * n + 1))


class Model(NamedTuple):
    axes: list[Axis]
    trees: list[Tree]

    def score(self, bin_of: Callable[[int], Column]) -> Column:
        """The model as one column over columns of bins."""
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + tree.value(bin_of)
        return total

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with their score; each feature is binned once."""
        binned = rows.select("*", F.struct(*(a.bin().alias(f"b{i}") for i, a in enumerate(self.axes))).alias("_bins"))
        return binned.withColumn("score", self.score(lambda f: F.col("_bins")[f"b{f}"])).drop("_bins")

    def exported(self, spark: SparkSession) -> DataFrame:
        """tree, node, feature, bin and below (the least value that goes right) of splits; tree, node and value of leaves."""
        rows = []
        for t, tree in enumerate(self.trees):
            for n, s in sorted(tree.splits.items()):
                axis = self.axes[s.feature]
                cells = sum(b <= s.bin for b in axis.bins)
                rows.append((t, n, axis.name, s.bin, axis.low + cells * (axis.high - axis.low) / CELLS, None))
            rows += [(t, n, None, None, None, v) for n, v in sorted(tree.values.items())]
        return spark.createDataFrame(rows, "tree int, node int, feature string, bin int, below double, value double")


def axes_of(rows: DataFrame, features: list[str]) -> list[Axis]:
    """Bins of each feature from two counts over all rows."""
    clean = rows.select(*(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features))
    ends = clean.agg(*(F.min(f).alias(f"low{i}") for i, f in enumerate(features)), *(F.max(f).alias(f"high{i}") for i, f in enumerate(features))).first()
    bare = [Axis(f, ends[f"low{i}"] or 0.0, ends[f"high{i}"] or 0.0, []) for i, f in enumerate(features)]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), a.cell().alias("cell")) for i, a in enumerate(bare)))).alias("c")
    counts = {(r["f"], r["cell"]): r["n"] for r in clean.select(each).groupBy("c.f", "c.cell").agg(F.count("*").alias("n")).collect()}
    out = []
    for i, a in enumerate(bare):
        total, seen, bins = max(1, sum(counts.get((i, c), 0) for c in range(CELLS))), 0, []
        for c in range(CELLS):
            bins.append(seen * BINS // total if seen < total else BINS - 1)
            seen += counts.get((i, c), 0)
        out.append(a._replace(bins=bins))
    return out


def gradients(scored: DataFrame) -> DataFrame:
    """Adds g and h, in units, to rows (query_id, pos, gold, score): the pull on each candidate and its curvature.

    gold is 1 for the right candidate. Queries without one or without others pull nothing.
    """
    query = Window.partitionBy("query_id")
    rank = F.row_number().over(query.orderBy(F.desc("score"), F.asc("pos")))
    its = lambda c: F.max(F.when(F.col("gold") == 1, F.col(c))).over(query)
    gain = lambda r: math.log(2) / F.log(1.0 + r)
    units = lambda x: F.floor(x * UNIT + 0.5)
    ranked = scored.withColumn("rank", rank).withColumns({"gold_score": its("score"), "gold_rank": its("rank")})
    pull = 1.0 / (1.0 + F.exp(F.col("gold_score") - F.col("score")))
    change = F.abs(gain(F.col("gold_rank")) - gain(F.col("rank")))
    pairs = ranked.withColumns({"lam": units(pull * change), "cur": units(pull * (1.0 - pull) * change)})
    other = F.when(F.col("gold") == 0, F.lit(1))
    sums = {"g": F.when(F.col("gold") == 1, F.sum(other * F.col("lam")).over(query)).otherwise(-F.col("lam")), "h": F.when(F.col("gold") == 1, F.sum(other * F.col("cur")).over(query)).otherwise(F.col("cur"))}
    found = pairs.withColumns({k: F.coalesce(v, F.lit(0)) for k, v in sums.items()})
    return found.drop("rank", "gold_score", "gold_rank", "lam", "cur")


def best_split(sums: list[tuple[int, int, int, int, int]]) -> tuple[Split | None, tuple[int, int], tuple[int, int]]:
    """The split of most gain from a node's (feature, bin, g, h, n), ties to the first, and (g, h) left and right of it."""
    ratio = lambda g, h: float(g) * float(g) / float(h + RIDGE)
    first = min(f for f, *_ in sums)
    total_g, total_h, total_n = (sum(s[i] for s in sums if s[0] == first) for i in (2, 3, 4))
    best, found, sides = 0.0, None, ((total_g, total_h), (0, 0))
    for feature in sorted({f for f, *_ in sums}):
        g = h = n = 0
        for _, b, dg, dh, dn in sorted(s for s in sums if s[0] == feature):
            g, h, n = g + dg, h + dh, n + dn
            if n < LEAST_ROWS or total_n - n < LEAST_ROWS:
                continue
            gain = ratio(g, h) + ratio(total_g - g, total_h - h) - ratio(total_g, total_h)
            if gain > best:
                best, found, sides = gain, Split(feature, b), ((g, h), (total_g - g, total_h - h))
    return found, *sides


def fit(candidates: DataFrame, features: list[str], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Model:
    """Trees for candidates (query_id, pos, gold and features), gold being 1 for a query's right candidate, else 0."""
    model = Model(axes_of(candidates, features), [])
    binned = [a.bin().cast("int").alias(f"b{i}") for i, a in enumerate(model.axes)]
    rows = save_by(candidates.select("query_id", "pos", F.col("gold").cast("int").alias("gold"), *binned), "query_id")
    bin_of = lambda f: F.col(f"b{f}")
    for _ in range(rounds):
        pulled = gradients(rows.withColumn("score", model.score(bin_of))).select("g", "h", *(f"b{i}" for i in range(len(features))))
        pulled = pulled.persist()  # lost parts are computed again
        try:
            model.trees.append(_grown(pulled, len(features), depth, rate, bin_of))
        finally:
            pulled.unpersist()
    return model


def _grown(pulled: DataFrame, n_features: int, depth: int, rate: float, bin_of: Callable[[int], Column]) -> Tree:
    tree = Tree(depth, {}, {})
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), bin_of(i).alias("b")) for i in range(n_features)))).alias("x")
    for level in range(depth):
        at = pulled.select("g", "h", tree.node(level, bin_of).alias("node"), each)
        sums = at.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
        nodes: dict[int, list] = {}
        for r in sums:
            nodes.setdefault(r["node"], []).append((r["f"], r["b"], r["g"], r["h"], r["n"]))
        for n, own in nodes.items():
            split, *sides = best_split(own)
            if split is not None:
                tree.splits[n] = split
            if level == depth - 1:
                for child, (g, h) in zip((2 * n, 2 * n + 1), sides, strict=True):
                    tree.values[child] = rate * (float(g) / float(h + RIDGE))
    return tree


def rank(candidates: DataFrame, model: Model) -> DataFrame:
    """query_id, candidate_id and score of each query's best candidate (ties to the first)."""
    return top(model.scored(candidates)).select("query_id", "candidate_id", "score")


def ndcg(scored: DataFrame) -> DataFrame:
    """Mean NDCG and Top1 over queries that have a right candidate: rows (query_id, pos, gold, score)."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.asc("pos"))
    right = scored.withColumn("rank", F.row_number().over(order)).where("gold = 1")
    return right.agg(F.avg(math.log(2) / F.log(1.0 + F.col("rank"))).alias("ndcg"), F.avg((F.col("rank") == 1).cast("double")).alias("top1"), F.count("*").alias("queries"))

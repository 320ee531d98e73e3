"""Operator 4, mixing sources to target weights: hierarchical budgeting. Native.

Sources hang in a tree domain > language > source. The token budget flows down by weight. A node
never gets more than its capacity (its tokens times the epochs allowed); what it cannot use goes
to its siblings in proportion to their weights, and only what all of them cannot use stays with
the ancestors, whose other children take it. That is exact water-filling at each parent, with
whole tokens, by window functions over the few nodes of the tree.

Each leaf then takes a token-prefix of its documents in a seeded order: whole epochs first, then
the prefix of one more epoch. A prefix ends with the document that reaches the budget, so a leaf
overshoots by less than one document. A hot leaf is not sorted by one task: tokens are summed by
(leaf, bucket of the hash order), windows run over bounded numbers of bins and of buckets, the one
bucket in which the budget ends is cut into buckets again, and only what is left of the leaf, 1 of
4096 * 4096, is ordered by document. The order's key is a hash of the epoch, the id and the text, so documents
of one id, or without ids, are in different places; of rows equal in both as many are taken as the budget needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import join_checked, save, whole

#: Share of the input's tokens that the mixture takes.
SHARE = 0.5
#: A document is used at most so often.
EPOCHS = 4
SEED = "mix-1"
#: Weights in millionths by level and name; names not listed weigh DEFAULT_WEIGHT.
WEIGHTS = {"domain": {"d0": 400_000, "d1": 300_000}, "lang": {"en": 500_000, "de": 250_000}, "source": {"src0": 200_000}}
DEFAULT_WEIGHT = 150_000
#: First and number of the hex digits of the order key that name a bucket in each round: BINS ** 2 buckets for each leaf.
ROUNDS = ((1, 3), (4, 3))
#: Buckets are summed by BINS first, so that no window over a leaf has more rows than these.
BINS = 64
LEVELS = ("domain", "lang", "source")


def tokens_of(text: Column) -> Column:
    """White-space words, one at least, so that every document moves the prefix."""
    return F.greatest(F.size(F.split(F.trim(F.coalesce(text, F.lit(""))), "[ \\t\\n\\r]+")).cast("long"), F.lit(1))


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 4; sources without a number are in d0."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(number == "", 0).otherwise(number.try_cast("int") % 4).cast("string"))


def weight_of(level: str, name: Column, weights: dict, default: int) -> Column:
    chosen = F.lit(default).cast("long")
    for key, value in sorted(weights.get(level, {}).items()):
        chosen = F.when(name == key, F.lit(value).cast("long")).otherwise(chosen)
    return chosen


def _fill(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Water-filling: budget, capacity and weight give each node of a parent its grant.

    A node is full if the level at which it and all fuller ones are served exceeds its capacity
    per weight; the others share what is left by weight, rounded down to tokens. Products are of
    whole numbers in decimals, so no budget is too large for them; capacities per weight are
    ordered by their quotient in tokens and then their rest in millionths.
    """
    order = [F.expr("capacity div weight").asc(), F.expr("(capacity % weight) * 1000000 div weight").asc(), F.col("name").asc()]
    before = Window.partitionBy(*parents).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parents)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    nodes = nodes.withColumns({"left": left, "weight_left": weight_left})
    full = F.expr("cast(capacity as decimal(19,0)) * cast(weight_left as decimal(19,0)) <= cast(`left` as decimal(19,0)) * cast(weight as decimal(19,0))")
    nodes = nodes.withColumn("full", full)
    open_left = F.max(F.when(~F.col("full"), F.struct("weight_left", "left"))).over(whole)
    nodes = nodes.withColumns({"open_left": open_left["left"], "open_weight": open_left["weight_left"]})
    share = F.expr("cast(open_left as decimal(19,0)) * cast(weight as decimal(18,0)) div open_weight")
    grant = F.when(F.col("full"), F.col("capacity")).otherwise(F.least(share, F.col("capacity")))
    return nodes.withColumn("grant", grant.cast("long"))


def leaf_budgets(leaves: DataFrame, share: float, epochs: int, weights: dict, default: int) -> DataFrame:
    """Adds grant (tokens) to leaves (domain, lang, source, tokens); names are never null here."""
    nodes = leaves.select(*LEVELS, (F.col("tokens") * F.lit(epochs)).alias("capacity"), "tokens")
    budget = nodes.groupBy().agg(
        F.coalesce(F.least(F.floor(F.sum("tokens").cast("double") * F.lit(float(share))), F.sum("capacity")), F.lit(0)).cast("long").alias("b")
    )
    above: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        at = nodes.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        at = at.withColumns({"name": F.col(level), "weight": weight_of(level, F.col(level), weights, default)})
        if above is None:
            at = at.withColumn("budget", budget.scalar())
        else:
            at = at.join(above, keys[:-1])
        at = _fill(at, keys[:-1])
        above = at.select(*keys, F.col("grant").alias("budget"))
    return nodes.drop("capacity").join(above, list(LEVELS)).withColumnRenamed("budget", "grant")


def _order_key(seed: str, epoch: Column, doc_id: Column, digest: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-")), digest).cast("binary"))


def _end_of_rest(sums: DataFrame, leaf: list[str]) -> DataFrame:
    """The bucket of each leaf in which its rest ends, with the tokens before it.

    `sums` has rest, before, bucket and n; the leaf's bins are walked first, then the buckets of one bin.
    """

    def ending(rows: DataFrame, place: str) -> DataFrame:
        earlier = Window.partitionBy(*leaf).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        return rows.where("before < rest and rest <= before + n").select(*leaf, place, "before")

    sums = sums.withColumn("bin", F.floor(F.col("bucket") / BINS).cast("int"))
    bins = sums.groupBy(*leaf, "rest", "before", "bin").agg(F.sum("n").alias("n"))
    return ending(sums.drop("before").join(ending(bins, "bin"), [*leaf, "bin"]), "bucket")


def mix(
    docs: DataFrame,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
    weights: dict | None = None,
    default: int = DEFAULT_WEIGHT,
) -> DataFrame:
    """Adds m_domain, m_tokens and m_copies (how often the document is taken; 0: not) to each row.

    Null language or source count as the name '-'; a null text has one token and is ordered like an
    empty one. Of rows that agree in doc_id and text some may be taken once more than others; which, if other
    columns differ, is not defined. Texts are whole, however long. Empty input gives no rows. Other
    columns are kept; columns by the added names are replaced.
    """
    weights = WEIGHTS if weights is None else weights
    added = ["m_domain", "m_tokens", "m_copies"]
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in added]
    leaf = list(LEVELS)
    places = [F.col("m_domain").alias("domain"), *(F.coalesce(F.col(c), F.lit("-")).alias(c) for c in ("lang", "source"))]
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")
    counted = docs.select(whole(docs), "doc_id", "lang", "source", digest, domain_of(F.col("source")).alias("m_domain"), tokens_of(F.col("text")).alias("m_tokens"))
    placed = counted.select("row", "m_domain", "doc_id", "digest", "m_tokens", *places)
    narrow = placed.select(*leaf, "doc_id", "digest", F.col("m_tokens").alias("n"))
    grants = save(
        leaf_budgets(narrow.groupBy(*leaf).agg(F.sum("n").alias("tokens")), share, epochs, weights, default).select(
            *leaf, F.floor(F.col("grant") / F.col("tokens")).cast("long").alias("full_epochs"), (F.col("grant") % F.col("tokens")).alias("rest")
        )
    )
    # where in the order of each leaf the rest ends: bucket, bucket in that bucket, then document
    size = "length(domain) + length(lang) + length(source) + 60"
    keyed = join_checked(narrow, grants.where("rest > 0"), leaf, "inner", size)
    keyed = keyed.select(*leaf, "rest", "n", _order_key(seed, F.col("full_epochs"), F.col("doc_id"), F.col("digest")).alias("key"), F.lit(0).cast("long").alias("before"))
    for first, digits in ROUNDS:
        keyed = keyed.withColumn("bucket", F.conv(F.substring("key", first, digits), 16, 10).cast("int"))
        ends = save(_end_of_rest(save(keyed.groupBy(*leaf, "rest", "before", "bucket").agg(F.sum("n").alias("n"))), leaf))
        keyed = save(join_checked(keyed.drop("before"), ends, [*leaf, "bucket"], "inner", size).drop("bucket"))
    equal = keyed.groupBy(*leaf, "rest", "before", "key").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    within = Window.partitionBy(*leaf).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ended = equal.withColumn("so_far", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("rows")).over(within), F.lit(0))).where("so_far < rest")
    cuts = ended.groupBy(*leaf).agg(F.max(F.struct("key", "rows", F.expr("least(rows, (rest - so_far + n - 1) div n)").alias("wanted"))).alias("cut"))
    plan = save(grants.join(cuts, leaf, "left").select(*leaf, "full_epochs", "cut"))
    met = join_checked(placed, plan, leaf, "left", size)
    key = _order_key(seed, F.col("full_epochs"), F.col("doc_id"), F.col("digest"))
    met = met.withColumns({"once_more": F.coalesce((key <= F.col("cut.key")).cast("int"), F.lit(0)), "parted": F.coalesce((key == F.col("cut.key")) & (F.col("cut.wanted") < F.col("cut.rows")), F.lit(False))})
    copies = (F.col("full_epochs") + F.col("once_more")).cast("long").alias("m_copies")
    if plan.where("cut.wanted < cut.rows").isEmpty():
        return met.select(*kept, "m_domain", "m_tokens", copies)
    parted = _numbered(met.where("parted"), leaf).withColumn("once_more", (F.col("number") <= F.col("cut.wanted")).cast("int"))
    return met.where("NOT parted").select(*kept, "m_domain", "m_tokens", copies).unionByName(parted.select(*kept, "m_domain", "m_tokens", copies))


def _numbered(rows: DataFrame, leaf: list[str]) -> DataFrame:
    """Adds number, from 1 in each leaf. Rows are numbered within the files of a written table, so that many equal rows need no common task."""
    rows = save(rows.withColumns({"task": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    counts = rows.groupBy(*leaf, "task").agg(F.count("*").alias("own"))
    earlier = Window.partitionBy(*leaf).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*leaf, "task", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy(*leaf, "task").orderBy("place")
    return rows.join(starts, [*leaf, "task"]).withColumn("number", F.col("start") + F.row_number().over(within))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as mix() takes it, with the columns of `docs`."""
    mixed = mix(docs.select("doc_id", "lang", "source", "text", whole(docs)), **options).where("m_copies > 0")
    return mixed.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_copies")))).select("row.*")

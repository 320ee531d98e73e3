"""Joins and windows over time: the latest earlier row (as-of), overlapping intervals, and what happened shortly before.

Keys may be very uneven: time is cut into slots of `width` seconds, and rows are dealt by key and slot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one side of an interval join in a key's slot, beyond which they are dealt out and the others repeated.
HOT_ROWS = 10_000


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def slot(at: Column, width: int) -> Column:
    """Number of the slot of `width` seconds that holds a time."""
    return F.floor(micros(at) / F.lit(width * 1_000_000)).cast("long")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, width: int, strict: bool = False) -> DataFrame:
    """left with `found`: of the right rows of its key up to its time `at` (before it, if strict) the latest, null without one.

    Both have columns key and at. found is a struct of at and the other columns of right, in their
    order; of several right rows at one time the largest struct counts, so give what should decide
    first. Rows of both are merged by time within a key's slot; what a slot finds none for comes
    from the latest right row of the slots before, of which there is one row for each key and slot. No pair
    of rows is ever made. Left rows with a null key or time find nothing.
    """
    value = F.struct(F.col(at).alias("at"), *(F.col(c) for c in right.columns if c not in (key, at)))
    order = F.when(F.col("side") == 0, 0 if not strict else 1).otherwise(1 if not strict else 0)
    kind = right.select(value.alias("v")).schema["v"].dataType
    own = F.struct(*(F.col(c) for c in left.columns))
    known = left.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    lefts = known.select(F.col(key).alias("key"), F.col(at).alias("at"), F.lit(1).alias("side"), own.alias("own"), F.lit(None).cast(kind).alias("value"))
    rights = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(lefts.schema["own"].dataType).alias("own"), value.alias("value"))
    merged = lefts.unionByName(rights).withColumn("slot", slot(F.col("at"), width))
    inside = Window.partitionBy("key", "slot").orderBy("at", order, F.col("value").asc_nulls_last())
    if strict:  # rows of one time all come before any right row of that time, so left rows see earlier ones only
        inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    else:
        inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = merged.withColumn("here", F.last("value", ignorenulls=True).over(inside)).where("side = 1").select("key", "slot", "own", "here")
    ends = merged.groupBy("key", "slot").agg(F.max("value").alias("last"))
    before = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("before", F.last("last", ignorenulls=True).over(before)).where("before IS NOT NULL").select("key", "slot", "before")
    met = near.join(carried, ["key", "slot"], "left").select("own.*", F.coalesce("here", "before").alias("found"))
    lost = left.where(F.col(key).isNull() | F.col(at).isNull()).select("*", F.lit(None).cast(kind).alias("found"))
    return met.unionByName(lost)


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of rows of one key whose intervals [begin, until) overlap: key, `a` and `b` (structs of the rows), begin and until of what they share.

    Both have columns key, begin and until (times). An interval is entered in each slot that it meets, and a pair
    counts in the slot where the later of both begins, so once; choose `width` near the usual length. Where one
    side has more than `hot_rows` rows in a key's slot these are dealt out in shares and the other side is repeated for each
    share. Intervals that are empty, reversed or null, and null keys, meet nothing.
    """
    last = lambda: F.floor((micros(F.col("until")) - 1) / F.lit(width * 1_000_000)).cast("long")

    def entered(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*(F.col(c) for c in df.columns)).alias(name)
        fine = df.where(F.col(key).isNotNull() & (F.col("begin") < F.col("until")))
        return fine.select(F.col(key).alias("key"), F.explode(F.sequence(slot(F.col("begin"), width), last())).alias("slot"), slot(F.col("begin"), width).alias(f"first_{name}"), row)

    left, right = entered(a, "a"), entered(b, "b")
    shares = F.ceil(F.count("*") / F.lit(hot_rows))
    hot = left.groupBy("key", "slot").agg(shares.cast("int").alias("shares")).where("shares > 1")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share")
    mine = F.pmod(F.xxhash64("a"), F.coalesce("shares", F.lit(1))).cast("int").alias("share")
    left = left.join(hot, ["key", "slot"], "left").select("key", "slot", "first_a", "a", mine)
    right = right.join(hot, ["key", "slot"], "left").select("key", "slot", "first_b", "b", every)
    met = left.join(right, ["key", "slot", "share"])
    once = F.col("slot") == F.greatest("first_a", "first_b")
    shared = (F.col("a.begin") < F.col("b.until")) & (F.col("b.begin") < F.col("a.until"))
    return met.where(once & shared).select(F.col("key").alias(key), "a", "b", F.greatest("a.begin", "b.begin").alias("begin"), F.least("a.until", "b.until").alias("until"))


def recently(events: DataFrame, key: str, at: str, figures: dict[str, Column], days: float) -> DataFrame:
    """events with figures (aggregates by name) over the rows of their key in the `days` before, not at, their time.

    A RANGE frame over microseconds: rows of one time never see each other. Rows with a null time see nothing: figures are those of no rows.
    """
    span = int(days * 86_400_000_000)
    frame = Window.partitionBy(key).orderBy(micros(F.col(at))).rangeBetween(-span, -1)
    known = F.col(at).isNotNull()
    timed = events.where(known).withColumns({name: f.over(frame) for name, f in figures.items()})
    nothing = Window.partitionBy(F.spark_partition_id()).orderBy(F.lit(0)).rowsBetween(1, 0)
    return reduce(DataFrame.unionByName, [timed, events.where(~known).withColumns({name: f.over(nothing) for name, f in figures.items()})])

"""Operator 9, quality classifier: importance resampling by hashed n-gram generative models.

Two bags of hashed unigrams and bigrams, one of target text (a bounded sample of documents
labelled good) and one of the raw corpus (every document), give each document the log ratio of
its whole text: the sum over all its n-grams of log target minus log raw probability. Divided by
a temperature it is the document's log importance weight; with a seeded Gumbel variable added,
the k documents of greatest sum are a sample without replacement by these weights.

Labelled documents held out from the target model fit what is left, by logistic regression of
good on the ratio: the temperature (one over its slope) and, by the sum of its probabilities over
all documents, k, the number of good documents to expect. So the noise is as wide as the model is
unsure: clear documents keep their place, those between are drawn. A target model of few texts
finds unseen text unlikely, in proportion to its length; where the ratio of held-out good text
lies below 0, its median for an n-gram is added back for every n-gram (the shift). The models have
BUCKETS numbers each, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import fields, gram_hashes, join_checked, save, steps, tidy, utf8, whole, word_hashes

BUCKETS = 1 << 16
#: At most so many labelled documents are looked at, those of least hash of the id.
LABELLED = 20_000
#: Added to each bucket's count.
SMOOTH = 0.1
#: Every HOLD_OUT-th labelled document (by a checksum of the id) fits the temperature and not the model.
HOLD_OUT = 4
#: Ratios count to the fit within so many times the usual one of good text, and a slope has this penalty.
CLIP, PENALTY = 20.0, 0.5
SEED = "quality-1"
REPEAT = np.uint64(0x5EED)


def _kinds() -> np.ndarray:
    """Letters, digits and bytes beyond ASCII make words; other marks make tokens of their own; white space parts."""
    table = np.full(256, 2, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
    return table


KINDS, SAME = _kinds(), np.arange(256, dtype=np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and the row of each; a token after itself is one n-gram, whatever the token."""
    tokens, first = word_hashes(data, offsets, KINDS, SAME)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pairs = gram_hashes(tokens, 2)
    if len(pairs):
        pairs = np.where(tokens[1:] == tokens[:-1], REPEAT, pairs)[inside := row[1:] == row[:-1]]
        return (np.concatenate([tokens, pairs]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[1:][inside]])
    return (tokens % np.uint64(BUCKETS)).astype(np.int64), row


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a partition: of all its documents, and of those labelled good."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        good = np.array(batch.column(0).fill_null(0).to_pylist(), np.int64)
        for low, high, data, offsets in steps(*utf8(batch.column(1))):
            bucket, row = grams(data, offsets)
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[good[low:high][row] > 0], minlength=BUCKETS)
    used = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], names=["bucket", "raw", "target"])


def log_ratios(marked: DataFrame) -> np.ndarray:
    """Log of target over raw probability for each bucket; `marked` has good (1, 0 or null) and text."""
    rows = marked.select("good", "text").mapInArrow(tidy(_counts), "bucket long, raw long, target long")
    rows = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in rows:
        raw[b], target[b] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    smooth = lambda x: np.log((x + SMOOTH) / (x.sum() + SMOOTH * BUCKETS))
    return smooth(target) - smooth(raw)


def with_sums(df: DataFrame, columns: list[str], ratios: np.ndarray) -> DataFrame:
    """`columns` of `df`, q_sum (the log ratio of the whole text) and q_grams (its n-grams)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, n = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for low, high, data, offsets in steps(*utf8(batch.column(len(columns)))):
                bucket, row = grams(data, offsets)
                n[low:high] = np.bincount(row, minlength=high - low)
                sums[low:high] = np.bincount(row, ratios[bucket], high - low)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(sums), pa.array(n)], names=[*columns, "q_sum", "q_grams"])

    return df.select(*columns, df["text"].alias(_unused(columns))).mapInArrow(tidy(score), fields(df, columns, "q_sum double, q_grams long"))


def _unused(columns: list[str]) -> str:
    name = "text"
    while name in columns:
        name += "_"
    return name


class Fit(NamedTuple):
    """What is added for every n-gram, one over the temperature, and the intercept of the log odds."""

    shift: float
    slope: float
    intercept: float


def fitted(held: list[tuple[float, int, int]]) -> Fit | None:
    """From (q_sum, q_grams, good) of held-out documents; None without both kinds, or where the ratio does not tell them apart."""
    total, n, good = (np.array(x, float) for x in zip(*held, strict=True)) if held else (np.zeros(0),) * 3
    if not 0 < good.sum() < len(good):
        return None
    own = good == 1
    shift = max(0.0, -float(np.median(total[own] / np.maximum(n[own], 1))))
    total = total + shift * n
    scale = float(np.median(np.abs(total[own]))) or 1.0
    x = np.clip(total / scale, -CLIP, CLIP)
    at = np.zeros(2)

    def loss(at: np.ndarray) -> float:
        z = at[0] * x + at[1]
        return float((np.logaddexp(0, z) - good * z).sum() + PENALTY * (at[0] ** 2 + 0.01 * at[1] ** 2))

    for _ in range(100):  # Newton's method with halved steps
        p = 1 / (1 + np.exp(-(at[0] * x + at[1])))
        w = p * (1 - p)
        slope = np.array([((p - good) * x).sum() + 2 * PENALTY * at[0], (p - good).sum() + 0.02 * PENALTY * at[1]])
        curve = np.array([[(w * x * x).sum() + 2 * PENALTY, (w * x).sum()], [(w * x).sum(), w.sum() + 0.02 * PENALTY]])
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-9 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return Fit(shift, float(at[0]) / scale, float(at[1])) if at[0] > 0 else None


def gumbel(seed: str, key: Column) -> Column:
    """A standard Gumbel variable that seed and key decide."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("-"))).cast("binary")), 1, 12)
    return -F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)))


def judged(docs: DataFrame, labels: DataFrame, seed: str = SEED, labelled: int = LABELLED) -> DataFrame:
    """One row for each document: doc_id, q_key (text hash), q_ratio (log ratio of the whole text, with the shift), q_weight (log weight plus Gumbel) and q_kept.

    Labels: doc_id, quality (1 good, 0 poor); of several for one document the greatest holds, null
    ones are ignored. Without held-out labels of both kinds, or where the ratio does not tell them
    apart, all documents are kept. A null or empty text has ratio 0. Equal rows get equal answers;
    rows of one id share their noise; texts of any length are read whole. No rows in, no rows out.
    Only doc_id and text are read, so other columns cannot clash.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(labelled)
    )
    chosen = save(chosen.withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % HOLD_OUT == 0))
    # `labelled` rows at most, so it may be broadcast
    narrow = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left")
    ratios = log_ratios(narrow.withColumn("good", F.when(~F.col("held"), F.col("good"))))
    scored = save(with_sums(narrow.withColumn("q_key", F.xxhash64("text")), ["doc_id", "good", "held", "q_key"], ratios))
    one = F.min(F.struct("q_key", "q_sum", "q_grams", "good")).alias("one")  # of repeated ids one text: `labelled` rows at most
    fit = fitted([(r["q_sum"], r["q_grams"], r["good"]) for r in scored.where("held").groupBy("doc_id").agg(one).select("one.*").collect()])
    if fit is None:
        return scored.select("doc_id", "q_key", F.col("q_sum").alias("q_ratio"), F.lit(0.0).alias("q_weight"), F.lit(True).alias("q_kept"))
    ratio = F.col("q_sum") + F.col("q_grams") * F.lit(fit.shift)
    log_weight = F.col("q_ratio") * F.lit(fit.slope)
    scored = scored.select("doc_id", "q_key", F.round(ratio, 6).alias("q_ratio"))
    millionths = F.round(1_000_000 / (1 + F.exp(-(log_weight + F.lit(fit.intercept))))).cast("long")
    k = round((scored.agg(F.sum(millionths).alias("k")).first()["k"] or 0) / 1_000_000)
    weighted = scored.withColumn("q_weight", F.round(log_weight + gumbel(seed, F.col("doc_id")), 6))
    return top_k(weighted, "q_weight", ["doc_id", "q_key"], k, "q_kept")


def top_k(df: DataFrame, value: str, ties: list[str], k: int, kept: str) -> DataFrame:
    """Adds `kept`: whether the row is among the k of greatest `value` (rounded to 6 digits); equal rows share a fate.

    No global sort: counts by ever finer bins of the value find the bin of the k-th row, and only
    rows that agree in the whole value with it are ordered (by `ties`).
    """
    fixed = (F.col(value) * 1_000_000).cast("long")
    rest, above, low, high = k, None, None, None
    bins = df.select(fixed.alias("v"), *ties)
    if k <= 0:
        return df.withColumn(kept, F.lit(False))
    for width in (1 << 30, 1 << 15, 1):
        at = F.floor(F.col("v") / width).cast("long")
        inside = bins if low is None else bins.where((F.col("v") >= low) & (F.col("v") < high))
        counts = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
        so_far = F.sum("n").over(Window.orderBy(F.desc("bin")))  # the bins of one step are few
        found = counts.withColumn("so_far", so_far).where(F.col("so_far") >= rest).orderBy(F.desc("bin")).first()
        if found is None:
            return df.withColumn(kept, F.lit(True))
        rest -= found["so_far"] - found["n"]
        low, high = found["bin"] * width, (found["bin"] + 1) * width
    order = F.struct(*ties)
    last = bins.where(F.col("v") == low).select(order.alias("o")).orderBy("o").limit(rest).agg(F.max("o").alias("o"))
    keep = (fixed > low) | ((fixed == low) & (order <= last.scalar()))
    return df.withColumn(kept, F.coalesce(keep, F.lit(False)))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that judged() keeps, with their columns; equal ids with equal texts stay or go together. Empty tables, nulls and missing labels: as judged() says."""
    poor = save(judged(docs, labels, **options).where("not q_kept").select(F.xxhash64("doc_id", "q_key").alias("q_name")).distinct())
    named = docs.select(whole(docs), F.xxhash64("doc_id", F.xxhash64("text")).alias("q_name"))
    return join_checked(named, poor, "q_name", "left_anti", "8").select("row.*")

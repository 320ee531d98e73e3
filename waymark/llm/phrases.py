"""Operator 11, phrase collocation mining: frequent word sequences by hash buckets and Apriori pruning (PCY, DHP).

Texts are A-Z lower-cased, split at MARKS into pieces and those at spaces and tabs into words; a phrase is
up to LONGEST words in a row within a piece, and all counts are per language. A phrase is
frequent if it occurs SUPPORT times or more. Pass k counts the candidates of k words exactly and
drops those of k + 1 words into 2^BITS hash buckets:

* Pass 1 counts words and buckets of word pairs.
* A bucket below SUPPORT holds no frequent phrase. Bitmaps of the others, and of the exactly frequent
  phrases of one word less, are broadcast (8 MB each, whatever the input). A sequence is counted in
  pass k only if both its parts of k - 1 words and its own bucket are set, and dropped into a bucket for pass
  k + 1 only if both its parts of k words were counted.
* Pass 2 also writes down the runs of words that can still hold three words (trimming); later passes
  read these alone.

Bitmaps only ever keep too much; what is returned was counted exactly. Each task merges its
counts, HELD at a time, so a very common phrase costs a row for each task. Beyond some 10^11 words
all buckets fill and only the Apriori bitmaps and exact counting prune; results stay the same.

A phrase is cut where it scores lowest: with a uses of the phrase, l and r of the two parts and n words in
the language, floor(1000 * a * n / (l * r)), in decimals of 38 digits. A phrase within a longer frequent one that
has at least ABSORB percent of its uses is left out. The best TOP of each language are returned.

Defined results: null texts are empty, null languages are `und`, and meet rows that say so. Repeated rows
count as often as they come; ids are not read, so null and repeated ones don't matter. Texts are whole, however
long; one longer than CHUNK is a chunk of its own. No rows, or no frequent phrase, give an empty result.
Extra columns are ignored. Words are told apart by 64-bit hashes within a language, phrases by their words' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import LOWER, gram_hashes, join_skewed, mixed, save, signed, small_enough, steps, tidy, utf8

SUPPORT, LONGEST, ABSORB, TOP = 100, 5, 100, 2000
#: Marks end a piece: . , ; : ! ? and line ends.
MARKS = b".,;:!?\n\x0b\x0c\r"
#: Buckets are 2^BITS, in groups of 2^LOW; a bitmap has 2^BITS / 8 bytes.
BITS, LOW = 26, 15
#: Bytes of text, and of hashes of trimmed runs, that are counted at once; hashes in one row of a trimmed run.
CHUNK, RUN = 8 << 20, 1 << 17
#: Counts that a task holds; beyond that, and if merging doesn't halve them, it hands them on.
HELD = 1 << 19

_U = np.uint64


def _kinds() -> np.ndarray:
    table = np.ones(256, np.uint8)
    table[[0x20, 0x09]] = 0
    table[list(MARKS)] = 2
    return table


KINDS = _kinds()


def language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def words_of(data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of text: each word's hash (with its row's seed), whether the next word follows in its piece, first byte, end and row."""
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    at = 0
    for low, high, part, places in steps(data, offsets):
        kind = KINDS[part]
        word = kind == 1
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = places[1:-1][(places[1:-1] > 0) & (places[1:-1] < len(part))]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if len(starts):
            length = stops - starts
            powers = np.full(int(length.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            inside = np.flatnonzero(word)
            value = (LOWER[part[inside]].astype(np.uint64) + _U(1)) * powers[inside - np.repeat(starts, length)]
            row = np.searchsorted(places, starts, "right") - 1
            hashes = mixed(np.add.reduceat(value, np.append(0, np.cumsum(length)[:-1])) ^ seeds[low + row])
            piece = np.cumsum(kind == 2)[starts]
            follows = np.zeros(len(starts), bool)
            follows[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
            for out, x in zip(found, (hashes, follows, starts + at, stops + at, row + low), strict=True):
                out.append(x)
        at += len(part)
    kinds = (np.uint64, bool, np.int64, np.int64, np.int64)
    return tuple(np.concatenate([np.zeros(0, k), *x]) for x, k in zip(found, kinds, strict=True))


def set_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bucket is set in a bitmap."""
    bucket = (hashes & _U((1 << BITS) - 1)).astype(np.int64)
    return (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


PASS = "lang string, word string, gram long, n long, " + ", ".join(f"w{i} long" for i in range(1, LONGEST + 1)) + ", g int, places binary, counts binary, run binary"
NAMES = [x.split()[0] for x in PASS.split(", ")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
KIND = {x.split()[0]: _ARROW[x.split()[1]] for x in PASS.split(", ")}


def _rows(**columns) -> pa.RecordBatch:
    """Rows of a pass; columns that are not given are null."""
    columns = {k: v if isinstance(v, pa.Array) else pa.array(v, KIND[k]) for k, v in columns.items()}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, KIND[c])) for c in NAMES], names=NAMES)


class Buckets:
    """How often each bucket came in a task, up to `support`; handed on as a row for each group of buckets."""

    def __init__(self, support: int) -> None:
        self.support, self.parts, self.size = support, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(np.unique((hashes & _U((1 << BITS) - 1)).astype(np.int64), return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > HELD:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
            if self.size > HELD // 2:
                yield from self.rest()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        bucket, place = np.unique(np.concatenate([b for b, _ in self.parts]), return_inverse=True)
        return bucket, np.bincount(place, np.concatenate([n for _, n in self.parts]), len(bucket)).astype(np.int64)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            bucket, times = self.merged()
            self.parts, self.size = [], 0
            group = bucket >> LOW
            edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(bucket)]
            low, times = (bucket & ((1 << LOW) - 1)).astype(np.uint16), np.minimum(times, self.support).astype(np.uint16)
            cut = [(a, b) for a, b in pairwise(edges)]
            yield _rows(g=[int(group[a]) for a, _ in cut], places=[low[a:b].tobytes() for a, b in cut], counts=[times[a:b].tobytes() for a, b in cut])


class Counts:
    """Exact counts of a task's phrases: rows with gram and n, those of one gram merged."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.size = 0

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.parts.append(rows)
        self.size += len(rows)
        if self.size > HELD:
            self.parts = [self.merged()]
            self.size = len(self.parts[0])
            if self.size > HELD // 2:
                yield from self.rest()

    def merged(self) -> pa.RecordBatch:
        rows = pa.Table.from_batches(self.parts).combine_chunks()
        _, first, place = np.unique(rows["gram"].to_numpy(), return_index=True, return_inverse=True)
        n = np.bincount(place, rows["n"].to_numpy(), len(first)).astype(np.int64)
        return rows.take(pa.array(first)).set_column(NAMES.index("n"), "n", pa.array(n)).combine_chunks().to_batches()[0]

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            rows = self.merged()
            self.parts, self.size = [], 0
            for low in range(0, len(rows), 1 << 16):
                yield rows.slice(low, 1 << 16)


def _counted(words: np.ndarray, grams: np.ndarray, at: np.ndarray, k: int) -> pa.RecordBatch:
    """Exact counts of the phrases of k words that begin at the places `at`."""
    gram, first, times = np.unique(grams[at], return_index=True, return_counts=True)
    begin = at[first]
    return _rows(gram=signed(gram), n=times, **{f"w{i + 1}": signed(words[begin + i]) for i in range(k)})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Words of runs of whole rows of about CHUNK bytes, with the bytes and languages; batches have lang and text."""
    known: dict[str, int] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in set(langs) - known.keys():
            known[lang] = language_hash(lang)
        seeds = np.array([known[x] for x in langs], np.uint64)
        data, offsets = utf8(batch.column(1))
        for low, high, part, places in steps(data, offsets, CHUNK):
            yield (*words_of(part, places, seeds[low:high]), part, langs[low:high])


def _first(support: int):
    """Pass 1: exact counts of words, with their letters, and buckets of pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, buckets = Counts(), Buckets(support)
        for words, follows, starts, stops, row, data, langs in _texts(batches):
            if not len(words):
                continue
            gram, first, times = np.unique(words, return_index=True, return_counts=True)
            a, size = starts[first], (stops - starts)[first]
            edge = np.append(0, np.cumsum(size))
            letters = LOWER[data[np.arange(edge[-1]) - np.repeat(edge[:-1] - a, size)]]
            text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes())])
            yield from held.add(_rows(gram=signed(gram), n=times, w1=signed(gram), word=text.cast(pa.string()), lang=[langs[i] for i in row[first].tolist()]))
            pairs = gram_hashes(words, 2)[follows[:-1]]
            if len(pairs):
                yield from buckets.add(pairs)
        yield from held.rest()
        yield from buckets.rest()

    return count


def _second(support: int, frequent, likely):
    """Pass 2: exact counts of pairs, buckets of triples, and the runs that can hold triples."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, buckets = Counts(), Buckets(support)
        for words, follows, *_ in _texts(batches):
            if len(words) < 2:
                continue
            ok, grams = set_in(frequent.value, words), gram_hashes(words, 2)
            here = follows[:-1] & ok[:-1] & ok[1:]
            here[here] = set_in(likely.value, grams[here])
            if here.any():
                yield from held.add(_counted(words, grams, np.flatnonzero(here), 2))
            triple = here[:-1] & here[1:]
            if triple.any():
                yield from buckets.add(gram_hashes(words, 3)[triple])
                yield from _trimmed(words, here, triple)
        yield from held.rest()
        yield from buckets.rest()

    return count


def _trimmed(words: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The words within triples, runs parted by a 0, in rows of about RUN words."""
    keep = np.zeros(len(words), bool)
    for i in range(3):
        keep[i : len(triple) + i] |= triple
    at = np.flatnonzero(keep)
    gap = np.flatnonzero((np.diff(at) > 1) | ~pair[at[1:] - 1]) + 1
    run = np.insert(words[at], gap, 0)
    low, zeros = 0, np.flatnonzero(run == 0)
    while low < len(run):
        more = zeros[np.searchsorted(zeros, low + RUN) :]
        high = int(more[0]) if len(more) else len(run)
        yield _rows(run=[run[low:high].tobytes()])
        low = high + 1


def _longer(support: int, k: int, last: bool, frequent, likely):
    """Pass k over trimmed runs: exact counts of phrases of k words, buckets of k + 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, buckets = Counts(), Buckets(support)
        for words in _runs(batches):
            if len(words) < k:
                continue
            zero = np.append(0, np.cumsum(words == 0))
            part = (zero[k - 1 :] == zero[: 1 - k]) & set_in(frequent.value, gram_hashes(words, k - 1))
            grams = gram_hashes(words, k)
            here = part[:-1] & part[1:]
            here[here] = set_in(likely.value, grams[here])
            if not here.any():
                continue
            yield from held.add(_counted(words, grams, np.flatnonzero(here), k))
            after = here[:-1] & here[1:]
            if not last and after.any():
                yield from buckets.add(gram_hashes(words, k + 1)[after])
        yield from held.rest()
        yield from buckets.rest()

    return count


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    held, size = [], 0
    for batch in batches:
        for run in batch.column(0):
            held += [np.frombuffer(run.as_buffer(), np.uint64), np.zeros(1, np.uint64)]
            size += 8 * len(held[-2])
            if size >= CHUNK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _added(support: int):
    """Sums of buckets as bitmaps; all rows of a group of buckets come to one task, which holds its groups' sums only."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, places, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = sums.setdefault(g, np.zeros(1 << LOW, np.uint16))
                at = np.frombuffer(places.as_buffer(), np.uint16)
                own[at] = np.minimum(own[at].astype(np.int32) + np.frombuffer(counts.as_buffer(), np.uint16), support)
        bits = [np.packbits(own >= support, bitorder="little").tobytes() for own in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["g", "bits"])

    return add


def _bitmap(spark: SparkSession, rows: DataFrame):
    """Broadcast bitmap of all buckets from (g, bits), which are at most 2^BITS bits in all."""
    out = np.zeros(1 << (BITS - 3), np.uint8)
    width = 1 << (LOW - 3)
    for r in rows.collect():
        out[r["g"] * width : (r["g"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)


def likely(spark: SparkSession, counted: DataFrame, support: int):
    """Bitmap of the buckets with `support` or more."""
    rows = counted.where("g IS NOT NULL").select("g", "places", "counts").repartition("g")
    return _bitmap(spark, rows.mapInArrow(tidy(_added(support)), "g int, bits binary"))


def present(spark: SparkSession, grams: DataFrame):
    """Bitmap of the buckets of frequent phrases (gram)."""
    bucket = F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1))
    rows = grams.select(F.shiftright(bucket, LOW).cast("int").alias("g"), bucket.bitwiseAND(F.lit((1 << LOW) - 1)).alias("b"))
    return _bitmap(spark, rows.groupBy("g").agg(F.bitmap_construct_agg("b").alias("bits")))


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gram, words, f) of frequent sequences of 1 to `longest` words, words being hashes; (gram, lang, word) of its words; (lang, n)."""
    if not 1 <= support < 1 << 15 or not 2 <= longest <= LONGEST:
        raise ValueError(f"support must be from 1 to {(1 << 15) - 1}, longest from 2 to {LONGEST}")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = save(texts.mapInArrow(tidy(_first(support)), PASS))
    seen = counted.where("word IS NOT NULL")
    totals = save(seen.groupBy("lang").agg(F.sum("n").alias("n")))
    words = save(seen.groupBy("lang", "word", "gram").agg(F.sum("n").alias("f")).where(F.col("f") >= support))
    found = [words.select("gram", F.array("gram").alias("words"), "f")]
    before, runs = words, None
    for k in range(2, longest + 1):
        buckets = likely(spark, counted, support)
        if not buckets.value.any():
            break
        have = present(spark, before)
        if k == 2:
            counted = save(texts.mapInArrow(tidy(_second(support, have, buckets)), PASS))
            runs = counted.where("run IS NOT NULL").select("run")
        else:
            counted = save(runs.mapInArrow(tidy(_longer(support, k, k == longest, have, buckets)), PASS))
        own = [f"w{i}" for i in range(1, k + 1)]
        before = save(counted.where("gram IS NOT NULL").groupBy("gram", *own).agg(F.sum("n").alias("f")).where(F.col("f") >= support).select("gram", F.array(*own).alias("words"), "f"))
        found.append(before)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return save(out), words.select("gram", "lang", "word"), totals


def _looked_up(left: DataFrame, right: DataFrame, on: str, row_bytes: str) -> DataFrame:
    """left (saved) with what `right` has for its key, each key once there; a few keys may have most of left's rows."""
    return left.join(F.broadcast(right), on) if small_enough(right, row_bytes) else join_skewed(left, right, on)


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, absorb: int = ABSORB, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best `top` phrases of each language."""
    grams, words, totals = frequent_phrases(docs, support, longest)
    sized = grams.withColumn("k", F.size("words"))
    phrases = sized.where("k > 1")
    # every sequence of two words or more within a longer phrase, with the most uses of such a phrase
    inner = "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> slice(words, i, m))))"
    within = phrases.where("k > 2").select(F.explode(F.expr(inner)).alias("words"), "f").groupBy("words").agg(F.max("f").alias("longer"))
    kept = phrases.join(within, "words", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("f")))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = save(kept.select("words", F.col("f").alias("a"), "k", cut).withColumns({"first": F.expr("slice(words, 1, cut)"), "rest": F.expr("slice(words, cut + 1, k - cut)")}))
    known = grams.select("words", "f")
    size = "24 + 8 * size({})"
    left = save(_looked_up(cuts, known.withColumnsRenamed({"words": "first", "f": "l"}), "first", size.format("first")))
    both = _looked_up(left, known.withColumnsRenamed({"words": "rest", "f": "r"}), "rest", size.format("rest"))
    named = words.join(totals, "lang").withColumnRenamed("gram", "word_id")
    placed = save(both.withColumn("word_id", F.col("words")[0]))
    counted = _looked_up(placed, named.select("word_id", "lang", "n"), "word_id", "40 + octet_length(lang)")
    # digits: uses of a phrase up to 14, words of a language up to 18
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    scored = counted.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * (whole("a", 14) * whole("n", 18)), "below": whole("l", 14) * whole("r", 14)})
    scored = scored.withColumn("score", F.expr("above div below"))
    best = scored.groupBy("words", "lang", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    spelled = save(best.select("lang", "words", "a", "n", "best.score", "best.l", "best.r", F.posexplode("words").alias("place", "word_id")))
    letters = _looked_up(spelled, named.select("word_id", "word"), "word_id", "40 + octet_length(word)")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ")
    rows = save(letters.groupBy("lang", "words", "a", "n", "score", "l", "r").agg(phrase.alias("phrase")).drop("words"))
    return best_of(rows, top)


def best_of(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language by score, uses and letters, with rank; shares of a language are ranked first, so that no task gets all its rows."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = max(1, int((rows.count() / top) ** 0.5))
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    some = rows.withColumn("share", share).withColumn("r1", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("r1") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

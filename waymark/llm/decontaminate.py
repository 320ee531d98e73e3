"""Operator 13, benchmark decontamination: words of documents that lie inside a window of a benchmark item.

A window is WINDOW consecutive words of an item; an item of fewer words, but not none, is one window.
A window is in a document only if all its shingles of SHINGLE words are (of a shorter window, the
window itself), so its rarest shingle is a necessary prefix and the only one that has to be joined:

1. Shingles of all documents are counted, as far as an item has them; these counts order the shingles by rarity.
   Windows with a shingle that no document has are dropped.
2. Each document's shingles meet the windows' rarest ones. The shingle's place in both says where the window
   would begin; that must leave room for the whole window (positional and length bounds), and the words
   there must equal the window's (exact containment, in words, not hashes).
3. Begins are merged to covered words for each document. Windows with the same items are one class, so a document
   meets an item list once for each class.

Only DataFrame functions run. A document's words stay in the task that split them while windows fit
into a broadcast (32 MB, measured); beyond that only (document, place, hash) is shuffled and
documents that have candidates are read again for the comparison.

Defined results: null texts and texts without words have n_words 0 and no hit; items without words have no
window; several items of one text count each, rows with the same item_id once; null item ids are no
item but their windows hit. Rows of documents equal in id and text, null ids too, give as many equal rows. An empty table of
documents gives an empty result, an empty benchmark no hits. Texts of any length are taken whole. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import save, small_enough

WINDOW, SHINGLE = 10, 3
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows with the words of an item as broadcast: bytes of a window's row.
ROW_BYTES = "48 + octet_length(array_join(words, '  ')) + 16 * size(words)"


def words_of(text: Column) -> Column:
    """Lower-cased words; A-Z alone are folded, which lower() does in texts that are all ASCII."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, PARTING), "")


def shingle(words: Column, place: Column, length: int) -> Column:
    """Hash of `length` words from `place` on."""
    return F.xxhash64(F.lit(length), *(F.get(words, place + i) for i in range(length)))


def windows_of(items: DataFrame) -> DataFrame:
    """words, size and class of each different window, and the class's items; a class is a set of items."""
    taken = items.select("item_id", words_of(F.col("text")).alias("all_words")).where(F.size("all_words") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("all_words") - WINDOW, F.lit(0)))).alias("at")
    each = taken.select("item_id", "all_words", at).select("item_id", F.slice("all_words", F.col("at") + 1, F.lit(WINDOW)).alias("words"))
    named = each.groupBy("words").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return named.select("words", F.size("words").alias("size"), "items", F.sha2(F.to_json("items"), 256).alias("class"))


def _keyed(windows: DataFrame) -> DataFrame:
    """A row for each shingle of each window: its hash, its length and its place there."""
    parts = []
    for length in range(1, SHINGLE + 1):
        own = windows.where(F.col("size") >= length if length == SHINGLE else F.col("size") == length)
        place = F.explode(F.sequence(F.lit(0), F.col("size") - length)).alias("place")
        rows = own.select("words", "size", "class", place)
        parts.append(rows.withColumns({"key": shingle(F.col("words"), F.col("place"), length), "length": F.lit(length)}))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _split(docs: DataFrame) -> DataFrame:
    """A row for each document and, before the last one, each place of its words: id, digest, words, n_words and at."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col("doc_id").alias("id"), digest.alias("digest"), words_of(F.col("text")).alias("words"))
    return rows.select("id", "digest", "words", F.size("words").alias("n_words"), F.explode(F.sequence(F.lit(0), F.size("words"))).alias("at"))


def _with_keys(split: DataFrame, lengths: list[int]) -> DataFrame:
    """split with the hash of the shingle at each place, for each of the lengths that some window needs (nearly always one)."""
    if len(lengths) == 1:
        return split.withColumn("key", shingle(F.col("words"), F.col("at"), lengths[0]))
    keys = F.array(*(shingle(F.col("words"), F.col("at"), n) for n in lengths))
    return split.withColumn("key", F.explode(F.when(F.col("at") < F.col("n_words"), keys).otherwise(F.slice(keys, 1, 1))))


def occurrences(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, digest, n_words, at, size, class) of each window found, and one row with null class for each document; and (class, items)."""
    windows = save(windows_of(items))
    keyed = save(_keyed(windows))
    lengths = sorted(r["length"] for r in keyed.select("length").distinct().collect()) or [SHINGLE]
    split = _with_keys(_split(docs), lengths)
    broad = small_enough(keyed, ROW_BYTES)
    hint = F.broadcast if broad else lambda df: df
    met = split.where("at < n_words").select("key").join(hint(keyed.select("key").distinct()), "key", "left_semi")
    counts = met.groupBy("key").agg(F.count("*").alias("seen"))
    # a window has at most WINDOW shingles, so no group is large
    ranked = keyed.join(counts, "key", "left").groupBy("words", "size", "class").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "key", "place")).alias("rarest"))
    rare = save(ranked.where("rarest.seen > 0").select(F.col("rarest.key").alias("key"), F.col("rarest.place").alias("place"), F.col("words").alias("window"), "size", "class"))
    begin = F.col("at") - F.col("place")
    room = (F.col("at") < F.col("n_words")) & (begin >= 0) & (begin + F.col("size") <= F.col("n_words"))
    same = F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.col("size")) == F.col("window")
    figures = ["id", "digest", "n_words", F.when(F.col("class").isNotNull(), begin).alias("at"), "size", "class"]
    own = rare.withColumnRenamed("key", "rare_key")
    if broad:
        found = split.join(F.broadcast(own), (F.col("key") == F.col("rare_key")) & room & same, "left")
        found = found.where("class IS NOT NULL OR at = n_words").select(*figures)
    else:
        places = split.where("at < n_words").select("id", "digest", "n_words", "at", "key")
        near = places.join(own, (F.col("key") == F.col("rare_key")) & room).distinct()
        texts = docs.select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), words_of(F.col("text")).alias("words"))
        there = near.withColumnsRenamed({"id": "nid", "digest": "nd"})
        hit = texts.join(there, (F.col("digest") == F.col("nd")) & F.col("id").eqNullSafe(F.col("nid")) & same).select(*figures)
        every = texts.select("id", "digest", F.size("words").alias("n_words"), *(F.lit(None).cast(kind).alias(c) for c, kind in (("at", "int"), ("size", "int"), ("class", "string"))))
        found = every.unionByName(hit)
    return found, windows.select("class", "items").distinct()


def covered(spans: Column) -> Column:
    """Number of places that lie in any of an array of structs (at, size)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(s["end"], x["at"]))).cast("long").alias("n"),
        F.greatest(s["end"], x["at"] + x["size"]).alias("end"),
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item ids) and contaminated of each document."""
    found, classes = occurrences(docs, items)
    spans = F.collect_set(F.when(F.col("class").isNotNull(), F.struct("at", "size")))
    each = found.groupBy("id", "digest").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if(F.col("class").isNull()).alias("copies"),
        spans.alias("spans"), F.collect_set("class").alias("classes"),
    )
    each = save(each.select("id", "digest", "n_words", "copies", covered(F.col("spans")).alias("n_hit"), "classes"))
    hit = each.where("n_hit > 0").select("id", "digest", F.explode("classes").alias("class"))
    lists = hit.join(classes, "class").groupBy("id", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    clean = each.where("n_hit = 0").select("id", "n_words", "copies", "n_hit", F.array().cast("array<string>").alias("items"))
    named = each.where("n_hit > 0").alias("e").join(lists.alias("l"), F.col("e.id").eqNullSafe(F.col("l.id")) & (F.col("e.digest") == F.col("l.digest")))
    out = clean.unionByName(named.select("e.id", "n_words", "copies", "n_hit", "items"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))

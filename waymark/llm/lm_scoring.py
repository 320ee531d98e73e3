"""Operator 1, LM scoring: stupid-backoff scores from n-gram counts of the whole corpus.

S(w | context) is count(context w) / count(context) where the n-gram was seen MIN_COUNT times or
more, else BACKOFF times S(w | shorter context), down to count(w) / tokens. A document's score is
the sum of log S over its words. The corpus scores itself, so each n-gram of a document has been
seen once at least, there; MIN_COUNT 2 asks for one more use, without which nothing would back off.

The corpus is dealt into chunks of documents by a hash, and each chunk counts its own distinct
n-grams. These partial counts are dealt by hash of the n-gram, as a table (group, chunk, hashes,
counts) of few wide rows, and added up; so a very common n-gram costs an entry for each chunk, not
for each use. The totals go back to the chunks in the order in which they sent their n-grams,
where they are joined to the exploded n-grams and summed by document.

Unigrams and bigrams go first. An n-gram of order 3 or more can only have been seen MIN_COUNT times
if both n-grams of one word less that it holds have; only such ones are sent, in a round for each
order, and the others back off without being counted. N-grams are told apart by 56 bits of a hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymark.llm.common import gram_hashes, groups_for, mixed, save, steps, tidy, utf8, word_hashes

ORDER, MIN_COUNT, BACKOFF = 3, 2, 0.4
#: Bytes of text of a chunk of documents, and of text for a group of n-grams.
CHUNK, GRAM_GROUP = 8 << 20, 4 << 20

_U = np.uint64


def grams(column: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words' rows, and for each n the hashes of all n-grams that start at each word and whether they stay in the row."""
    words, rows = [], []
    for low, high, data, offsets in steps(*utf8(column)):
        w, first = word_hashes(data, offsets)
        words.append(w)
        rows.append(np.repeat(np.arange(low, high), np.diff(first)))
    words = np.concatenate([np.zeros(0, np.uint64), *words])
    row = np.concatenate([np.zeros(0, np.int64), *rows])
    hashes = [mixed(words ^ _U(0xA5A5A5A5A5A5A5A5)), *(gram_hashes(words, n) for n in range(2, order + 1))]
    inside = [np.ones(len(words), bool), *(row[n - 1 :] == row[: len(row) - n + 1] if len(row) >= n else np.zeros(0, bool) for n in range(2, order + 1))]
    return row, hashes, inside


def _group_of(names: np.ndarray, groups: int) -> np.ndarray:
    """Group by range of the 56-bit name, so that sorted names fall into runs."""
    return ((names >> _U(24)) * _U(groups) >> _U(32)).astype(np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers by planes of equal bytes, which shuffle files compress where high bytes are alike."""
    return numbers.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(np.frombuffer(data, np.uint8).reshape(8, -1).T.tobytes(), kind)


def narrow(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, and those of 255 or more besides."""
    large = numbers >= 255
    return np.where(large, 255, numbers).astype(np.uint8).tobytes(), numbers[large].astype(np.int64).tobytes()


def widened(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, np.int64)
    return out


class Chunk:
    """N-grams of a chunk's words and, level by level, their totals. Level 0 has orders 1 and 2, level j has order j + 2."""

    def __init__(self, column: pa.Array, order: int, least: int) -> None:
        self.row, self.hashes, self.inside = grams(column, order)
        self.order, self.least = order, least
        #: Totals by order, for each place where an n-gram starts; 1 where it was not sent.
        self.counts: list[np.ndarray] = []

    def sent(self, level: int) -> list[np.ndarray]:
        """For each order of a level, which places' n-grams are sent; for level 1 and up the totals below must be known."""
        if not level:
            return self.inside[:2]
        n = level + 2
        known = self.counts[n - 2] >= self.least
        places = len(self.inside[n - 1])
        return [self.inside[n - 1] & known[:places] & known[1 : places + 1]]

    def orders(self, level: int) -> list[np.ndarray]:
        return self.hashes[:2] if not level else self.hashes[level + 1 : level + 2]

    def distinct(self, level: int, **options):
        """The n-grams sent, in the order that both uses of the chunk agree on."""
        return np.unique(np.concatenate([h[i] >> _U(8) for h, i in zip(self.orders(level), self.sent(level), strict=True)]), **options)

    def take(self, level: int, totals: list[tuple[int, bytes, bytes]]) -> None:
        """Totals of a level, as (group, small, large)."""
        found, place = self.distinct(level, return_inverse=True)
        total = np.concatenate([np.zeros(0, np.int64), *(widened(small, large) for _, small, large in sorted(totals))])
        if len(total) != len(found):
            raise ValueError("the chunk's n-grams changed between its two uses")
        at = 0
        for own in self.sent(level):
            counts = np.ones(len(own), np.int64)
            counts[own] = total[place[at : at + own.sum()]]
            at += own.sum()
            self.counts.append(counts)

    def take_all(self, totals: pa.Table, levels: int) -> None:
        rows: list[list] = [[] for _ in range(levels)]
        for level, g, small, large in zip(*(totals[c].to_pylist() for c in ("level", "g", "small", "large")), strict=True):
            rows[level].append((g, small, large))
        for level, own in enumerate(rows):
            self.take(level, own)


SENT = "g long, chunk long, base binary, steps binary, small binary, large binary"
TOTALS = "chunk long, level int, g long, small binary, large binary"


def _sent(chunk: Chunk, level: int, number: int, groups: int) -> pa.Table:
    """A row for each group of which the chunk has n-grams."""
    found, times = chunk.distinct(level, return_counts=True)
    group = _group_of(found, groups)
    steps_ = np.diff(found, prepend=_U(0))
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=groups + 1)) if len(found) else np.zeros(1, int)
    rows = [(int(group[a]), number, found[a - 1 : a].tobytes() if a else bytes(8), packed(steps_[a:b]), *narrow(times[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SENT.split(", ")])


def _count(order: int, least: int, groups: int):
    def count(docs: pa.Table) -> pa.Table:
        return _sent(Chunk(docs["text"], order, least), 0, docs["chunk"][0].as_py(), groups)

    return count


def _count_longer(order: int, least: int, groups: int, level: int):
    def count(docs: pa.Table, totals: pa.Table) -> pa.Table:
        chunk = Chunk(docs["text"], order, least)
        chunk.take_all(totals, level)
        return _sent(chunk, level, docs["chunk"][0].as_py(), groups)

    return count


def _add(level: int):
    def add(group: pd.DataFrame) -> pd.DataFrame:
        """Totals of a group's n-grams, for each chunk in its order."""
        parts = [np.cumsum(unpacked(s, np.uint64)) + np.frombuffer(b, np.uint64) for s, b in zip(group["steps"], group["base"], strict=True)]
        found, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(place, np.concatenate([widened(s, x) for s, x in zip(group["small"], group["large"], strict=True)]), len(found)).astype(np.int64)
        ends = np.cumsum([len(p) for p in parts])
        small, large = zip(*(narrow(total[place[e - len(p) : e]]) for e, p in zip(ends, parts, strict=True)), strict=True)
        return pd.DataFrame({"chunk": group["chunk"], "level": level, "g": group["g"], "small": small, "large": large})

    return add


SCORED = "n_tokens long, n_single long, n_backed_off long, part double"


def _score(order: int, least: int, backoff: float, key_field: pa.Field):
    def score(docs: pa.Table, totals: pa.Table) -> pa.Table:
        chunk = Chunk(docs["text"], order, least)
        chunk.take_all(totals, max(order - 1, 1))
        row, inside, counts = chunk.row, chunk.inside, chunk.counts
        n, docs_n = len(row), len(docs)
        value = np.log(counts[0])
        single, used = np.ones(n, bool), np.ones(n, np.int64)
        longest = np.ones(n, np.int64)
        for k in range(2, order + 1):  # a longer n-gram overrides shorter ones
            if n < k:
                break
            end = np.flatnonzero(inside[k - 1]) + k - 1
            longest[end] = k
            end = end[counts[k - 1][end - k + 1] >= least]
            value[end] = np.log(counts[k - 1][end - k + 1]) - np.log(counts[k - 2][end - k + 1])
            single[end], used[end] = False, k
        value += (longest - used) * np.log(backoff)
        columns = [
            np.bincount(row, minlength=docs_n),
            np.bincount(row, single, docs_n).astype(np.int64),
            np.bincount(row, longest > used, docs_n).astype(np.int64),
            np.bincount(row, value, docs_n).astype(np.float64),
        ]
        return pa.table([docs["k"].cast(key_field.type), *map(pa.array, columns)], names=["k", *(x.split()[0] for x in SCORED.split(", "))])

    return score


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, least: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """Per document: key, n_tokens, n_backed_off (words that a shorter context scored) and log_score.

    Words are A-Z lower-cased and split at ASCII white space. Null, empty or blank texts have no
    tokens and score 0. Repeated rows count as often as they come. Texts are whole, however long: a
    chunk is of CHUNK bytes or one longer text. Only key and text are read, so other columns cannot
    clash; no rows in, no rows out.
    """
    docs = df.select(df[key].alias("k"), F.coalesce(df[text], F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("b")).first()["b"]
    chunks, groups = groups_for(size, CHUNK), groups_for(size, GRAM_GROUP)
    # all uses of the chunks below share this one exchange of the texts; rows of one id and length part by where they were read
    number = F.pmod(F.xxhash64("k", F.length("text"), F.spark_partition_id()), F.lit(chunks))
    dealt = docs.withColumn("chunk", number).repartition(chunks, "chunk")
    counted = dealt.groupBy("chunk").applyInArrow(tidy(_count(order, least, groups)), SENT)
    totals = counted.groupBy("g").applyInPandas(tidy(_add(0)), TOTALS)
    for level in range(1, order - 1):
        met = dealt.groupBy("chunk").cogroup(totals.groupBy("chunk"))
        longer = met.applyInArrow(_count_longer(order, least, groups, level), SENT)
        totals = totals.unionByName(longer.groupBy("g").applyInPandas(tidy(_add(level)), TOTALS))
    kind = docs.schema["k"].dataType
    score = _score(order, least, backoff, pa.field("k", to_arrow_type(kind)))
    scored = dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(score, f"k {kind.simpleString()}, {SCORED}")
    scored = save(scored)
    tokens = scored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    log_score = F.col("part") - F.col("n_single") * F.lit(float(np.log(max(tokens, 1))))
    return scored.select(F.col("k").alias(key), "n_tokens", "n_backed_off", log_score.alias("log_score"))


#: Order 3: a word is scored by the two words before it, else by one, else by none.
ORACLE = """
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w
  FROM documents
),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
tok AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM places),
one AS (SELECT c, count(*) AS n FROM tok GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM tok WHERE i > 1 GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM tok WHERE i > 2 GROUP BY a, b, c),
total AS (SELECT count(*) AS n FROM tok),
found AS (
  SELECT tok.doc_id, least(i, 3) AS longest, CASE WHEN three.n >= 2 THEN 3 WHEN two.n >= 2 THEN 2 ELSE 1 END AS used,
    own.n AS n1, ctx.n AS c1, two.n AS n2, before.n AS c2, three.n AS n3
  FROM tok JOIN one own ON own.c = tok.c
  LEFT JOIN one ctx ON ctx.c = tok.b
  LEFT JOIN two ON two.b = tok.b AND two.c = tok.c
  LEFT JOIN two before ON before.b = tok.a AND before.c = tok.b
  LEFT JOIN three ON three.a = tok.a AND three.b = tok.b AND three.c = tok.c
),
scored AS (
  SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE longest > used) AS n_backed_off,
    sum((longest - used) * ln(0.4) + CASE used WHEN 3 THEN ln(n3) - ln(c2) WHEN 2 THEN ln(n2) - ln(c1) ELSE ln(n1) - ln((SELECT n FROM total)) END) AS s
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, CAST(coalesce(n_backed_off, 0) AS BIGINT) AS n_backed_off,
  round(coalesce(s, 0), 4) AS log_score
FROM documents d LEFT JOIN scored USING (doc_id)
"""

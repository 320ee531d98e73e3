"""Operator 7, document fingerprints: a Merkle tree over paragraphs and sections.

Paragraphs (leaves) are pieces that end with a line end or with a word end after one of some last
signs, or else after PIECE code points; line ends belong to their piece, so the pieces together
are the text. A section ends with a leaf whose digest begins with SECTION_END, or with the text.
Both cuts are made by content alone, at every length of text: an insertion changes the leaf it
falls into, and no leaf after the next cut.

Every digest is MD5 (128 bits): a leaf's over its piece, a section's over its leaves' digests, the
root's over the sections' digests. written() is the whole tree, root, then each section's
digest with its leaves, so every node can be computed again from its children. Equal roots mean
equal texts; where roots differ, differing() opens only the branches that have no equal on the
other side.

The fingerprint is the root and at most BRANCHES branches of TAG hex digits each: the sections, or, where
those are more, groups of them that end as sections do, and groups of groups. So it is bounded, whatever the text's
length, and fingerprints that differ tell which branches do. Likeness is that of the leaves of both trees.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import tidy

PIECE = 64
#: A piece: up to a last sign of a word and what parts it from the next, or a line end, else PIECE code points. Any regex engine of first matches reads it alike.
PIECES = (
    r"(?s:.{0,62}?(?:[y0.,;:!?\x{80}-\x{10FFFF}][\x{00}-\x{09}\x{0B}-/:-@\[-`{-~\x{3000}-\x{3002}\x{FF01}-\x{FF1F}]|\n)|.{1,64})"
)
SECTION_END = "0"
#: Branches in a fingerprint at most, and hex digits of each.
BRANCHES, TAG = 16, 16
#: Bytes of text of a block of the order of ids, about.
BLOCK_BYTES = 32 << 20
#: So many rows for each block are chosen and every so manieth of them, in order, is a head: blocks come out even.
DRAWN = 16
#: Drawn keys that one task puts in order, about.
RANGE = 1 << 16

_pieces = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda x: rf"\U{int(x[1], 16):08x}", PIECES))


def digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def pieces_of(text: str) -> list[str]:
    """The paragraphs of a text; joined they are the text."""
    return _pieces.findall(text)


def leaves_of(text: str, known: dict[str, str] | None = None) -> list[str]:
    """Digests of the paragraphs; `known` has digests of pieces seen before and takes new ones."""
    known = {} if known is None else known
    out = []
    for piece in pieces_of(text):
        leaf = known.get(piece)
        if leaf is None:
            leaf = known[piece] = digest(piece)
        out.append(leaf)
    return out


def grouped(digests: list[str]) -> list[str]:
    """Bodies of the groups of digests, each up to one that begins with SECTION_END."""
    return "".join([d + ("|" if d[0] == SECTION_END else ",") for d in digests])[:-1].split("|")


def written(leaves: list[str]) -> str:
    """root|section:leaf,leaf,...|section:..., digests in hex."""
    if not leaves:
        return digest("")
    bodies = grouped(leaves)
    names = [digest(body) for body in bodies]
    return "|".join([digest(",".join(names)), *(f"{n}:{b}" for n, b in zip(names, bodies, strict=True))])


def fingerprint(tree: str) -> str:
    """root|branch,branch,... of a written tree."""
    names = [n for n, _ in sections(tree)]
    while len(names) > BRANCHES:
        names = [digest(body) for body in grouped(names)]
    return "|".join([root(tree), ",".join(n[:TAG] for n in names)]) if names else root(tree)


def root(tree: str) -> str:
    return tree[:32]


def sections(tree: str) -> list[tuple[str, list[str]]]:
    return [(p[:32], p[33:].split(",")) for p in tree.split("|")[1:]]


def consistent(tree: str) -> bool:
    """Whether every inner node is the digest of its children."""
    found = sections(tree)
    names = [n for n, _ in found]
    return root(tree) == digest(",".join(names)) and all(n == digest(",".join(leaves)) for n, leaves in found)


def likeness(a: list[str], b: list[str], same_root: bool) -> float:
    """Dice's coefficient of the leaves as multisets; 1 for equal roots, 0 where only one is empty."""
    if same_root:
        return 1.0
    if not a or not b:
        return 0.0
    return 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))


def _unlike(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Runs a[i:j] that b has as b[k:l] otherwise, after equal ends are taken off and the rest is aligned."""
    low, n, m = 0, len(a), len(b)
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    while min(n, m) > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    found = SequenceMatcher(None, a[low:n], b[low:m], autojunk=False).get_opcodes()
    return [(i + low, j + low, k + low, end + low) for tag, i, j, k, end in found if tag != "equal"]


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, leaf) of the leaves of tree `a` that tree `b` lacks at that place of the aligned order.

    Sections are aligned by their digests first; only those without an equal are opened, and their
    leaves aligned. What `b` only has besides shows in differing(b, a).
    """
    if root(a) == root(b):
        return []
    ours, theirs = sections(a), sections(b)
    out = []
    for i, j, k, end in _unlike([n for n, _ in ours], [n for n, _ in theirs]):
        places = [(s, p) for s in range(i, j) for p in range(len(ours[s][1]))]
        leaves = [ours[s][1][p] for s, p in places]
        for x, y, _, _ in _unlike(leaves, [leaf for _, own in theirs[k:end] for leaf in own]):
            out += places[x:y]
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_chars, its fingerprint, that of its edited text, and likeness to both that and the next document.

    The next document is the next smaller key, after the smallest the largest; equal keys follow
    each other by a hash of the text, null keys come after all others. Rows that agree in key and
    text follow one another. Null text counts as empty: no leaves, and likeness 1 to another empty
    text. A lone document is its own next. Only key and text are read, so other columns cannot
    clash; an empty table gives no rows. A task holds two texts at a time, however long.

    The order is cut into blocks of about `block_bytes` at rows that a hash chooses (heads) and the
    highest. DRAWN keys for each block are put in order by Spark and only every DRAWN-th of them, one
    key for each block, comes to the driver, as a range partitioner's bounds do. One shuffle deals
    the blocks to tasks; a head also goes to the end of the block before it (the highest to the end
    of the last), so no task needs another's rows.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(df[key].alias("k"), F.coalesce(df[text], F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    place = F.struct(F.col("k").isNotNull().alias("there"), "k", "h")
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("t").cast("long")).alias("b"), F.max(place).alias("top")).first()
    spacing = max(1, size["n"] * block_bytes // max(size["b"] or 0, 1) // DRAWN)
    drawn = docs.where(F.pmod(F.xxhash64(F.lit("head"), "k", "h"), F.lit(spacing)) == 0).select("k", "h").distinct()
    rising = [F.col("k").isNotNull(), F.col("k"), F.col("h")]
    ranges = drawn.repartitionByRange(1 + size["n"] // spacing // RANGE, *rising).withColumn("part", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*rising))
    chosen = ranges.withColumn("nth", nth).where(F.col("nth") % DRAWN == 0).select("k", "h").collect()
    heads = sorted({*(_place(r["k"], r["h"]) for r in chosen), *([_place(size["top"]["k"], size["top"]["h"])] if size["n"] else [])})
    dealt = docs.mapInArrow(tidy(_deal(heads)), f"k {kind}, t string, b int, copy int, h long")
    order = [F.col("b"), F.col("copy"), F.col("k").desc_nulls_last(), F.desc("h")]
    dealt = dealt.repartitionById(max(len(heads), 1), F.col("b")).sortWithinPartitions(*order).drop("h")
    return dealt.mapInArrow(tidy(_walk), f"`{key}` {kind}, {SCHEMA}")


def _place(k, h: int) -> tuple:
    """Where a row comes in the rising order: null keys first."""
    return (k is not None, k if k is not None else 0, h)


def _deal(heads: list[tuple]):
    """Adds the block: that of the least head at or above the row. A head's copy ends the block above it, the highest one's the lowest block."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, block, copy = [], [], []
            for i, (k, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                at = _place(k, h)
                own = bisect_left(heads, at)
                rows.append(i)
                block.append(own)
                copy.append(0)
                if heads[own] == at:
                    rows.append(i)
                    block.append((own + 1) % len(heads))
                    copy.append(1)
            if rows:
                k, t, h = batch.take(pa.array(rows)).columns
                yield pa.RecordBatch.from_arrays([k, t, pa.array(block, pa.int32()), pa.array(copy, pa.int32()), h], names=["k", "t", "b", "copy", "h"])

    return deal


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block in order, each with the row after it; the first copy of the next block's head only follows."""
    held: tuple | None = None  # key, text, digests by piece, leaves, tree of the row whose next isn't known
    out: list[tuple] = []
    size = 0
    for batch in batches:
        kind = batch.schema.field(0).type
        keys, texts, copies = batch.column(0), batch.column(1), batch.column(3).to_pylist()
        for i in range(len(batch)):
            if copies[i] and held is None:
                continue
            text, known = texts[i].as_py(), {}
            leaves = leaves_of(text, known)
            now = (keys[i].as_py(), text, known, leaves, written(leaves))
            if held is not None:
                out.append(_pair(held, now))
                size += len(text)
            held = None if copies[i] else now
            if size > 1 << 21 or len(out) >= 500:
                yield _batch(out, kind)
                out, size = [], 0
    if out:
        yield _batch(out, kind)


def _pair(row: tuple, following: tuple) -> tuple:
    key, text, known, leaves, tree = row
    new = edited(text, following[1])
    new_leaves = leaves_of(new, following[2] | known)
    new_tree = written(new_leaves)
    return (
        key, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(tree), fingerprint(new_tree),
        likeness(leaves, new_leaves, root(tree) == root(new_tree)),
        likeness(leaves, following[3], root(tree) == root(following[4])),
    )


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    names = ["k", *(x.split()[0] for x in SCHEMA.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *map(pa.array, columns[1:])], names=names)

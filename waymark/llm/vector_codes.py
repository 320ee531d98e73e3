"""Operator 12, vector code compression: each part of a vector becomes the number of its nearest codebook entry.

Components become whole numbers, floor(SCALE * x), and every vector is cut into PARTS consecutive
parts. A part position's codebook starts as that part of the first ENTRIES vectors in order of id;
ROUNDS times every part is assigned to its nearest entry (squared distance, ties to the lower
number) and an entry becomes the componentwise floor of its parts' mean. Entries without parts stay.

Segment-mean lower bounds. For any cut into blocks, the squared distance of x and c is the sum of
length * (mean of x - mean of c)^2 over the blocks, and the squared distance of what is left of both
without the means, which is no less than (norm of the one rest - norm of the other)^2. Entries
are first held against one block for the whole part, those that remain against two, then four, and
so on while blocks have two components or more. An entry goes if its bound exceeds the exact distance
of the entry that looked nearest; the bounds are lowered by more than doubles can err. What survives
gets its exact distance in whole numbers, so the codes are those of a full search.

A task streams its vectors against codebooks of PARTS * ENTRIES entries and hands on one sum for
each entry; sums are added by Spark, and only the codebooks (at most ENTRIES vectors) are ever on the driver.

Defined results: vectors that are null, hold null, NaN or infinite components, or ones of LARGE and
more after scaling (their squares would not fit into 64 bits), are dropped, as are those whose
length differs from that of the first kept vector. Parts are i * length / PARTS up to (i + 1) *
length / PARTS, so they differ by one component where PARTS doesn't divide the length; a part
without components has code 0 and error 0. Null ids come last; rows of equal id are ordered by their
components, and repeated rows count each. Fewer than ENTRIES vectors give as many entries; an empty
table an empty result. Null labels are one label. Extra columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import join_skewed, save, tidy, whole

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components below this: squares of differences, summed over up to 512 components, fit into 64 bits.
LARGE = 1 << 26
#: Vectors that meet the codebooks at once.
STEP = 2048


def bounds_of(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """First and end component of each part."""
    return [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


def block_levels(width: int) -> list[list[tuple[int, int]]]:
    """Cuts of a part of `width` components into 1, 2, 4, ... blocks, while blocks have two components or more."""
    levels, n = [], 1
    while width and (n == 1 or width // n >= 2):
        levels.append([(i * width // n, (i + 1) * width // n) for i in range(n)])
        n *= 2
    return levels


def _profile(rows: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """For each row, by block mean * sqrt(length), and last the norm of the row without the means."""
    sums = np.stack([rows[:, a:b].sum(1) / np.sqrt(b - a) for a, b in blocks], 1)
    rest = (rows.astype(np.float64) ** 2).sum(1) - (sums**2).sum(1)
    return np.concatenate([sums, np.sqrt(np.maximum(rest, 0))[:, None]], 1)


def nearest_entries(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest entry of each row and its exact distance (whole numbers), and how many exact distances that took."""
    n, width = rows.shape
    if not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    exact = lambda r, e: ((rows[r] - book[e]) ** 2).sum(1)
    levels = block_levels(width)
    mine, theirs = _profile(rows, levels[0]), _profile(book, levels[0])
    low = sum((mine[:, i, None] - theirs[:, i]) ** 2 for i in range(mine.shape[1]))
    # a double errs by less than 2^-40 of the squares that enter
    slack = (np.square(rows.astype(np.float64)).sum(1)[:, None] + np.square(book.astype(np.float64)).sum(1)) * 2.0**-40 + 1
    most = exact(np.arange(n), low.argmin(1))
    row, entry = np.nonzero(low - slack <= most[:, None])
    for blocks in levels[1:]:
        mine, theirs = _profile(rows, blocks), _profile(book, blocks)
        low = ((mine[row] - theirs[entry]) ** 2).sum(1)
        stays = low - slack[row, entry] <= most[row]
        row, entry = row[stays], entry[stays]
    met = exact(row, entry)
    begins = np.searchsorted(row, np.arange(n))
    best = np.minimum.reduceat(met, begins)
    hit = np.flatnonzero(met == best[row])
    return entry[hit[np.searchsorted(row[hit], np.arange(n))]], best, len(met)


def _whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).astype(np.int64).reshape(-1, width)


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has only components that can be used."""
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGE / SCALE, F.lit(False)) & ~F.isnan(x))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fits)


def _sums(books: list[np.ndarray]):
    """A task's rows (part, entry, n, sums of components) of the parts nearest to each entry."""
    width = sum(b.shape[1] for b in books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros_like(b) for b in books]
        for batch in batches:
            for low in range(0, len(batch), STEP):
                rows = _whole_numbers(batch.column(0).slice(low, STEP), width)
                for p, (a, b) in enumerate(bounds_of(width, len(books))):
                    entry, _, _ = nearest_entries(rows[:, a:b], books[p])
                    counts[p] += np.bincount(entry, minlength=len(books[p]))
                    np.add.at(totals[p], entry, rows[:, a:b])
        at = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in at], pa.int32()) for i in (0, 1)] + [pa.array([counts[p][e] for p, e in at], pa.int64()), pa.array([totals[p][e] for p, e in at], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    return add


def fit(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> list[np.ndarray]:
    """Codebooks (entries, components) by part; an empty list where no vector is kept."""
    good = kept(vectors, vector).select(F.col(id_column).alias("id"), F.col(vector).alias("e"))
    order = [F.col("id").asc_nulls_last(), F.col("e").asc()]
    first = good.orderBy(*order).limit(1).collect()
    if not first:
        return []
    width = len(first[0]["e"])
    good = good.where(F.size("e") == width)
    start = np.floor(np.array([r["e"] for r in good.orderBy(*order).limit(ENTRIES).collect()], np.float64) * SCALE).astype(np.int64)
    books = [start[:, a:b].copy() for a, b in bounds_of(width)]
    for _ in range(ROUNDS):
        rows = good.select("e").mapInArrow(tidy(_sums(books)), "part int, entry int, n long, sums array<long>")
        one = rows.select("part", "entry", "n", F.posexplode_outer("sums").alias("place", "s")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        for r in one.where("place IS NOT NULL").collect():  # at most ENTRIES vectors
            books[r["part"]][r["entry"], r["place"]] = r["s"] // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(vectors: DataFrame, books: list[np.ndarray], vector: str = "embedding") -> DataFrame:
    """Kept rows with `code` (a byte for each part) and `error` (their squared distances to the entries, summed)."""
    width = sum(b.shape[1] for b in books)
    rows = kept(vectors, vector).where(F.size(vector) == width).select(whole(vectors), F.col(f"`{vector}`").alias("e"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), STEP):
                part = batch.slice(low, STEP)
                values = _whole_numbers(part.column(1), width)
                codes, errors = np.zeros((len(part), len(books)), np.uint8), np.zeros(len(part), np.int64)
                for p, (a, b) in enumerate(bounds_of(width, len(books))):
                    codes[:, p], found, _ = nearest_entries(values[:, a:b], books[p])
                    errors += found
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], names=["row", "code", "error"])

    kind = rows.select("row").schema.simpleString()[len("struct<row:") : -1]
    return rows.mapInArrow(tidy(code), f"row {kind}, code binary, error long")


def decoded(code: bytes, books: list[np.ndarray]) -> np.ndarray:
    """The vector that a code stands for, in whole numbers."""
    return np.concatenate([book[c] for book, c in zip(books, code, strict=True)])


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """row (the input row), code, error, label_error (error summed over rows of one label) and codebooks_sha256 for each kept vector.

    Sums of a label are added up before they meet its rows; rows of frequent labels are not gathered.
    """
    books = fit(vectors, id_column, vector)
    if not books:
        return vectors.where("false").select(whole(vectors), F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
    name = F.coalesce(F.concat(F.lit("="), F.col(f"row.`{label}`").cast("string")), F.lit(""))
    coded = save(encoded(vectors, books, vector).withColumn("label_key", name))
    sums = coded.groupBy("label_key").agg(F.sum("error").alias("label_error"))
    return join_skewed(coded, sums, "label_key").select("row", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

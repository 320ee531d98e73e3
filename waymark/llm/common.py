"""Helpers that several corpus operators share: scratch tables, UTF-8 batches, hashes."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one step of a numpy loop holds; whole documents are never cut for it.
STEP_BYTES = 1 << 20
#: Documents in one Arrow batch.
BATCH_ROWS = 1000

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, as in tests, an own one, if driver and executors are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="waymark-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return "file://" + _own_folder[0]


def small_batches(spark: SparkSession) -> SparkSession:
    """Rows of whole texts go to Python in batches of BATCH_ROWS, so that batches fit beside the heap on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def tidy(step: Callable) -> Callable:
    """A function for mapInArrow or applyInPandas that afterwards hands freed memory back to the system.

    Python workers wait for more work; what they hold meanwhile lies beside the executor's heap.
    """

    def run(rows):
        out = step(rows)
        if isinstance(out, Iterator):
            return _then_trim(out)
        _trim()
        return out

    return run


def _then_trim(out: Iterator) -> Iterator:
    yield from out
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def save(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lineage ends here.

    The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that save() wrote."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        return


def whole(df: DataFrame) -> Column:
    """A row as one column, row, so that names of its columns can't clash with an operator's own; row.* takes it apart."""
    return F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row")


def fields(df: DataFrame, keys: list[str], more: str) -> StructType:
    """Columns `keys` of df and those of a DDL string."""
    return StructType([*(df.schema[k] for k in keys), *StructType.fromDDL(more).fields])


def small_enough(df: DataFrame, row_bytes: str, limit: int = 32 << 20) -> bool:
    """Whether the rows of a saved table, each of the bytes `row_bytes` says in SQL, fit in `limit`."""
    return (df.agg(F.coalesce(F.sum(F.expr(row_bytes)), F.lit(0)).alias("n")).first()["n"]) <= limit


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str], how: str, row_bytes: str) -> DataFrame:
    """Broadcast `small` if its measured bytes allow that, else let Spark shuffle both sides."""
    return big.join(F.broadcast(small) if small_enough(small, row_bytes) else small, on, how)


#: A key of a join is hot beyond this share of the rows: one in so many, so there are no more hot keys than that.
HOT_SHARE = 1000


def join_skewed(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left join right, which has each key once, where a few keys may have most of the rows of `left` (a saved table).

    Rows of the at most HOT_SHARE hot keys stay where they are and meet a broadcast table of as many rows; the rest is shuffled.
    """
    rows = left.count()
    hot = F.broadcast(left.groupBy(on).agg(F.count("*").alias("hot_rows")).where(F.col("hot_rows") * HOT_SHARE > rows).select(on))
    cold = left.join(hot, on, "left_anti").join(right, on, how)
    warm = left.join(hot, on, "left_semi").join(F.broadcast(right.join(hot, on, "left_semi")), on, how)
    return cold.unionByName(warm)


def numbered(docs: DataFrame, name: str, key: str, ties: list[str]) -> DataFrame:
    """Adds `name` (long, unique), in the order of key, nulls last, then ties: the key itself where keys are unique whole numbers and not null.

    Otherwise, and for keys of any other type, rows get rising numbers in a distributed sort, which is written down.
    """
    if docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        seen = docs.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids")).first()
        if seen["rows"] == seen["ids"]:
            return docs.withColumn(name, F.col(key).cast("long"))
    order = [F.col(key).asc_nulls_last(), *ties]
    return save(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def groups_for(units: int, per_group: int, least: int = 12) -> int:
    """How many hash groups keep each near `per_group` units; grows with the data, has no ceiling."""
    return max(least, -(-int(units) // per_group))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(data: np.ndarray, offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `limit` bytes: first row, end row, bytes, offsets from 0."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


# --- hashes ----------------------------------------------------------------

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _words() -> np.ndarray:
    table = np.ones(256, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


#: Kind of each byte: tokens are runs of bytes of one kind, but kind 0 parts them.
WORDS, LOWER = _words(), _lower()


def word_hashes(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = WORDS, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token and, for each row, where its tokens begin (one more entry: their number).

    By default tokens are words, A-Z lower-cased, split at ASCII white space.
    """
    n = len(data)
    kind = kinds[data]
    begins = kind > 0
    begins[1:] &= kind[1:] != kind[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = kind[firsts] > 0
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    spread = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, spread)
    powers = np.full(int(spread.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    value = (fold[data[starts[0] :]].astype(np.uint64) + _U(1)) * powers[place]
    value[kind[starts[0] :] == 0] = 0
    return mixed(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i : i + n] for each i that has so many."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, 0x51ED270B0129 * n & 0xFFFFFFFFFFFFFFFF, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _U(factor)
        factor = (factor * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D | 1) & 0xFFFFFFFFFFFFFFFF
    return mixed(total)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)

"""Retrieved history: the recorded vectors most like a query's, found by an index of cells.

build() fits centers on a bounded sample (at most SAMPLE rows, those of least hash) and then puts
every row into the cell of its nearest center. search() sends a query to the cells of its `probes` nearest
centers; calibrate() finds how many that must be. With exact=True a second round follows: angles between unit vectors obey the triangle
inequality, so a cell can only hold something better than the k-th found if the query's angle to its center less
the cell's radius is no larger than that one's angle; all such cells are searched too.

Rows and queries of a cell meet in blocks, so a cell with most of the rows is many tasks. Only centers,
radii and numbers of rows, one for each cell and at most CELLS of them, are on the driver.

A vector without direction (null, of another length, with null or non-finite components, or all 0) is not
indexed and finds nothing. Scores are cosines of 6 decimals, ties go to the least id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.sources.scratch import save

#: Rows that centers are fitted on, most centers, rounds of fitting, and cells that a search looks into.
SAMPLE, CELLS, ROUNDS, PROBES = 4096, 1024, 6, 16
#: Queries that calibrate() tries, and the share of right rows to be found among theirs.
TRIED, TARGET = 256, 0.95
#: Rows of a cell, and queries, that meet in one group.
ROWS_BLOCK, QUERIES_BLOCK = 8192, 1024
#: Queries of a group that are compared at once: the matrices of a whole group took some hundred MB of each worker.
QUERIES_AT_ONCE = 64


class Index(NamedTuple):
    """rows (cell, id, at, e) are all rows that have a direction; the arrays have a place for each cell."""

    rows: DataFrame
    centers: np.ndarray
    radii: np.ndarray
    counts: np.ndarray


def _units(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def _directed(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """Rows (id, at, e) whose vector has a direction."""
    fine = F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("e", lambda x: x != 0)
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("at").cast("long").alias("at"), F.col("e").cast("array<double>").alias("e"))
    rows = rows.where(F.col("id").isNotNull() & F.col("e").isNotNull() & fine)
    return rows if width is None else rows.where(F.size("e") == width)


def fit_centers(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centers by spherical k-means; the first ones are rows spread over the sample."""
    centers = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        own = (sample @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centers = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centers)
    return centers


def build(vectors: DataFrame, cells: int | None = None) -> Index | None:
    """An index of vectors (id, at, e); about the square root of the rows as cells unless said, CELLS at most. None without rows."""
    rows = _directed(vectors)
    first = rows.agg(F.count("*").alias("n"), F.min_by(F.size("e"), F.col("id")).alias("width")).first()
    if not first["n"]:
        return None
    width = first["width"]
    rows = rows.where(F.size("e") == width)
    drawn = rows.orderBy(F.xxhash64("id", "e"), "id").limit(SAMPLE).select("e").toArrow()
    centers = fit_centers(_units(drawn["e"], width), min(CELLS, cells or max(1, int(first["n"] ** 0.5))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                met = _units(batch.column(2), width) @ centers.T
                best = met.argmax(1)
                angle = np.arccos(np.clip(met[np.arange(len(best)), best], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), *batch.columns, pa.array(angle)], names=["cell", "id", "at", "e", "angle"])

    placed = save(rows.mapInArrow(assign, "cell int, id long, at long, e array<double>, angle double"))
    radii, counts = np.zeros(len(centers)), np.zeros(len(centers), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():
        radii[r["cell"]], counts[r["cell"]] = r["radius"], r["n"]
    return Index(placed.drop("angle"), centers, radii, counts)


def _nearest_cells(index: Index, probes: int):
    """Queries (id, at, e) with each of the cells of their nearest centers that hold rows."""
    filled = np.flatnonzero(index.counts)
    centers = index.centers[filled]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            met = _units(batch.column(2), centers.shape[1]) @ centers.T
            n = min(probes, len(filled))
            cells = filled[np.argpartition(-met, n - 1, axis=1)[:, :n]]
            rows = pa.array(np.repeat(np.arange(len(batch)), n))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(cells.ravel(), pa.int32())], names=["id", "at", "e", "cell"])

    return probe


def _possible_cells(index: Index):
    """Queries (id, at, e, least) with each cell that may hold a score of `least` or more; null is any score."""
    filled = np.flatnonzero(index.counts)
    centers, radii = index.centers[filled], index.radii[filled]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            angle = np.arccos(np.clip(_units(batch.column(2), centers.shape[1]) @ centers.T, -1, 1))
            most = np.cos(np.maximum(angle - radii, 0))
            least = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            row, cell = np.nonzero((most >= least[:, None] - 2e-6) | np.isnan(least)[:, None])  # scores are rounded
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in range(3)), pa.array(filled[cell], pa.int32())], names=["id", "at", "e", "cell"])

    return probe


def _meet(k: int, earlier: bool):
    """The k best rows of a block for each query of a block."""

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "candidate", "score"]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        if not len(rows) or not len(queries):
            return pa.table([pa.array([], kind) for kind in kinds], names=names)
        rows = rows.sort_by("id")
        ids, width = rows["id"].to_numpy(), len(queries["e"][0])
        its, at = _units(rows["e"], width), rows["at"].to_numpy(zero_copy_only=False).astype(np.float64)
        found = []
        for start in range(0, len(queries), QUERIES_AT_ONCE):
            some = queries.slice(start, QUERIES_AT_ONCE)
            asked = some["id"].to_numpy()
            met = np.round(_units(some["e"], width) @ its.T, 6)
            other = ids[None, :] != asked[:, None]
            if earlier:
                own = some["at"].to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(invalid="ignore"):
                    other &= at[None, :] < own[:, None]  # nulls are never earlier
            met[~other] = -np.inf
            best = np.argsort(-met, axis=1, kind="stable")[:, :k]  # rows are in order of id
            score = np.take_along_axis(met, best, 1)
            has = score > -np.inf
            found.append((np.repeat(asked, best.shape[1]).reshape(best.shape)[has], ids[best][has], score[has]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    return meet


def _searched(index: Index, asked: DataFrame, k: int, earlier: bool, queries_block: int | None = None) -> DataFrame:
    """Best k of each query and block for (id, at, e, cell), saved."""
    spark = asked.sparkSession
    n_asked = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = [(c, -(-int(index.counts[c]) // ROWS_BLOCK), -(-n // (queries_block or QUERIES_BLOCK))) for c, n in n_asked.items()]
    shape = F.broadcast(spark.createDataFrame(blocks, "cell int, row_blocks long, query_blocks long"))  # a row for each cell
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = index.rows.join(shape, "cell").withColumn("row_block", F.pmod(F.xxhash64("id"), "row_blocks")).withColumn("query_block", every("query_blocks"))
    queries = asked.join(shape, "cell").withColumn("query_block", F.pmod(F.xxhash64("id"), "query_blocks")).withColumn("row_block", every("row_blocks"))
    key = ["cell", "row_block", "query_block"]
    columns = ["id", "at", "e", *key]
    met = rows.select(columns).groupBy(*key).cogroup(queries.select(columns).groupBy(*key)).applyInArrow(_meet(k, earlier), "query_id long, candidate long, score double")
    return save(met)


def search(index: Index, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False, earlier: bool = False, queries_block: int | None = None) -> DataFrame:
    """query_id, rank (from 1), candidate and score of the k best rows other than the query itself.

    `earlier` leaves only rows whose `at` is less than the query's. Ids of queries are unique.
    """
    width = index.centers.shape[1]
    asked = save(_directed(queries, width).mapInArrow(_nearest_cells(index, probes), "id long, at long, e array<double>, cell int"))
    found = _searched(index, asked, k, earlier, queries_block)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("candidate"))
    if exact:
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        bound = _directed(queries, width).join(ranked, "id", "left").select("id", "at", "e", "least")
        more = bound.mapInArrow(_possible_cells(index), "id long, at long, e array<double>, cell int").join(asked.select("id", "cell"), ["id", "cell"], "left_anti")
        found = found.unionByName(_searched(index, save(more.select("id", "at", "e", "cell")), k, earlier, queries_block))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "candidate", "score")


def calibrate(index: Index, queries: DataFrame, k: int, target: float = TARGET, earlier: bool = False) -> int:
    """How many cells a search must look into to find the share `target` of the right rows.

    Measured on at most TRIED queries, those of least hash, by the place that the cell of each exactly
    found row has among the query's centers. Vectors without clusters need most cells.
    """
    some = _directed(queries, index.centers.shape[1]).orderBy(F.xxhash64("id", "e"), "id").limit(TRIED)
    some = save(some)
    right = search(index, some, k, exact=True, earlier=earlier)
    cells = index.rows.select(F.col("id").alias("candidate"), "cell")
    held = right.select("query_id", "candidate").join(cells, "candidate").join(some.select(F.col("id").alias("query_id"), "e"), "query_id").select("cell", "e").toArrow()
    if not len(held):
        return PROBES
    met = _units(held["e"], index.centers.shape[1]) @ index.centers.T
    met[:, index.counts == 0] = -np.inf
    own = np.take_along_axis(met, held["cell"].to_numpy()[:, None].astype(np.int64), 1)
    places = np.sort((met > own).sum(1)) + 1
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)])


def recall(found: DataFrame, right: DataFrame) -> DataFrame:
    """query_id, wanted and met: how many of the right candidates of each query were found."""
    hit = found.select("query_id", "candidate", F.lit(1).alias("hit"))
    return right.join(hit, ["query_id", "candidate"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("met"))


def history_features(retrieved: DataFrame, outcomes: DataFrame) -> DataFrame:
    """For each query its number of retrieved rows, best and mean score, and the share of them whose outcome is the query's own.

    outcomes: id and outcome. Null outcomes agree with nothing.
    """
    own = outcomes.select(F.col("id").alias("query_id"), F.col("outcome").alias("own"))
    its = outcomes.select(F.col("id").alias("candidate"), "outcome")
    met = retrieved.join(its, "candidate", "left").join(own, "query_id", "left")
    agrees = F.coalesce((F.col("own") == F.col("outcome")).cast("double"), F.lit(0.0))
    return met.groupBy("query_id").agg(F.count("*").alias("n_retrieved"), F.max("score").alias("best"), F.avg("score").alias("mean"), F.avg(agrees).alias("agreement"))

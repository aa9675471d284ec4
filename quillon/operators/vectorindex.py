"""Inverted-file vector index: rows stored by the nearest of some centroids, probed by distance bounds, rescored exactly.

`build` fits centroids to a sample of at most SAMPLE vectors and stores every row with its cell and its unit vector. `nearest`
asks the `probes` nearest cells of each query first. The k-th best similarity found is a bound: by the triangle inequality a cell whose
centroid is further from the query than that distance and the cell's radius together holds nothing better. With `exact` all cells
that the bound leaves are asked as well, so the answer is that of a full comparison; without it the first probes are the answer.

Cells near each other are taken together as regions of about SLICE rows, and a cell of more rows is dealt to slices. Queries are sent to
the regions of their cells by a shuffle, one copy to each slice, in blocks of about BLOCK queries to which the rows are copied. Tasks hold one block's queries of one
slice and one batch of rows, multiply TILE by TILE of them, and send a query's best k rows, with all that tie with the last of them, so that another
order can choose among equals; once a bound is known, they send only what reaches it.

Defined results: null, empty and zero vectors, and those with null or non-finite components, are in no cell and have no neighbours;
queries of another length than the index have none. Null ids are left out. Similarities are rounded to `digits` before they are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import cut, ship

SAMPLE, ROUNDS, MOST_CELLS, SLICE, TILE, BLOCK = 32_768, 4, 2048, 8192, 1024, 32_768


def usable(column: str) -> Column:
    fine = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(column) > 0) & fine & F.exists(column, lambda x: x != 0), F.lit(False))


def units(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def to_cells(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of unit vectors, and the distance to it."""
    d = np.maximum(1 + (centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T, 0)
    cell = d.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
    return cell, np.sqrt(d[np.arange(len(x)), cell])


def regions(centroids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Number of each cell's region: along a walk from centroid to nearest centroid, cells are taken together up to SLICE rows."""
    out, now, number, rows = np.zeros(len(centroids), np.int64), 0, 0, 0
    left = np.ones(len(centroids), bool)
    for _ in range(len(centroids)):
        if rows and rows + count[now] > SLICE:
            number, rows = number + 1, 0
        out[now], left[now] = number, False
        rows += count[now]
        if left.any():
            now = int(np.where(left, ((centroids - centroids[now]) ** 2).sum(axis=1), np.inf).argmin())
    return out


class Index:
    """Centroids with their radii and regions, and the table of rows (chunk_id, cell, reach, unit)."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, size: int):
        self.rows, self.centroids, self.size = rows, centroids, size
        stats = rows.groupBy("cell").agg(F.max("reach").alias("reach"), F.count(F.lit(1)).alias("n")).collect()  # one row a cell
        self.radius, self.count = np.full(len(centroids), -1.0), np.zeros(len(centroids), np.int64)
        for r in stats:
            self.radius[r["cell"]], self.count[r["cell"]] = r["reach"], r["n"]
        self.region = regions(centroids, self.count)
        held = np.bincount(self.region, self.count).astype(np.int64)
        self.slices = -(-held // SLICE)

    def within(self, ids: DataFrame) -> Index:
        """The same index of some of its rows (chunk_id) alone."""
        return Index(self.rows.join(ids, "chunk_id", "left_semi"), self.centroids, self.size)


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a bounded sample of unit vectors by Lloyd's rounds from evenly spaced rows of it."""
    mids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        at, _ = to_cells(sample, mids)
        sums = np.zeros_like(mids)
        np.add.at(sums, at, sample)
        n = np.bincount(at, minlength=cells)
        mids[n > 0] = sums[n > 0] / n[n > 0, None]
    return mids


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Index of vectors (chunk_id, b): of the length most rows have (ties: the longer); others are not in it."""
    spark = vectors.sparkSession
    ship(spark)
    fine = vectors.where(F.col("chunk_id").isNotNull() & usable("b")).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.transform("b", lambda x: x.cast("double")).alias("b"))
    sizes = fine.groupBy(F.size("b").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size, n = (sizes["size"], sizes["count"]) if sizes else (1, 0)
    fine = fine.where(F.size("b") == size)
    drawn = fine.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("b").toArrow()["b"].combine_chunks()  # at most `sample` vectors
    points = units(drawn) if len(drawn) else np.zeros((1, size))
    cells = max(1, min(cells or int(np.sqrt(n)), MOST_CELLS, len(points)))
    mids = fit(points, cells)
    held = spark.sparkContext.broadcast(mids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(batch["b"])
            cell, reach = to_cells(x, held.value)
            yield pa.RecordBatch.from_arrays([batch["chunk_id"], pa.array(cell.astype(np.int32)), pa.array(reach), pa.array([r.tobytes() for r in x], pa.binary())], ["chunk_id", "cell", "reach", "unit"])

    rows = fine.mapInArrow(placed, "chunk_id long, cell int, reach double, unit binary")
    return Index(cut(rows.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell")), mids, size)


def scored(k: int, digits: int):
    """For mapInArrow on rows sorted by region, slice, block and kind (queries first): each query's best k rows and what ties with the last of them."""

    def matrix(batch: pa.RecordBatch, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = batch.slice(low, high - low)
        return np.asarray(part["id"]), np.frombuffer(b"".join(part["unit"].to_pylist()), np.float64).reshape(high - low, -1), np.asarray(part["least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, ids, asked, least = None, [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch[c]) for c in ("region", "slice", "block", "kind")]
            turns = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in keys])) + 1
            for low, high in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                *place, kind = (c[low] for c in keys)
                if place != now:
                    now, parts, ids = place, [], None
                if kind == 0:
                    parts.append(matrix(batch, low, high))
                    continue
                if not parts:
                    continue
                if ids is None:
                    ids, asked, least = (np.concatenate(x) for x in zip(*parts, strict=True))
                names, x, _ = matrix(batch, low, high)
                for a in range(0, len(ids), TILE):
                    q, found = slice(a, min(a + TILE, len(ids))), []
                    for b in range(0, len(names), TILE):
                        s = np.round(asked[q] @ x[b : b + TILE].T, digits) + 0.0
                        s[ids[q, None] == names[None, b : b + TILE]] = -np.inf
                        if s.shape[1] >= k:
                            least[q] = np.maximum(least[q], np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                        at, of = np.nonzero((s >= least[q, None]) & np.isfinite(s))
                        found.append((at, names[b + of], s[at, of]))
                    at, of, s = (np.concatenate(f) for f in zip(*found, strict=True))
                    kept = s >= least[q][at]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q][at[kept]]), pa.array(of[kept]), pa.array(s[kept])], ["question_id", "chunk_id", "similarity"])

    return run


def asked_regions(index: Index, queries: DataFrame, limits: DataFrame | None, probes: int, digits: int) -> DataFrame:
    """(region, slice, kind, id, unit, least) of the regions each query asks: those of its nearest `probes` cells, or, given limits (question_id, least), all others that may hold as much."""
    mids, radius, region, slices, some = index.centroids, index.radius, index.region, index.slices, index.count > 0
    member = np.zeros((len(mids), len(slices)), np.float32)
    member[np.arange(len(mids)), region] = some
    further = limits is not None
    rows = queries.join(limits, "question_id", "left") if further else queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TILE):
                part = batch.slice(low, TILE)
                x = units(part["a"])
                apart = np.sqrt(np.maximum(1 + (mids**2).sum(axis=1)[None, :] - 2 * x @ mids.T, 0))
                order = np.argsort(np.where(some, apart, np.inf), axis=1, kind="stable")
                cells = np.zeros(apart.shape, np.float32)
                np.put_along_axis(cells, order[:, :probes], 1, axis=1)
                chosen, value = cells @ member > 0, np.full(len(x), -np.inf)
                if further:
                    value = np.array([-np.inf if v is None else v for v in part["least"].to_pylist()])
                    furthest = np.sqrt(np.maximum(2 - 2 * (np.maximum(value, -1.0) - 10.0**-digits), 0))  # of unit vectors of that cosine
                    near = apart - radius[None, :] <= furthest[:, None] + 1e-9
                    chosen = ~chosen & (near.astype(np.float32) @ member > 0)
                at, of = np.nonzero(chosen)
                times = slices[of]
                at, of = np.repeat(at, times), np.repeat(of, times)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                unit = pa.array([r.tobytes() for r in x], pa.binary()).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(np.zeros(len(of), np.int32)), part["question_id"].take(pa.array(at)), unit, pa.array(value[at])], ["region", "slice", "kind", "id", "unit", "least"]
                )

    return rows.mapInArrow(run, "region int, slice int, kind int, id long, unit binary, least double")


def nearest(queries: DataFrame, index: Index, k: int, probes: int = 8, exact: bool = True, digits: int = 6) -> DataFrame:
    """(question_id, chunk_id, similarity) of the k nearest rows by cosine of each query (question_id, a), with all that tie with the last; never of the query's own id."""
    spark = queries.sparkSession
    fine = queries.where(F.col("question_id").isNotNull() & usable("a") & (F.size("a") == index.size)).select(F.col("question_id").cast("long").alias("question_id"), F.transform("a", lambda x: x.cast("double")).alias("a"))
    blocks = max(1, -(-fine.count() // BLOCK))
    cells = [(i, int(r), int(index.slices[r])) for i, (r, n) in enumerate(zip(index.region, index.count, strict=True)) if n]
    rows = index.rows.join(F.broadcast(spark.createDataFrame(cells or [(0, 0, 1)], "cell int, region int, slices int")), "cell")  # one row a cell, at most MOST_CELLS
    rows = rows.select("region", F.pmod(F.xxhash64("chunk_id"), "slices").cast("int").alias("slice"), F.lit(1).alias("kind"), F.col("chunk_id").alias("id"), "unit", F.lit(0.0).alias("least"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def against(asked: DataFrame) -> DataFrame:
        own = rows.join(F.broadcast(asked.select("region").distinct()), "region", "left_semi")  # no more than cells
        both = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).unionByName(own).repartition("region", "slice", "block").sortWithinPartitions("region", "slice", "block", "kind")
        return both.mapInArrow(scored(k, digits), "question_id long, chunk_id long, similarity double")

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("question_id").orderBy(F.desc("similarity"))
        return found.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k).drop("_r")

    first = cut(best(against(asked_regions(index, fine, None, probes, digits))))
    if not exact:
        return first
    enough = first.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")).where(F.col("n") >= k).select("question_id", "least")
    return best(first.unionByName(against(asked_regions(index, fine, enough, probes, digits))))


def hybrid_pool(queries: DataFrame, index: Index, lexical: Callable[[DataFrame], DataFrame], k: int = 5, probes: int = 8, exact: bool = True) -> DataFrame:
    """(question_id, chunk_id, similarity, lexical, nth): the max(25, 5 k) nearest rows by (similarity, lexical rank), largest first; ids end ties.

    `lexical` takes (question_id, chunk_id) pairs and gives their (question_id, chunk_id, rank).
    """
    n = max(25, 5 * k)
    found = cut(nearest(queries, index, n, probes, exact))
    both = found.join(lexical(found), ["question_id", "chunk_id"], "left").withColumn("lexical", F.coalesce("rank", F.lit(0.0)))
    w = Window.partitionBy("question_id").orderBy(F.desc("similarity"), F.desc("lexical"), "chunk_id")
    return both.withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= n).select("question_id", "chunk_id", "similarity", "lexical", "nth")

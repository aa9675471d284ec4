"""Centroid clustering by ball k-means over integer vectors.

A cluster is a ball: its centroid and the radius of its members. A centroid j is a neighbour of i only where it is nearer to i than
twice the radius. Members nearer to their centroid than half the distance to the closest neighbour form the stable core and are
compared with nothing; the others lie in annuli, and a member of annulus n is compared with the n nearest neighbours alone.
All distances are exact integers, so a skipped comparison could not have changed a result, ties included.

Every round is one scan: a task replays a vector's earlier rounds (a core member costs one distance a round), so no assignment is
written or shuffled between rounds, and sends one row of sums a cluster. The driver holds centroids alone: k of them, at most
MOST_CLUSTERS, for each round. Radii are those of the members at hand in a batch, which bound fewer neighbours than those of all.

Defined results: vectors that are null, of another length, or with null or non-finite components take no part. Nor do those
with a component of LARGEST or more in absolute value once scaled, whose distances a long can't hold. Rows that repeat a vec_id are
vectors of their own; repeated ids among the initial centroids are ordered by their components. A null vec_id is assigned but is
never an initial centroid. With fewer vectors than clusters there are as many centroids as vectors; of an empty table nothing
is returned. Ties go to the smaller cluster number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import ship, table

LARGEST, MOST_CLUSTERS, ROWS = 1 << 27, 4096, 4096


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, taken as double, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def whole_vectors(df: DataFrame, vector: str, scale: int, size: int | None = None) -> Column:
    """Whether a row's vector takes part: present, of the given size if any, all components finite and within LARGEST once scaled."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * scale < LARGEST, F.lit(False)))
    return F.col(vector).isNotNull() & ((F.size(vector) == size) if size else (F.size(vector) > 0)) & fine


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows of integers."""
    return np.einsum("ij,ij->i", x - c, x - c)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every row, compared with all; ties to the smaller number."""
    best, where = distances(x, centroids[np.zeros(len(x), np.int64)]), np.zeros(len(x), np.int64)
    for j in range(1, len(centroids)):
        d = distances(x, centroids[j][None, :])
        closer = d < best
        best[closer], where[closer] = d[closer], j
    return where, best


def ball_step(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroids of rows whose clusters were `own`, their distances, and how many comparisons beyond a row's own it took."""
    best, where, compared = distances(x, centroids[own]), own.copy(), 0
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        mine = best[members]
        apart = distances(centroids, centroids[i][None, :])
        order = np.argsort(apart, kind="stable")
        order = order[(order != i) & (apart[order] <= 4 * mine.max())]  # neighbours: no further than twice the radius
        for j in order:
            out = np.flatnonzero(4 * mine >= apart[j])  # the annuli that this neighbour bounds from inside
            rows = members[out]
            d = distances(x[rows], centroids[j][None, :])
            compared += len(rows)
            closer = (d < best[rows]) | ((d == best[rows]) & (j < where[rows]))
            best[rows[closer]], where[rows[closer]] = d[closer], j
    return where, best, compared


def replay(x: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    where, best = nearest(x, history[0])
    for centroids in history[1:]:
        where, best, _ = ball_step(x, where, centroids)
    return where, best


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def ball_kmeans(spark: SparkSession, df: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    if not 0 < k <= MOST_CLUSTERS:
        raise ValueError(f"k must be within 1 and {MOST_CLUSTERS}")
    ship(spark)
    points = df.where(whole_vectors(df, vector, scale, size)).select(F.col(key).alias("key"), scaled(vector, scale).alias("x"))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = points.where("key IS NOT NULL").select(draw.alias("draw"), "x").orderBy("draw", "x").limit(k).collect()  # k vectors
    if not first:
        first, rounds = points.select("x").orderBy("x").limit(k).collect(), rounds  # ids are null throughout
    history = [np.array([r["x"] for r in first], np.int64).reshape(len(first), size)]
    if not first:
        history = [np.zeros((1, size), np.int64)]  # nothing takes part: nothing is assigned to it

    for _ in range(rounds if first else 0):
        held = spark.sparkContext.broadcast(history)

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            past = held.value
            total, count = np.zeros(past[0].shape, np.int64), np.zeros(len(past[0]), np.int64)
            for batch in batches:
                for low in range(0, batch.num_rows, ROWS):
                    x = matrix(batch["x"].slice(low, ROWS))
                    where, _ = replay(x, past)
                    for j in np.unique(where):
                        total[j] += x[where == j].sum(axis=0)
                    count += np.bincount(where, minlength=len(count))
            seen = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen]), pa.array(list(total[seen]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

        parts = points.select("x").mapInArrow(sums, "cluster long, n long, total array<long>")
        parts = parts.select("cluster", "n", F.posexplode("total").alias("at", "total"))
        rows = parts.groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k * size
        following = history[-1].copy()
        for r in rows:
            following[r["cluster"], r["at"]] = int(r["total"]) // int(r["n"])
        history.append(following)
        held.destroy()

    final = spark.sparkContext.broadcast(history)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                where, best = replay(matrix(batch["x"].slice(low, ROWS)), final.value)
                yield pa.RecordBatch.from_arrays([batch["key"].slice(low, ROWS), pa.array(where.astype(np.int32)), pa.array(best)], ["key", "cluster", "distance"])

    kind = points.schema["key"].dataType.simpleString()
    found = table(spark, points.mapInArrow(assigned, f"key {kind}, cluster int, distance long"), "assigned")
    final.destroy()
    of = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    total = sum(r["cluster_inertia"] for r in of)
    rows = [(r["cluster"], r["cluster_inertia"], total, digests[r["cluster"]]) for r in of]
    said = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(said), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(rounds: int = 3) -> str:
    whole = "len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64"
    parts = [f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 64) AS BIGINT)) AS x FROM embeddings WHERE {whole})"]
    parts.append("c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS j, x AS c FROM v WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT 16)")
    for n in range(rounds + 1):
        parts.append(
            f"a{n} AS MATERIALIZED (SELECT r, arg_min(j, d * 16 + j) AS j, min(d) AS d FROM (SELECT r, j, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{n}) GROUP BY r)"
        )
        if n < rounds:
            # floor(sum / count) of whole numbers: // truncates towards zero, so a remainder below zero takes one more away
            floor = "CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT)"
            parts.append(
                f"m{n} AS (SELECT j, p, {floor} AS y FROM (SELECT j, p, sum(y) AS s, count(*) AS n FROM (SELECT j, unnest(x) AS y, unnest(range(1, 65)) AS p FROM a{n} JOIN v USING (r)) GROUP BY j, p))"
            )
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT j, coalesce(y.c, k.c) AS c FROM c{n} k LEFT JOIN (SELECT j, list(y ORDER BY p) AS c FROM m{n} GROUP BY j) y USING (j))")
    last = f"a{rounds}"
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN v USING (r) JOIN c{rounds} USING (j)"
    )


SQL = _sql()

"""Hard-negative mining by a Voronoi-partitioned distributed nearest-neighbour join.

Vectors become whole numbers. Each is augmented by one coordinate, sqrt(M^2 - |x|^2) with M the largest norm (0 for anchors), after
which the largest inner products with an anchor are the smallest distances to it. Pivots, far from each other among rows drawn by
hash, deal the space into Voronoi cells; every row keeps its cell and its distance to the pivot.

1. Anchors form groups: those of one cell and, for positives, one label; groups beyond GROUP anchors are split by hash.
2. Positives: the distances of the closest candidates to their pivots (a summary of k + 1 rows a label and cell) bound a group's k-th
   neighbour from above by the triangle inequality. A candidate is sent to a group of its label only where its distance to its own
   pivot leaves it within that bound; groups meet their candidates in a local exact join.
3. Negatives: the scores of an anchor's positives give bands of inner products, hence rings of distances. A candidate is sent to a
   group only where the triangle inequality lets it lie in the ring that all of the group's bands span; again the join is exact.

The candidates of a group are dealt to slices of about SLICE rows, so that neither a hot label, a hot cell nor a group of copies is
one task's work; a task holds one group's anchors and one batch. Slices send each anchor's best rows only, which are ranked by a window.
Scores are exact integers (in doubles where those hold them, else in longs), the bounds have a margin for rounding, so
pruning loses nothing. Whatever the bounds prune, no candidate or pair is capped.

Defined results: rows with a null label, with null, empty or unequally long vectors (the length of most rows is taken; ties: the
longer), with null or non-finite components, or with a component of LARGEST or more once scaled, whose scores a long can't hold, take no
part. A row that repeats a vec_id is a row of its own: it can be the other's positive, and as an anchor it repeats the result. Null
vec_ids serve as candidates, after all others of the same score, and are no anchors. Labels are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.centroids import scaled, whole_vectors
from quillon.llm.shared import parts, ship, table

LARGEST, PIVOTS, PER_PIVOT, DRAWN, GROUP, SLICE = 1 << 27, 128, 256, 8, 2048, 1 << 13
#: Products compared at once, and the last place of a null vec_id.
CELLS, ROWS_A_TASK, LAST = 1 << 21, 1 << 17, np.iinfo(np.int64).max
MARGIN = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), -1).astype(np.int64) if rows else np.zeros((0, 1), np.int64)


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs."""
    top = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0))
    return np.rint(a.astype(float) @ c.T.astype(float)).astype(np.int64) if top < 1 << 52 else a @ c.T


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of 4 a component, with their squared norms."""
    for batch in batches:
        n = batch.num_rows
        x = np.asarray(batch["x"].flatten()).reshape(n, -1) if n else np.zeros((0, 1), np.int64)
        rest = [batch[c] for c in ("rid", "vec_id", "label")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array((x.astype(float) ** 2).sum(axis=1))], ["rid", "vec_id", "label", "vec", "norm"])


def celled(pivots: np.ndarray, largest: float, anchor: bool):
    """For mapInArrow: each row's nearest pivot and the distance to it, in the augmented space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, norm = matrix(batch["vec"]).astype(float), np.asarray(batch["norm"])
            more = np.zeros(len(norm)) if anchor else np.sqrt(np.maximum(largest - norm, 0))
            d = np.maximum((norm + more**2)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots[:, :-1].T + more[:, None] * pivots[:, -1][None, :]), 0)
            cell = d.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64)), pa.array(np.sqrt(d[np.arange(len(x)), cell]))], [*batch.schema.names, "cell", "reach"])

    return run


def apart_from_each_other(points: np.ndarray, k: int) -> np.ndarray:
    """k of the points, each the furthest from those taken before it."""
    taken, gap = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(taken) < k and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[taken[-1]]) ** 2).sum(axis=1))
    return points[taken]


def best(score: np.ndarray, order: np.ndarray, k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed scores of each row, the smaller `order` first among equals."""
    n = score.shape[1]
    if int(np.abs(score).max(initial=0)) < (1 << 62) // max(1, n):
        key = np.where(allowed, score * n + (n - 1 - order)[None, :], np.iinfo(np.int64).min)
        top = np.argpartition(key, max(0, n - k), axis=1)[:, max(0, n - k) :] if n else np.zeros((len(score), 0), np.int64)
    else:  # products near a long's bounds: sorted whole
        place = np.where(allowed, 0, 1)
        top = np.stack([np.lexsort((order, -s.astype(object), p))[:k] for s, p in zip(score, place, strict=True)])
    rows = np.repeat(np.arange(len(score)), top.shape[1])
    top = top.ravel()
    fine = allowed[rows, top]
    return rows[fine], top[fine]


def places(ids: np.ndarray, rids: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), np.int64)
    out[np.lexsort((rids, ids))] = np.arange(len(ids))
    return out


def met(work):
    """For mapInArrow on rows sorted by group, slice and kind: work(anchors, candidates) for one group's anchors and one batch of candidates."""

    def columns(batch: pa.RecordBatch, rows: np.ndarray) -> dict:
        part = batch.take(pa.array(rows))
        out = {c: np.asarray(part[c].fill_null(LAST)) for c in ("rid", "vec_id", "label")}
        return {**out, "vec": matrix(part["vec"]), "bands": part["bands"].to_pylist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, fresh = None, [], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, piece, kind = (np.asarray(batch[c]) for c in ("grp", "slice", "kind"))
            turns = np.flatnonzero((grp[1:] != grp[:-1]) | (piece[1:] != piece[:-1]) | (kind[1:] != kind[:-1])) + 1
            for low, high in zip([0, *turns], [*turns, len(grp)], strict=True):
                if (grp[low], piece[low]) != now:
                    now, anchors, fresh = (grp[low], piece[low]), [], {}
                if kind[low] == 0:
                    anchors.append(columns(batch, np.arange(low, high)))
                    continue
                if not anchors:
                    continue
                if not fresh:
                    fresh = {c: np.concatenate([a[c] for a in anchors]) if c != "bands" else [b for a in anchors for b in a[c]] for c in anchors[0]}
                step = max(1, CELLS // len(fresh["rid"]))
                for at in range(low, high, step):
                    yield from work(fresh, columns(batch, np.arange(at, min(high, at + step))))

    return run


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == LAST)


def nearest_same(k: int):
    """Best k other rows of an anchor's label."""

    def work(a: dict, c: dict) -> Iterator[pa.RecordBatch]:
        score = products(a["vec"], c["vec"])
        rows, cols = best(score, places(c["vec_id"], c["rid"]), k, (a["label"][:, None] == c["label"][None, :]) & (a["rid"][:, None] != c["rid"][None, :]))
        yield pa.RecordBatch.from_arrays([pa.array(a["rid"][rows]), pa.array(score[rows, cols]), id_array(c["vec_id"][cols]), pa.array(c["rid"][cols])], ["anchor", "score", "vec_id", "rid"])

    return met(work)


def banded(k: int):
    """Best k rows of another label within each band of an anchor."""

    def work(a: dict, c: dict) -> Iterator[pa.RecordBatch]:
        score, order = products(a["vec"], c["vec"]), places(c["vec_id"], c["rid"])
        other = a["label"][:, None] != c["label"][None, :]
        for i in range(max((len(b) for b in a["bands"]), default=0)):
            mine = np.array([j for j, b in enumerate(a["bands"]) if len(b) > i], np.int64)
            low, high, rank = (np.array([a["bands"][j][i][x] for j in mine], np.int64) for x in ("low", "high", "rank"))
            s = score[mine]
            rows, cols = best(s, order, k, other[mine] & (s >= low[:, None]) & (s <= high[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a["rid"][mine[rows]]), pa.array(rank[rows].astype(np.int32)), pa.array(s[rows, cols]), id_array(c["vec_id"][cols]), pa.array(c["rid"][cols])], ["anchor", "positive", "score", "vec_id", "rid"]
            )

    return met(work)


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def grouped(anchors: DataFrame, keys: list[str], group: int) -> tuple[DataFrame, DataFrame]:
    """Anchors with `grp` and `part`, and one row a group: its keys, cell and radius."""
    counts = anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / group).cast("long").alias("parts"))
    placed = anchors.join(counts, keys).withColumn("grp", F.xxhash64(*keys, F.pmod(F.xxhash64("rid"), "parts")))
    return placed, placed.groupBy(*keys, "grp")


def meeting(spark: SparkSession, anchors: DataFrame, candidates: DataFrame, rule: DataFrame, on: list[str], fits: Column, slice_rows: int, work, schema: str) -> DataFrame:
    """Sends the candidates that fit a group's rule to it, in slices, with the anchors of the group to each slice; then work()."""
    rule = table(spark, rule, "rule")
    slices = rule.groupBy("grp").agg(F.ceil(F.sum("held") / slice_rows).cast("int").alias("slices"))
    most = rule.agg(F.sum("held")).first()[0] or 0  # rows sent, at the most
    sent = candidates.join(rule.drop("held").join(slices, "grp"), on).where(fits)
    none = F.lit(None).cast("array<struct<low:long,high:long,rank:int>>")
    sent = sent.select("grp", F.pmod(F.xxhash64("rid"), "slices").cast("int").alias("slice"), F.lit(1).alias("kind"), "rid", "vec_id", "label", "vec", none.alias("bands"))
    here = anchors.join(slices, "grp").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    both = sent.unionByName(here.select("grp", "slice", F.lit(0).alias("kind"), "rid", "vec_id", "label", "vec", "bands"))
    dealt_out = both.repartition(max(parts(spark), min(most // ROWS_A_TASK, 1 << 17)), "grp", "slice").sortWithinPartitions("grp", "slice", "kind")
    return dealt_out.mapInArrow(work, schema)


def hard_negatives(
    spark: SparkSession, df: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), most_pivots: int = PIVOTS, per_pivot: int = PER_PIVOT, group: int = GROUP, slice_rows: int = SLICE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    An anchor's positives are its best rows of the same label; of each, the best rows of other labels whose score lies within `band`
    per cent of the positive's are returned. df has vec_id, embedding and label; `anchor` is a condition on vec_id.
    """
    ship(spark)
    fine = df.where(F.col("label").isNotNull() & whole_vectors(df, "embedding", scale))
    sizes = fine.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    points = fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled("embedding", scale).alias("x")).where(F.size("x") == (sizes["size"] if sizes else 0))
    points = points.withColumn("rid", F.monotonically_increasing_id()).select("rid", "vec_id", "label", "x")
    rows = table(spark, points.mapInArrow(packed, "rid long, vec_id long, label long, vec binary, norm double"), "vectors")
    asked = rows.where(F.coalesce(anchor, F.lit(False)))
    largest, n = rows.agg(F.max("norm")).first()[0] or 0.0, asked.count()
    few = min(max(1, -(-n // per_pivot)), most_pivots)
    drawn = rows.orderBy(F.xxhash64("vec"), "rid").limit(DRAWN * few).select("vec").collect()  # at most DRAWN * most_pivots vectors
    own = [np.frombuffer(r["vec"], "<i4").astype(float) for r in drawn] or [np.zeros(1)]
    pivots = apart_from_each_other(np.array([[*v, math.sqrt(max(0.0, largest - float((v**2).sum())))] for v in own]), few)
    apart = np.array([np.sqrt(((pivots - p) ** 2).sum(axis=1)) for p in pivots])
    pairs = spark.createDataFrame([(i, j, float(apart[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "cell long, home long, apart double")
    pairs = F.broadcast(pairs)  # most_pivots squared rows of three numbers
    margin = MARGIN * (largest + 1)

    with_cell = "rid long, vec_id long, label long, vec binary, norm double, cell long, reach double"
    candidates = table(spark, rows.mapInArrow(celled(pivots, largest, False), with_cell), "candidates")
    anchors = table(spark, asked.mapInArrow(celled(pivots, largest, True), with_cell), "anchors")

    # positives: the bound of a group is the (k + 1)-th smallest upper bound, one more for the anchor itself
    close = Window.partitionBy("label", "cell").orderBy("reach", "rid")
    summary = candidates.select("label", "cell", "reach", "rid").withColumn("at", F.row_number().over(close)).where(F.col("at") <= positives + 1)
    held = candidates.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("held"))
    placed, groups = grouped(anchors, ["label", "cell"], group)
    groups = groups.agg(F.max("reach").alias("radius")).withColumnRenamed("cell", "home").join(pairs, "home")
    upper = groups.join(summary.select("label", "cell", "reach"), ["label", "cell"]).select("grp", (F.col("apart") + F.col("radius") + F.col("reach")).alias("upper"))
    nth = upper.withColumn("at", F.row_number().over(Window.partitionBy("grp").orderBy("upper"))).where(F.col("at") == positives + 1).select("grp", "upper")
    rule = groups.join(held, ["label", "cell"]).join(nth, "grp", "left")
    # |q - c| >= |pivot - pivot'| - |q - pivot'| - |c - pivot|, so those further from their pivot than the rest of the bound may serve
    rule = rule.select("grp", "label", "cell", "held", (F.col("apart") - F.col("radius") - F.coalesce("upper", F.lit(float("inf")))).alias("least"))
    none = F.lit(None).cast("array<struct<low:long,high:long,rank:int>>")
    near = meeting(spark, placed.withColumn("bands", none), candidates, rule, ["label", "cell"], F.col("reach") >= F.col("least") - math.sqrt(margin), slice_rows, nearest_same(positives), "anchor long, score long, vec_id long, rid long")
    chosen = table(spark, ranked(near, ["anchor"], positives).select("anchor", "rank", "score", "vec_id"), "positives")

    # negatives: bands of scores, and the ring of distances that the bands of a group span
    low, high = (F.expr(f"CAST({f}(CAST(score AS DECIMAL(20,0)) * {b} / 100) AS LONG)") for f, b in (("ceil", band[0]), ("floor", band[1])))
    bands = chosen.withColumns({"low": low, "high": high}).where("low <= high").groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("low", "high", "rank"))).alias("bands"), F.min("low").alias("low"), F.max("high").alias("high"))
    wanted = anchors.join(bands.withColumnRenamed("anchor", "rid"), "rid")
    square = lambda s: F.sqrt(F.greatest(F.col("norm") + largest - 2 * F.col(s), F.lit(0.0)))  # noqa: E731  distance at a score
    wanted = wanted.withColumns({"inner": square("high"), "outer": square("low")})
    placed, groups = grouped(wanted, ["cell"], group)
    groups = groups.agg(F.max("reach").alias("radius"), F.min("inner").alias("inner"), F.max("outer").alias("outer")).withColumnRenamed("cell", "home").join(pairs, "home")
    rule = groups.join(candidates.groupBy("cell").agg(F.count(F.lit(1)).alias("held")), "cell").drop("home")
    slack = math.sqrt(margin)
    far = F.col("apart") + F.col("radius") + F.col("reach")
    closest = F.greatest(F.col("apart") - F.col("radius") - F.col("reach"), F.col("reach") - F.col("apart") - F.col("radius"))
    fits = (far >= F.col("inner") - slack) & (closest <= F.col("outer") + slack)
    hard = meeting(spark, placed, candidates, rule, ["cell"], fits, slice_rows, banded(negatives), "anchor long, positive int, score long, vec_id long, rid long")
    hard = ranked(hard, ["anchor", "positive"], negatives).select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    said = chosen.select("anchor", F.col("rank").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return hard.join(said, ["anchor", "positive"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(df: DataFrame) -> DataFrame:
    """vec_id, label and embedding, where the label of every seventh vec_id is another's."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return df.select("vec_id", label.alias("label"), "embedding")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark, relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 50 == 0)


SQL = """WITH fine AS (SELECT * FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(CAST(e AS DOUBLE) * 256)) AS x FROM fine),
s AS MATERIALIZED (SELECT a.rid AS anchor, a.vec_id AS anchor_id, a.label = c.label AS same, c.rid, c.vec_id, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
FROM v a JOIN v c ON a.rid <> c.rid AND len(a.x) = len(c.x) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY n.score DESC, n.vec_id, n.rid) AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY n.score DESC, n.vec_id, n.rid) <= 3"""

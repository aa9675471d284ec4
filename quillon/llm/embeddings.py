"""Embedding near-dedup by sorted projection passes.

1. Equal vectors of a label are one class with a weight.
2. In every pass, vectors are ordered by label and 64 concatenated bits of random hyperplanes, dealt to tasks by ranges of that
   order, and each is compared with its `near` next neighbours of the label in double precision. The rows around the borders of
   ranges are compared in a second step, however few rows a range has, so the links do not depend on the ranges. A task sends
   only a spanning forest of the links it finds.
3. Links of all passes are united by distributed star contraction.
4. Links are then counted exactly within each component. By the triangle inequality on angles, members that are all within
   half the threshold angle of their mean direction are all linked, which takes sums alone; members of other components are
   compared in pairs of blocks of BLOCK rows, and only counts leave a task. So dense groups aren't cut off by the window.

Every link counted has cosine >= threshold. A link is missed only where no pass joins its ends' components: see README for
the recall measured.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those with null labels, link with
nothing: n_links 0, their own component. Vectors of different length never link. Rows that repeat a vec_id are vectors of
their own. A null vec_id takes part but is never kept, and names no component while another member has an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import components, parts, ship, table

THRESHOLD, PASSES, NEAR, BLOCK = 0.93, 16, 64, 2048
TILE, CHUNK = 64, 4096
SLACK = 1e-6


def usable(column: str = "embedding") -> F.Column:
    x = F.col(column)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(F.col("label").isNotNull() & (F.size(x) > 0) & sound, F.lit(False))


def matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, "<f8") for b in column.to_pylist()]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def classes(rows: DataFrame) -> DataFrame:
    """(cid, grp, weight, vec): one row for each distinct vector of a label; vec holds doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v.values, np.float64).tobytes() for v in batch["embedding"]]
            yield pa.RecordBatch.from_arrays([batch["cid"], batch["grp"], batch["weight"], pa.array(vectors, pa.binary())], ["cid", "grp", "weight", "vec"])

    found = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.first("grp").alias("grp"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    return found.mapInArrow(run, "cid long, grp long, weight long, vec binary")


def ordered(base: DataFrame, passes: int, seed: int) -> DataFrame:
    """(pass, grp, key, cid, vec) in the order of each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                part = batch.slice(low, CHUNK)
                vectors = matrix(part["vec"])
                sizes = np.array([len(v) for v in vectors])
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    own = part.take(pa.array(at))
                    x = np.stack([vectors[i] for i in at])
                    if size not in planes:
                        planes[size] = np.random.default_rng([seed, int(size)]).standard_normal((int(size), 64 * passes))
                    bits = np.packbits(x @ planes[size] > 0, axis=1).view(">u8").astype(np.uint64)
                    keys = (bits ^ np.uint64(1 << 63)).view(np.int64)
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p)), own["grp"], pa.array(keys[:, p].copy()), own["cid"], own["vec"]], ["pass", "grp", "key", "cid", "vec"])

    return base.mapInArrow(run, "pass long, grp long, key long, cid long, vec binary")


class Forest:
    """Union-find over class ids; `links` are the edges that joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))

    def batch(self) -> pa.RecordBatch:
        links, self.links = self.links, []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have cosine >= threshold, in double precision; scaled first, so that no square overflows or vanishes."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    out = unit(x) @ unit(y).T >= threshold - 1e-9
    for i, j in zip(*np.nonzero(out & (unit(x) @ unit(y).T < threshold + 1e-9)), strict=True):
        out[i, j] = float(np.dot(x[i], y[j])) / math.sqrt(float(np.dot(x[i], x[i])) * float(np.dot(y[j], y[j]))) >= threshold
    return out


def compare(run: np.ndarray, cids: np.ndarray, x: np.ndarray, near: int, threshold: float, forest: Forest) -> None:
    """Joins the linked neighbours among rows in order; only rows of one run are neighbours."""
    for t in range(0, len(x), TILE):
        y = x[t : t + TILE + near]
        own = y[:TILE]
        ok = linked(own, y, threshold)
        gap = np.arange(len(y))[None, :] - np.arange(len(own))[:, None]
        ok &= (gap > 0) & (gap <= near) & (run[t : t + len(own)][:, None] == run[t : t + len(y)][None, :])
        if not ok.any():
            continue
        full = np.eye(len(y), dtype=bool)
        full[: len(own)] |= ok
        full |= full.T
        label = np.arange(len(y))
        while True:
            low = np.where(full, label[None, :], len(y)).min(axis=1)
            if (low == label).all():
                break
            label = low
        # a star of a tile's component joins its members, though not each pair of a star is a link itself
        for i in np.flatnonzero(label != np.arange(len(y))):
            forest.join(int(cids[t + i]), int(cids[t + label[i]]))


EDGE = "a long, b long, part long, is_tail boolean, nth long, rows long, pass long, grp long, cid long, vec binary"


def neighbours(near: int, threshold: float):
    """For a range of the order: its links, and its first and last rows for the steps over borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        forest, head, tail, count = Forest(), [], [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                rows = list(zip(*(batch.slice(low, CHUNK)[c].to_pylist() for c in ("pass", "grp", "cid", "vec")), strict=True))
                head += rows[: max(0, near - count)]
                together(tail + rows, near, threshold, forest)
                tail = (tail + rows)[-near:]
                count += len(rows)
        edges = [(part, False, i, count, *r) for i, r in enumerate(head)] + [(part, True, count - len(tail) + i, count, *r) for i, r in enumerate(tail)]
        n, m = len(forest.links), len(edges)
        columns = [[x[i] for x in forest.links] + [None] * m for i in (0, 1)] + [[None] * n + [e[i] for e in edges] for i in range(8)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in EDGE.split(", ")])

    return run


def borders(counts: dict[int, int], near: int) -> list[tuple[int, int, bool]]:
    """(side, part, is_tail): the ranges whose last rows lie within `near` before the border after range `side`, or first rows behind it."""
    parts_, out = sorted(counts), []
    for i, side in enumerate(parts_[:-1]):
        for inside, is_tail in ((reversed(parts_[: i + 1]), True), (parts_[i + 1 :], False)):
            room = near
            for p in inside:
                out.append((side, p, is_tail))
                room -= counts[p]
                if room <= 0:
                    break
    return out


def together(rows: list[tuple], near: int, threshold: float, forest: Forest) -> None:
    low = 0
    while low < len(rows):
        high = low
        size = len(rows[low][3])
        while high < len(rows) and len(rows[high][3]) == size:
            high += 1
        part = rows[low:high]
        keys = np.array([(p, g) for p, g, _, _ in part], np.int64)
        new = np.ones(len(part), np.int64)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        compare(np.cumsum(new), np.array([r[2] for r in part], np.int64), np.stack([np.frombuffer(r[3], "<f8") for r in part]), near, threshold, forest)
        low = high


def over_ends(near: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b[c].to_pylist() for c in ("part", "nth", "pass", "grp", "cid", "vec")), strict=True))
        forest = Forest()
        together([r[2:] for r in rows], near, threshold, forest)
        yield forest.batch()

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return typed


def links(spark: SparkSession, base: DataFrame, threshold: float, passes: int, near: int, seed: int) -> DataFrame:
    """(a, b): pairs of classes that connect what the passes link."""
    rows = ordered(base, passes, seed).repartitionByRange(parts(spark), "pass", "grp", "key", "cid").sortWithinPartitions("pass", "grp", "key", "cid")
    found = table(spark, rows.mapInArrow(neighbours(near, threshold), EDGE), "neighbours")
    edges = found.where("part IS NOT NULL")
    counts = dict(map(tuple, edges.groupBy("part").agg(F.max("rows")).collect()))  # a number a range
    sides = spark.createDataFrame(borders(counts, near), "side long, part long, is_tail boolean")
    ends = edges.join(F.broadcast(sides), ["part", "is_tail"]).select("side", "part", "nth", "pass", "grp", "cid", "vec")
    return found.where("part IS NULL").select("a", "b").union(ends.groupBy("side").applyInArrow(over_ends(near, threshold), "a long, b long"))


def means(members: DataFrame) -> DataFrame:
    """(comp, mean): the sum of the unit vectors of each component, by partial sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, np.ndarray] = {}
            for c, v in zip(batch["comp"].to_pylist(), matrix(batch["vec"]), strict=True):
                sums[c] = sums.get(c, 0) + unit(v)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["comp", "mean"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, mean = None, 0
        for batch in batches:
            comp = batch["comp"][0].as_py()
            mean = mean + sum(matrix(batch["mean"]))
        yield pa.RecordBatch.from_arrays([pa.array([comp], pa.int64()), pa.array([mean.tobytes()], pa.binary())], ["comp", "mean"])

    return members.mapInArrow(partial, "comp long, mean binary").groupBy("comp").applyInArrow(total, "comp long, mean binary")


def with_angles(members: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, m in zip(matrix(batch["vec"]), matrix(batch["mean"]), strict=True):
                out.append(math.acos(max(-1.0, min(1.0, float(unit(v) @ unit(m))))) if np.abs(m).max() > 0 else math.pi)
            yield pa.RecordBatch.from_arrays([batch["comp"], batch["cid"], batch["weight"], batch["vec"], pa.array(out, pa.float64())], ["comp", "cid", "weight", "vec", "angle"])

    return members.mapInArrow(run, "comp long, cid long, weight long, vec binary, angle double")


def counted(threshold: float):
    """For a pair of blocks of a component: weights linked to each of its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        x, cid, w, side = np.stack(matrix(t["vec"])), np.asarray(t["cid"]), np.asarray(t["weight"]), np.asarray(t["side"])
        order = np.argsort(side, kind="stable")
        x, cid, w, side = x[order], cid[order], w[order], side[order]
        m = int(np.searchsorted(side, side[0], "right"))
        if m == len(side):
            sums = np.concatenate([linked(x[i : i + 256], x, threshold) @ w for i in range(0, len(x), 256)])
        else:
            rows = [linked(x[i : min(m, i + 256)], x[m:], threshold) for i in range(0, m, 256)]
            sums = np.concatenate([np.concatenate([r @ w[m:] for r in rows]), sum(w[i * 256 : i * 256 + len(r)] @ r for i, r in enumerate(rows))])
        yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(sums.astype(np.int64))], ["cid", "n"])

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return typed


def completed(spark: SparkSession, base: DataFrame, comps: DataFrame, threshold: float, block: int) -> DataFrame:
    """(cid, n): the weight of all members of its component that a class links with, its own weight included."""
    members = base.join(comps.select(F.col("node").alias("cid"), F.col("component").alias("comp")), "cid").select("comp", "cid", "weight", "vec")
    members = table(spark, members, "members")
    placed = table(spark, with_angles(members.join(means(members), "comp")), "angles")
    half = (math.acos(threshold) - SLACK) / 2
    stats = placed.groupBy("comp").agg(F.max("angle").alias("widest"), F.sum("weight").alias("n"), F.count("*").alias("m"))
    tight = placed.join(stats.where(F.col("widest") <= half), "comp").select("cid", "n")
    loose = placed.join(stats.where(F.col("widest") > half).select("comp", F.ceil(F.col("m") / block).cast("long").alias("blocks")), "comp")
    loose = loose.withColumn("side", F.pmod(F.xxhash64("cid"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # two members of one block meet where the block meets itself, which is where side and other are equal
    loose = loose.select("comp", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "cid", "weight", "vec", "side")
    sums = loose.groupBy("comp", "x", "y").applyInArrow(counted(threshold), "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))
    return tight.union(sums)


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, near: int = NEAR, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    ship(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    grp = F.xxhash64("label", F.size("embedding"))
    rows = vectors.select("vec_id", "embedding", F.when(usable(), grp).alias("grp"), F.when(usable(), F.xxhash64("label", "embedding")).alias("cid"))
    base = table(spark, classes(rows), "vectors")
    comps = table(spark, components(spark, links(spark, base, threshold, passes, near, seed)), "components")
    counts = completed(spark, base, comps, threshold, block)
    placed = base.select("cid", "weight").join(comps.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    placed = placed.select("cid", F.coalesce("component", "cid").alias("comp"), (F.coalesce("n", "weight") - 1).alias("n_links"))
    ids = rows.select("vec_id", "cid")
    named = ids.join(placed, "cid")
    least = named.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    out = named.join(least, "comp").select("vec_id", "n_links", "component_id")
    out = out.union(ids.where("cid IS NULL").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

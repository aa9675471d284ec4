"""N-gram Jaccard join: near-duplicate documents by their word shingles.

1. One scan gives each document the size and a signature of its set of shingles, and counts shingles in a sketch of fixed
   size. Documents with equal sets are one class from here on.
2. Shingles are ordered rare-first by the sketch (ties by hash; any one order is right, a better one is faster). Of a set
   of n, the first n - ceil(t n) + 1 are its prefix: sets with similarity t or more share a prefix shingle. Prefix entries
   (hash, class, n, position) are shuffled and sorted by hash, and lists of two classes or more remain.
3. Each list's members meet the list's pivot under the length and positional filters: the member with the smallest position,
   that has the fewest rarer shingles of its own and so is the most like the others. The pairs pass the suffix filter (parities of
   set sizes in fixed ranges of the hash bound the difference) and are verified once each on their whole sets.
4. Lists that still hold several components emit all other pairs across components that pass the filters, in bounded blocks.
   So large groups of near copies cost a few pairs for each member, and no pair that could link two components is left out.
5. Components come from distributed star contraction.

A shingle whose sketch count passes HOT is salted over several lists in step 2; step 4 brings its parts together.

Shingles are 64-bit hashes; sets are compared by them. Defined results: null texts and texts without words have
n_shingles 0 and are alone. Texts of fewer than `k` words have one shingle. Rows that share a doc_id are judged each by its own
text. A null doc_id takes part, but is never a component's smallest id unless all its members are null. Other columns of
documents, whatever their names, pass keep_one unchanged and are not read by the join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import kernel
from quillon.llm.kernel import LOWER, SPACES
from quillon.llm.shared import bits_for, bitmaps, components, dealt, held, member, opened, pack, positions, ship, table, unpack, whole_groups

K, PERCENT = 5, 80
SKETCH_BITS, SKETCH_SLICES = 20, 16
#: Sketch count above which a shingle's list is salted, members compared at once in one task, and entries given out at once.
HOT, SIDE, FLUSH = 1 << 20, 4096, 100_000
#: Ranges of the hash whose set sizes, odd or even, bound a difference: one bit a range in `s0` to `s3`.
RANGES = 256
SIGNS = [f"s{i}" for i in range(RANGES // 64)]

U = np.uint64


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for low, high, data, offsets in kernel.chunks(texts):
        words = kernel.split_words(data, offsets, SPACES, LOWER)
        hashes = words.hashes()
        grams, at = kernel.grams(hashes, words.first, k)
        short = kernel.whole(hashes, words.first)
        edges = np.searchsorted(at, words.first)
        counts = words.counts
        for d in range(high - low):
            if counts[d] >= k:
                yield low + d, np.unique(grams[edges[d] : edges[d + 1]])
            else:
                yield low + d, short[d : d + 1] if counts[d] else short[:0]


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit signature of a set."""
    with np.errstate(over="ignore"):
        total = kernel.mix(shingles).sum(dtype=U) ^ (kernel.mix(shingles ^ U(0x5851F42D4C957F2D)).sum(dtype=U) * U(0x9E3779B97F4A7C15))
        return int(kernel.mix(np.array([total + U(len(shingles))], U)).view(np.int64)[0])


def signs(shingles: np.ndarray) -> np.ndarray:
    """One bit a range of the mixed hash: whether an odd number of shingles lies in it."""
    odd = np.bincount((kernel.mix(shingles) >> U(56)).astype(np.int64), minlength=RANGES) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def need(n: np.ndarray | int, percent: int):
    """Least size of a set similar to one of size n, which is also the least overlap with it."""
    return (percent * n + 99) // 100


PROFILE = f"doc_id long, n long, cid long, {', '.join(f'{x} long' for x in SIGNS)}, slice long, block binary"


def profile(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, n, cid, signs) of documents, and rows (slice, block) of each task's shingle counts."""
    names = [x.split()[0] for x in PROFILE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            rows = batch.num_rows
            n, cid, bits = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros((len(SIGNS), rows), np.int64)
            held: list[np.ndarray] = []
            size = 0

            def add() -> None:
                np.add(counts, np.bincount((np.concatenate(held) >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32), out=counts)  # noqa: B023

            for row, s in shingle_sets(batch["text"], k):
                n[row], cid[row], bits[:, row] = len(s), class_of(s), signs(s)
                held.append(s)
                size += len(s)
                if size > 1 << 18:
                    add()
                    held, size = [], 0
            if held:
                add()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(cid), *map(pa.array, bits), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary())], names)
        kind = np.uint8 if counts.max() < 256 else np.uint32
        blocks = [pack(x.astype(kind)) for x in np.split(counts, SKETCH_SLICES)]
        none = [pa.nulls(SKETCH_SLICES, pa.int64())] * (3 + len(SIGNS))
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SKETCH_SLICES), pa.int64()), pa.array(blocks, pa.binary())], names)

    return docs.mapInArrow(run, PROFILE)


def sketch(spark: SparkSession, blocks: DataFrame):
    """Broadcasts the summed counts: 2**SKETCH_BITS numbers, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, s = None, None
        for batch in batches:
            for s, block in zip(batch["slice"].to_pylist(), batch["block"].to_pylist(), strict=True):
                x = unpack(block)[0].astype(np.int64)
                total = x if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([pack(total)], pa.binary())], ["slice", "block"])

    summed = blocks.groupBy("slice").applyInArrow(add, "slice long, block binary").collect()
    counts = [unpack(r.block)[0] for r in sorted(summed)] or [np.zeros(1 << SKETCH_BITS, np.int64)]
    return spark.sparkContext.broadcast(zlib.compress(np.concatenate(counts).astype("<i8").tobytes(), 1))


def counts_in(told) -> np.ndarray:
    return held("sketch", zlib.crc32(told.value), lambda: np.frombuffer(zlib.decompress(told.value), "<i8"), 1)


ENTRY = "h long, cid long, n int, pos int, salt int"


def prefixes(docs: DataFrame, told, k: int, percent: int, hot: int) -> DataFrame:
    """Prefix entries (h, cid, n, pos, salt); salt is 0 for all but hot shingles."""
    names = [x.split()[0] for x in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_in(told)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)

        for batch in batches:
            for _, s in shingle_sets(batch["text"], k):
                if not len(s) or (cid := class_of(s)) in seen:
                    continue
                seen.add(cid)
                if len(seen) > 1 << 18:
                    seen.clear()
                n = len(s)
                p = n - need(n, percent) + 1
                count = counts[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.lexsort((s, count))[:p]
                own = count[first]
                salt = np.where(own >= hot, 1 + int(cid) % (own // hot + 1), 0).astype(np.int32)
                held.append((s[first].view(np.int64), np.full(p, cid, np.int64), np.full(p, n, np.int32), np.arange(p, dtype=np.int32), salt))
                size += p
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, ENTRY)


LIST = "h long, cid long, n int, pos int, size int, salt int, p_cid long, p_n int, p_pos int"


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For entries sorted by (h, salt): the members of every list of two classes or more, each beside its list's pivot.

    One list, which salting bounds, and one batch are held at a time.
    """
    names = [x.split()[0] for x in LIST.split(", ")]

    for group in whole_groups(batches, ["h", "salt"]):
        h, cid, n, pos, salt = (group[c] for c in ("h", "cid", "n", "pos", "salt"))
        order = np.lexsort((cid, kernel.mix(cid.view(U)), pos, salt, h))
        h, cid, n, pos, salt = h[order], cid[order], n[order], pos[order], salt[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (cid[1:] != cid[:-1]) | (salt[1:] != salt[:-1])
        h, cid, n, pos, salt = h[new], cid[new], n[new], pos[new], salt[new]
        start = np.ones(len(h), bool)
        start[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])
        edges = np.append(np.flatnonzero(start), len(h))
        sizes = np.diff(edges).astype(np.int32)
        at = np.repeat(np.arange(len(sizes)), sizes)
        keep = (sizes[at] > 1) | (salt > 0)
        pivot = edges[:-1][at]
        out = (h, cid, n, pos, sizes[at], salt, cid[pivot], n[pivot], pos[pivot])
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in out], names)


def long_enough(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def enough(overlap: Column, na: Column, nb: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (na + nb)


def fits(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Length and positional filters, for a shared entry that is the pair's first."""
    return long_enough(na, nb, percent) & enough(F.least(na - pa_, nb - pb), na, nb, percent)


def marks(bits: int):
    """For mapInArrow on a column of ids: the positions of their hashes, for bitmaps()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(positions(bits, [kernel.mix(np.asarray(batch.column(0)).view(U))]))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["slice", "block"])

    return run


def sets_of(spark: SparkSession, docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(cid, shingles) of the documents in `ids`, and of few others, one row a class.

    A bitmap picks the documents, so that texts aren't shuffled; a full one picks more than are needed.
    """
    bits = bits_for(ids.count())
    needed = bitmaps(spark, ids.mapInArrow(marks(bits), "slice long, block binary"), bits, "once")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = opened(needed), set()
        for batch in batches:
            ids = np.array([i or 0 for i in batch["doc_id"].to_pylist()], np.int64)
            wanted = np.flatnonzero(member(bitmap, kernel.mix(ids.view(U)), bits))
            for low in range(0, len(wanted), 50):
                found = {}
                for _, s in shingle_sets(batch["text"].take(pa.array(wanted[low : low + 50])), k):
                    if len(s) and (cid := class_of(s)) not in seen:
                        found[cid] = s
                seen.update(found)
                if len(seen) > 1 << 18:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.view(np.int64) for s in found.values()], pa.list_(pa.int64()))], ["cid", "shingles"])

    return docs.mapInArrow(run, "cid long, shingles array<long>").dropDuplicates(["cid"])


def verified(spark: SparkSession, docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar: suffix filter on the signs, then whole sets.

    Only sets of classes in a pair that passes the filter are made, once, as a table. Each pair takes the set of `a` to that of `b`.
    All joins are of plain tables, so that adaptive execution can split a class of very many pairs.
    """
    near = pairs
    for side in "ab":
        near = near.join(classes.select(F.col("cid").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("doc", "n", *SIGNS))), side)
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SIGNS), F.lit(0))
    near = near.where(enough((F.col("n_a") + F.col("n_b") - apart) / 2, F.col("n_a"), F.col("n_b"), percent))
    near = table(spark, near.select("a", "b", "n_a", "n_b", "doc_a", "doc_b"), "near")
    ids = table(spark, near.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct(), "needed")
    sets = table(spark, sets_of(spark, docs, ids, k), "sets")
    both = near.select("a", "b", "n_a", "n_b")
    for side in "ab":
        both = both.join(sets.select(F.col("cid").alias(side), F.col("shingles").alias(f"shingles_{side}")), side)
    overlap = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return both.where(enough(overlap, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def across(percent: int):
    """For members sorted by (h, x, y), a list or a pair of its blocks: the pairs of different components that pass the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["h", "x", "y"]):
            order = np.lexsort((group["n"], group["y"], group["x"], group["h"]))
            h, x, y, side, cid, comp = (group[c][order] for c in ("h", "x", "y", "side", "cid", "comp"))
            n, pos = (group[c][order].astype(np.int64) for c in ("n", "pos"))
            turn = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            sizes = np.diff(np.append(turn, len(h)))
            several = np.minimum.reduceat(comp, turn) != np.maximum.reduceat(comp, turn)
            end = np.repeat(turn + sizes, sizes)
            i = np.flatnonzero(np.repeat(several, sizes))
            held, size, step = [], 0, 0
            # each member meets those after it in its list, one place further each time, until they are too long for it
            while len(i):
                step += 1
                i = i[i + step < end[i]]
                i = i[100 * n[i] >= percent * n[i + step]]
                j = i + step
                ok = (comp[i] != comp[j]) & ((100 + percent) * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= percent * (n[i] + n[j])) & ((x[i] == y[i]) | (side[i] != side[j]))
                held.append((np.minimum(cid[i[ok]], cid[j[ok]]), np.maximum(cid[i[ok]], cid[j[ok]])))
                size += int(ok.sum())
                if size > FLUSH or not len(i) and size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["a", "b"])
                    held, size = [], 0

    return run


def remaining(members: DataFrame, comps: DataFrame, percent: int, side: int, partitions: int) -> DataFrame:
    """All pairs (a, b) of different components within lists that pass the filters, in blocks of `side` members.

    Lists within one block are compared as they are. For longer ones, those of one component are dropped first, and each member
    is dealt to the pairs of blocks that hold its own.
    """
    zero = F.lit(0).cast("long")
    placed = members.join(comps.withColumnsRenamed({"node": "cid"}), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    long_ = F.col("size") > side
    short = placed.where(~long_ & (F.col("salt") == 0)).select("h", "cid", "n", "pos", "comp", zero.alias("side"), zero.alias("x"), zero.alias("y"))
    wide = placed.where(long_ | (F.col("salt") > 0))
    open_ = wide.groupBy("h").agg(F.ceil(F.count("*") / side).cast("long").alias("blocks"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    wide = wide.join(open_.select("h", "blocks"), "h").withColumn("side", F.pmod(F.xxhash64("cid"), "blocks"))
    wide = wide.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    wide = wide.select("h", "cid", "n", "pos", "comp", "side", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"))
    blocks = short.union(wide).repartition(partitions, "h", "x", "y").sortWithinPartitions("h", "x", "y")
    return blocks.mapInArrow(across(percent), "a long, b long").distinct()


def jaccard_links(spark: SparkSession, docs: DataFrame, k: int = K, percent: int = PERCENT, hot: int = HOT, side: int = SIDE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links, components).

    rows: doc_id, n, cid of all documents. classes: cid, its smallest doc_id as `low` and with 0 for null as `doc`, n, signs.
    links: verified pairs (a, b) of classes, that connect every pair with similarity of percent / 100 or more, directly or through
    others. components: (node, component) of linked classes.
    """
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    both = table(spark, profile(docs, k), "profile")
    rows = both.where("slice IS NULL")
    told = sketch(spark, both.where("slice IS NOT NULL").select("slice", "block"))
    least = [F.min("doc_id").alias("low"), F.min(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("doc")]
    classes = table(spark, rows.where("n > 0").groupBy("cid").agg(*least, *(F.max(c).alias(c) for c in ("n", *SIGNS))), "classes")
    partitions = dealt(spark, docs)
    entries = prefixes(docs.select("text"), told, k, percent, hot).repartition(partitions, "h", "salt").sortWithinPartitions("h", "salt")
    members = table(spark, entries.mapInArrow(lists, LIST), "lists")
    stars = members.where("cid <> p_cid").where(fits(F.col("n"), F.col("pos"), F.col("p_n"), F.col("p_pos"), percent))
    pairs = table(spark, stars.select(F.least("cid", "p_cid").alias("a"), F.greatest("cid", "p_cid").alias("b")).distinct(), "pairs")
    links = table(spark, verified(spark, docs, classes, pairs, k, percent), "links")
    comps = table(spark, components(spark, links), "components")
    more = remaining(members.where("size > 2 OR salt > 0"), comps, percent, side, partitions)
    more = table(spark, more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    found = table(spark, verified(spark, docs, classes, more, k, percent), "links")
    rows = rows.select("doc_id", "n", "cid")
    if found.isEmpty():
        return rows, classes, links, comps
    links = links.union(found)
    return rows, classes, links, table(spark, components(spark, links), "components")


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = K, percent: int = PERCENT, hot: int = HOT, side: int = SIDE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Ids are found for components, then classes, then documents, each by a join of plain tables, as one may hold very many of the next.
    """
    rows, classes, _, comps = jaccard_links(spark, docs, k, percent, hot, side)
    linked = classes.select(F.col("cid").alias("node"), "low").join(comps, "node")
    least = table(spark, linked.groupBy("component").agg(F.min("low").alias("least")), "least")
    named = comps.join(least, "component").select(F.col("node").alias("cid"), "least", F.lit(True).alias("is_linked"))
    ids = table(spark, classes.join(named, "cid", "left").select("cid", F.when(F.col("is_linked"), F.col("least")).otherwise(F.col("low")).alias("component_id")), "ids")
    found = rows.where("n > 0").join(ids, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))


def keep_one(spark: SparkSession, docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component: those with its smallest doc_id, alike rows once.

    A bitmap of the ids that go or repeat lets all other rows pass where they are read; only rows it suspects are shuffled.
    Rows with a null doc_id stay. Rows of one doc_id with different texts stay together if one of them stands for its component.
    """
    ids = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("own"))
    suspects = table(spark, ids.where("n > 1 OR NOT own"), "suspects")
    bits = bits_for(suspects.count())
    told = bitmaps(spark, suspects.select("doc_id").mapInArrow(marks(bits), "slice long, block binary"), bits, "once")
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))

    def suspected(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = opened(told)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                hit = member(held, kernel.mix(np.array([i or 0 for i in ids], np.int64).view(U)), bits) & np.array([i is not None for i in ids], bool)
                yield batch.filter(pa.array(hit == wanted))

        return run

    plain, rest = (packed.mapInArrow(suspected(x), packed.schema) for x in (False, True))
    rest = rest.join(suspects.withColumnRenamed("doc_id", "id"), "id", "left").where("own IS NULL OR own")
    once = rest.where("n > 1").select("id", F.col("row.text").alias("text"), "row").dropDuplicates(["id", "text"])
    return plain.select("row.*").union(rest.where("coalesce(n, 1) = 1").select("row.*")).union(once.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
f AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM (SELECT g.* FROM g JOIN f ON g.s = f.s) a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.node
"""

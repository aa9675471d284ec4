"""Substring dedup by fixed-block anchors.

With blocks of b = (window + 1) // 2 words, every window of a document holds a whole block that starts at a multiple of b.

1. The non-overlapping blocks of all documents (the anchors) are indexed in a bitmap of fixed size.
2. Every rolling block of b words probes it. Probes and anchors that meet at one hash are confirmed in buckets of the
   hash, which leaves a second bitmap: blocks that are an anchor somewhere and occur at two places or more.
3. Around these hits, repeats are extended to whole windows: every window that holds a hit is hashed, and hashes that occur
   at two places mark their windows. Adjacent marked windows merge to maximal repeats.
4. Documents with marks meet them by a join; all others are finished where they are read.

Bitmaps only preselect: a full one costs time, not results. Within a task, equal hashes leave one entry, so a passage in a
third of all documents sends a few entries for each task, and none of its places is gathered.

Documents with equal word sequences are one class: all windows of a class of two rows or more occur elsewhere, and only one
copy of it takes part above. Hashes have 64 bits.

Defined results: null and empty texts have no words. Texts of fewer than `window` words lose nothing. Rows that share a
doc_id are judged each by its own text. Each input row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import kernel
from quillon.llm.kernel import SPACES
from quillon.llm.shared import bits_for, bitmaps, input_bytes, member, opened, pack, positions, ship, table, unpack

WINDOW, MOST_BITS = 35, 30
#: Entries packed at once in a task.
FLUSH = 2_000_000
U = np.uint64


def hashed(texts: pa.Array) -> Iterator[tuple[int, int, kernel.Words, np.ndarray, np.ndarray]]:
    """(first row, end row, words, word hashes, classes) of chunks of texts."""
    for low, high, data, offsets in kernel.chunks(texts):
        words = kernel.split_words(data, offsets, SPACES)
        hashes = words.hashes()
        a, b = kernel.whole(hashes, words.first), kernel.whole(kernel.mix(hashes ^ U(0xA0761D6478BD642F)), words.first)
        yield low, high, words, hashes, kernel.mix(a ^ (b * U(0xE7037ED1A0B428DB))).view(np.int64)


def fresh(cids: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which classes haven't been seen in this task."""
    out = np.zeros(len(cids), bool)
    for i, c in enumerate(cids.tolist()):
        if c not in seen:
            seen.add(c)
            out[i] = True
    if len(seen) > 1 << 20:
        seen.clear()
    return out


def placed(words: kernel.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document in chunk, position in document) of word positions."""
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts)[at]
    return owner, at - words.first[owner]


def profile(docs: DataFrame, block: int, window: int, bits: int) -> DataFrame:
    """Rows (doc_id, n, cid), and rows (slice, block) of the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen, anchors = ["doc_id", "n", "cid", "slice", "block"], set(), []
        for batch in batches:
            n, cid = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for low, high, words, hashes, classes in hashed(batch["text"]):
                n[low:high], cid[low:high] = words.counts, classes
                grams, at = kernel.grams(hashes, words.first, block)
                owner, pos = placed(words, at)
                keep = (pos % block == 0) & (fresh(classes, seen) & (words.counts >= window))[owner]
                anchors.append(grams[keep])
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(cid), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary())], names)
        out = list(positions(bits, anchors))
        none = pa.nulls(len(out), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array([s for s, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, n long, cid long, slice long, block binary")


def spread(buckets: int, key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed columns) by bucket of a key."""
    bucket = (kernel.mix(key) % U(buckets)).astype(np.int64)
    order = np.lexsort((key, bucket))
    edges = kernel.bounds(bucket[order])
    for a, b in zip(edges, edges[1:], strict=False):
        part = order[a:b]
        yield int(bucket[part[0]]), pack(*(c[part] for c in columns))


def batch_of(rows: list[tuple[int, bytes]], names: tuple[str, str] = ("bucket", "block")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], list(names))


def condense(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, edges, sizes) of the runs of equal hashes."""
    order = np.argsort(h, kind="stable")
    edges = kernel.bounds(h[order])
    return order, edges[:-1], np.diff(edges)


def probes(docs: DataFrame, index, bits: int, block: int, window: int, buckets: int) -> DataFrame:
    """(bucket, block) of hashes of anchors and of rolling blocks that the index may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = opened(index), set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, cid, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
            order, edges, sizes = condense(h)
            first, anchor = order[edges], np.logical_or.reduceat(anchor[order], edges)
            return batch_of(list(spread(buckets, h[first], h[first], cid[first], sizes > 1, anchor)))

        for batch in batches:
            for _, _, words, hashes, classes in hashed(batch["text"]):
                grams, at = kernel.grams(hashes, words.first, block)
                owner, pos = placed(words, at)
                anchor = pos % block == 0
                keep = (fresh(classes, seen) & (words.counts >= window))[owner] & (anchor | member(known, grams, bits))
                held.append((grams[keep], classes[owner[keep]], anchor[keep]))
                size += int(keep.sum())
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.mapInArrow(run, "bucket long, block binary")


def second(h: np.ndarray) -> np.ndarray:
    """The second bitmap's hash of a block, independent of the first's."""
    return kernel.mix(h ^ U(0x2545F4914F6CDD1D))


def confirm(bits: int):
    """For a bucket: marks of the blocks that are an anchor somewhere and occur at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [unpack(b) for batch in batches for b in batch["block"].to_pylist()]
        h, cid, twice, anchor = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order = np.argsort(h, kind="stable")
        h, cid, twice, anchor = h[order], cid[order], twice[order], anchor[order]
        edges = kernel.bounds(h)[:-1]
        ok = np.logical_or.reduceat(anchor, edges) & (np.logical_or.reduceat(twice, edges) | (np.minimum.reduceat(cid, edges) != np.maximum.reduceat(cid, edges)))
        yield batch_of(list(positions(bits, [second(h[edges[ok]])])), ("slice", "block"))

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return typed


SPANS = ["cid", "start", "stop"]


def spans_of(cid: np.ndarray, pos: np.ndarray, window: int) -> list[np.ndarray]:
    """(cid, start, stop) of the runs of words that windows at these places cover."""
    order = np.lexsort((pos, cid))
    cid, pos = cid[order], pos[order].astype(np.int64)
    new = np.ones(len(cid), bool)
    new[1:] = (cid[1:] != cid[:-1]) | (pos[1:] > pos[:-1] + window)
    first = np.flatnonzero(new)
    return [cid[first], pos[first], pos[np.append(first[1:], len(cid)) - 1] + window] if len(cid) else [cid, pos, pos]


def least(grams: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    out = grams[: max(0, len(grams) - n + 1)].copy()
    for i in range(1, n):
        np.minimum(out, grams[i : i + len(out)], out=out)
    return out


def extend(docs: DataFrame, index, hits, bits: int, block: int, window: int, buckets: int) -> DataFrame:
    """Windows around hits: (bucket, block) of those to be confirmed, and (cid, start, stop) of those repeated in the task.

    A window's bucket follows from the least hash of its blocks, which neighbours share: a bucket gets whole runs.
    """
    names = ["bucket", "block", *SPANS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marked, seen = opened(index), opened(hits), set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, key, cid, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order, edges, sizes = condense(h)
            first, many = order[edges], order[np.repeat(sizes > 1, sizes)]
            rows = list(spread(buckets, key[first], h[first], cid[first], pos[first], sizes > 1))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary()), none, none, none], names)
            spans = spans_of(cid[many], pos[many], window)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(spans[0]), pa.int64()), pa.nulls(len(spans[0]), pa.binary()), *(pa.array(x, pa.int64()) for x in spans)], names)

        for batch in batches:
            for _, _, words, hashes, classes in hashed(batch["text"]):
                grams, at = kernel.grams(hashes, words.first, block)
                owner, pos = placed(words, at)
                hit = (fresh(classes, seen) & (words.counts >= window))[owner] & member(marked, second(grams), bits)
                hit[hit] = (pos[hit] % block == 0) | member(known, grams[hit], bits)
                near = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(near, np.maximum(at[hit] - (window - block), 0), 1)
                np.add.at(near, at[hit] + 1, -1)
                longer, start = kernel.grams(hashes, words.first, window)
                keep = np.cumsum(near)[start] > 0
                start = start[keep]
                owner, pos = placed(words, start)
                key = least(grams, window - block + 1)[np.searchsorted(at, start)] if len(start) else grams[:0]
                held.append((longer[keep], key, classes[owner], pos.astype(np.uint32)))
                size += len(start)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.mapInArrow(run, "bucket long, block binary, cid long, start long, stop long")


def repeated(window: int):
    """For a bucket of windows: (cid, start, stop) of the places whose hash occurs elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [unpack(b) for batch in batches for b in batch["block"].to_pylist()]
        h, cid, pos, twice = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order = np.lexsort((pos, cid, h))
        h, cid, pos, twice = h[order], cid[order], pos[order], twice[order]
        edges = kernel.bounds(h)
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        first, last = edges[:-1], edges[1:] - 1
        ok = np.logical_or.reduceat(twice, first) | (cid[first] != cid[last]) | (pos[first] != pos[last])
        keep = ok[group]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spans_of(cid[keep], pos[keep], window)], SPANS)

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return typed


OUT = "doc_id long, n_words long, n_removed long, kept string"


def finished(docs: DataFrame, drops: DataFrame, touched, bits: int) -> DataFrame:
    names = [x.split()[0] for x in OUT.split(", ")]

    def split(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bitmap = opened(touched)
            for batch in batches:
                for low, high, words, _, classes in hashed(batch["text"]):
                    inside = np.flatnonzero(member(bitmap, kernel.mix(classes.view(U)), bits) == wanted)
                    part = batch.slice(low, high - low).take(pa.array(inside))
                    if wanted:
                        yield pa.RecordBatch.from_arrays([part["doc_id"], part["text"], pa.array(classes[inside])], ["doc_id", "text", "cid"])
                    else:
                        kept = [b" ".join((t or "").encode().split()).decode() for t in part["text"].to_pylist()]
                        yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(words.counts[inside]), pa.array(np.zeros(len(inside), np.int64)), pa.array(kept, pa.string())], names)

        return run

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                n, removed, kept = [], [], []
                for text, spans, every in zip(*(part[c].to_pylist() for c in ("text", "spans", "every")), strict=True):
                    words = (text or "").encode().split()
                    n.append(len(words))
                    if every:
                        left = []
                    else:
                        left, at = [], 0
                        for a, b in sorted((x["start"], x["stop"]) for x in spans or ()):
                            left += words[at:a]
                            at = max(at, b)
                        left += words[at:]
                    removed.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names)

    plain = docs.mapInArrow(split(False), OUT)
    rest = docs.mapInArrow(split(True), "doc_id long, text string, cid long").join(drops.hint("merge"), "cid", "left")
    return plain.union(rest.select("doc_id", "text", "spans", "every").mapInArrow(apply, OUT))


def dedup_substrings(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by single blanks) of every row of docs."""
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    block = (window + 1) // 2
    size = input_bytes(docs)
    bits = int(np.clip(np.ceil(np.log2(max(1, size) / 2)), 20, MOST_BITS))
    buckets = int(np.clip(size >> 22, 16, 1 << 16))
    both = table(spark, profile(docs, block, window, bits), "profile")
    index = bitmaps(spark, both.where("slice IS NOT NULL"), bits, "once")
    texts = docs.select("text")
    marks = probes(texts, index, bits, block, window, buckets).groupBy("bucket").applyInArrow(confirm(bits), "slice long, block binary")
    hits = bitmaps(spark, marks, bits, "once")
    windows = table(spark, extend(texts, index, hits, bits, block, window, buckets), "windows")
    found = windows.where("block IS NOT NULL").select("bucket", "block").groupBy("bucket").applyInArrow(repeated(window), "cid long, start long, stop long")
    spans = windows.where("block IS NULL").select(*SPANS).union(found).distinct().groupBy("cid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    copies = both.where("slice IS NULL").where(F.col("n") >= window).groupBy("cid").agg(F.count("*").alias("rows")).where("rows > 1").select("cid", F.lit(True).alias("every"))
    drops = table(spark, spans.join(copies, "cid", "full").select("cid", "spans", F.coalesce("every", F.lit(False)).alias("every")), "drops")

    few = bits_for(drops.count())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(list(positions(few, [kernel.mix(np.asarray(batch["cid"]).view(U))])), ("slice", "block"))

    touched = bitmaps(spark, drops.select("cid").mapInArrow(mark, "slice long, block binary"), few, "once")
    return finished(docs, drops, touched, few)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, sha1(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM g JOIN r ON g.h = r.h),
x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
k AS (SELECT x.doc_id, count(*) FILTER (c.p IS NOT NULL) AS n_removed, string_agg(x.word, ' ' ORDER BY x.p) FILTER (c.p IS NULL) AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

"""Benchmark decontamination by winnowing.

Of every run of W consecutive k-gram hashes the smallest is kept as a fingerprint. With k + W - 1 = window words, any
shared run of `window` words holds one whole run of hashes, so both texts keep the same fingerprint in it: no shared
window is missed.

1. The benchmark's windows and fingerprints are made as tables, whatever their size; a bitmap of the fingerprints is broadcast.
2. One scan of the documents keeps the fingerprints that the bitmap knows, extends each to the windows around it, and gives
   those windows as (text digest, first word, length, hashes). Texts are not shuffled.
3. The windows are joined with the benchmark's; what meets gives spans and items of each distinct text. Windows of the same
   items share one set of items, so a passage of many items meets a text once a set, not once a window and item.
4. A second scan counts words and passes all documents whose digest a bitmap of hit texts does not know; only the others
   are shuffled to meet their spans.

Items of fewer than `window` words are one window of their own length; a run that short has no inner structure to winnow, so every
gram of that length is a fingerprint. Windows are compared by two 64-bit hashes, texts by a 128-bit digest. A bitmap that is too
small for a very large benchmark (see bits_for) lets more windows into the join, and loses none.

Defined results: null or empty texts have no words, no hits and are clean. Items without words match nothing. Repeated
items count once by item_id; an item with a null item_id marks words but is not listed. Each input row gives one row,
repeated rows included. Columns of documents stay in the struct `row`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from quillon.llm import kernel
from quillon.llm.kernel import LOWER, PUNCTUATION
from quillon.llm.shared import bits_for, bitmaps, member, opened, positions, ship, table

WINDOW, GRAM = 13, 6
U = np.uint64
SPANS, ITEMS = "array<struct<start: long, stop: long>>", "array<string>"


def winnow(grams: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Which grams are the smallest of some run of `width` grams at adjacent positions."""
    keep = np.zeros(len(grams), bool)
    n = len(grams) - width + 1
    if n <= 0:
        return keep
    low = grams[:n].copy()
    for i in range(1, width):
        np.minimum(low, grams[i : i + n], out=low)
    run = at[width - 1 :] - at[:n] == width - 1
    for i in range(width):
        keep[i : i + n] |= run & (grams[i : i + n] == low)
    return keep


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all runs of k words, and two hashes of each."""
    x, at = kernel.grams(hashes, first, k)
    y, _ = kernel.grams(kernel.mix(hashes ^ U(0x2545F4914F6CDD1D)), first, k)
    return at, x, y


def marked(k: int, hashes: np.ndarray) -> np.ndarray:
    """Hashes of fingerprints of windows of k words, as the bitmap has them."""
    return kernel.mix(hashes + U(k))


ITEM = "item string, k int, x long, y long, mark long"


def item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(item, k, x, y) of each item's windows, and (mark) of each of its fingerprints."""
    names = [c.split()[0] for c in ITEM.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernel.chunks(batch["text"]):
                words = kernel.split_words(data, offsets, PUNCTUATION, LOWER)
                hashes, owner = words.hashes(), np.repeat(np.arange(low, high), words.counts)
                for k in np.unique(np.minimum(words.counts, window)).tolist():
                    if not k:
                        continue
                    at, x, y = windows(hashes, words.first, k)
                    mine = np.minimum(words.counts[owner[at] - low], window) == k
                    at, x, y = at[mine], x[mine], y[mine]
                    if k < window:
                        marks = marked(k, x)
                    else:
                        small, place = kernel.grams(hashes, words.first, gram)
                        marks = marked(k, np.unique(small[winnow(small, place, k - gram + 1)]))
                    n, m = len(at), len(marks)
                    columns = [batch["item"].take(pa.array(owner[at])), pa.array(np.full(n, k, np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.nulls(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(marks.view(np.int64))], names)

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, ITEM)


def hashed(values: pa.Array) -> np.ndarray:
    """Hashes as they are, or the first 8 bytes of digests."""
    return np.asarray(values).view(U) if pa.types.is_integer(values.type) else np.frombuffer(b"".join(x[:8] for x in values.to_pylist()), U)


def told(spark: SparkSession, marks: DataFrame) -> tuple[Broadcast, int]:
    """A bitmap of a column of distinct hashes or digests, and its bits."""
    bits = bits_for(marks.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(positions(bits, [hashed(batch.column(0))]))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["slice", "block"])

    return bitmaps(spark, marks.mapInArrow(run, "slice long, block binary"), bits, "once"), bits


def digest(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode(), digest_size=16).digest()


def near(bits_of: tuple[Broadcast, int], lengths: list[int], window: int, gram: int):
    """A task's candidate windows: (digest, at, k, x, y), once for each distinct text of a batch."""
    filter_, bits = bits_of

    def candidates(hashes: np.ndarray, first: np.ndarray, k: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k == window:
            small, place = kernel.grams(hashes, first, gram)
            found = place[winnow(small, place, k - gram + 1)]
            found = found[member(bitmap, marked(k, small[np.searchsorted(place, found)]), bits)]
            if not len(found):
                return (np.zeros(0, np.int64),) * 3
            edge = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(edge, np.maximum(found - (k - gram), 0), 1)
            np.add.at(edge, found + 1, -1)
            at, x, y = windows(hashes, first, k)
            ok = np.cumsum(edge)[at] > 0
        else:
            at, x, y = windows(hashes, first, k)
            ok = member(bitmap, marked(k, x), bits)
        return at[ok], x[ok], y[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = opened(filter_)
        for batch in batches:
            texts = batch["text"]
            for low, _, data, offsets in kernel.chunks(texts):
                words = kernel.split_words(data, offsets, PUNCTUATION, LOWER)
                hashes = words.hashes()
                for k in lengths:
                    at, x, y = candidates(hashes, words.first, k, bitmap)
                    if not len(at):
                        continue
                    owner = np.searchsorted(words.first, at, "right") - 1
                    names = {d: digest(texts[low + d].as_py()) for d in np.unique(owner).tolist()}
                    first = dict(reversed([(t, d) for d, t in names.items()]))
                    mine = np.isin(owner, list(first.values()))
                    at, x, y, owner = at[mine], x[mine], y[mine], owner[mine]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[d] for d in owner.tolist()], pa.binary()), pa.array(at - words.first[owner]), pa.array(np.full(len(at), k, np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))],
                        ["text", "at", "k", "x", "y"],
                    )

    return run


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(digest, spans, items) of the distinct texts that hold a benchmark window."""
    made = table(spark, item_windows(benchmark, window, gram), "windows")
    lengths = [r.k for r in made.select("k").where("k IS NOT NULL").distinct().collect()]  # `window` at most
    own = made.where("k IS NOT NULL").select("item", "k", "x", "y").distinct()
    signed = own.groupBy("k", "x", "y").agg(*(F.bit_xor(F.xxhash64(F.lit(seed), "item")).alias(f"set_{seed}") for seed in (1, 2)))
    signed = table(spark, signed, "sets")
    chosen = signed.groupBy("set_1", "set_2").agg(F.min(F.struct("k", "x", "y")).alias("w")).select("set_1", "set_2", "w.*")
    members = table(spark, chosen.join(own.where("item IS NOT NULL"), ["k", "x", "y"]).select("set_1", "set_2", "item"), "members")
    marks = told(spark, table(spark, made.where("mark IS NOT NULL").select("mark").distinct(), "marks"))
    found = docs.select("text").mapInArrow(near(marks, lengths, window, gram), "text binary, at long, k int, x long, y long").distinct()
    found = table(spark, found.join(signed, ["k", "x", "y"]).select("text", "at", (F.col("at") + F.col("k")).alias("stop"), "set_1", "set_2"), "hits")
    items = found.select("text", "set_1", "set_2").distinct().join(members, ["set_1", "set_2"]).groupBy("text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # hits that overlap or touch are one span: a new one starts where none before reaches
    order = Window.partitionBy("text").orderBy("at", "stop")  # rows of one text
    runs = found.select("text", "at", "stop").distinct().withColumn("reach", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum(F.when(F.col("at") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("text", "run").agg(F.min("at").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return spans.join(items, "text", "left").select(F.col("text").alias("digest"), "spans", F.coalesce("items", F.expr(f"CAST(array() AS {ITEMS})")).alias("items"))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows of docs as struct `row`, with n_words, merged hit word spans, and the item_ids (as text) that occur.

    n_hit is the words in spans; contaminated is n_hit > 0 and 20 * n_hit >= n_words.
    """
    ship(spark)
    known = table(spark, hits(spark, docs, benchmark, window, gram), "found")
    filter_, bits = told(spark, known.select("digest"))
    packed = docs.select(F.struct("*").alias("row"))
    schema = StructType([*packed.schema, *StructType().add("n_words", LongType()).add("digest", BinaryType())])

    def suspected(wanted: bool):
        """Rows whose text is, or is not, one of those that the bitmap knows; only these are split into words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bitmap = opened(filter_)
            for batch in batches:
                names = pa.array([digest(t.as_py()) for t in batch.column(0).field("text")], pa.binary())
                chosen = pa.array(member(bitmap, hashed(names), bits) == wanted)
                rows = batch.column(0).filter(chosen)
                counts = [kernel.split_words(data, offsets, PUNCTUATION, LOWER).counts for _, _, data, offsets in kernel.chunks(rows.field("text"))]
                yield pa.RecordBatch.from_arrays([rows, pa.array(np.concatenate([np.zeros(0, np.int64), *counts])), names.filter(chosen)], schema.names)

        return run

    none = [F.expr(f"CAST(array() AS {SPANS})"), F.expr(f"CAST(array() AS {ITEMS})")]
    clean = packed.mapInArrow(suspected(False), schema).select("row", "n_words", none[0].alias("spans"), none[1].alias("items"))
    rest = packed.mapInArrow(suspected(True), schema).join(known, "digest", "left")
    out = clean.union(rest.select("row", "n_words", F.coalesce("spans", none[0]), F.coalesce("items", none[1])))
    out = out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    joined = F.array_join("items", ",")
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH RECURSIVE
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k)),
occ AS (SELECT doc_id, i, dg.k AS k, item_id FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits ON dw.doc_id = hits.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""

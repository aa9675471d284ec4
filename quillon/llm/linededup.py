"""Line dedup with two Bloom filters.

One scan sends the cut hashes of every eligible line, once for each document that holds it, as sorted gaps of a byte
or so. They make two bitmaps (one hash function each, 2**bits bits, a fixed size): lines seen once, and lines seen at
least twice. Only lines that the second bitmap suspects are shuffled, as 128-bit digests, to be counted exactly and to
find the document that keeps them. A full bitmap only suspects more lines; results stay exact.

The lines to drop are broadcast where they are few (DROP_KEYS) and joined to the documents otherwise.

Defined results: a null or empty text is one empty line. A key's documents are counted by distinct non-null doc_id, and
all rows with the largest doc_id keep the line, so repeated rows neither count twice nor lose lines. Rows without a
doc_id never keep a line that others hold often enough. Each input row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import kernel
from quillon.llm.shared import append, bitmaps, input_bytes, member, opened, positions, ship, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Most keys that are broadcast; each takes about 100 bytes.
DROP_KEYS = 400_000
MOST_BITS = 29

_LOWER = bytes(kernel.LOWER)
_BLANKS = b" \t\n\x0b\x0c\r"


def key(line: bytes) -> bytes:
    return line.strip(_BLANKS).translate(_LOWER)


def eligible(k: bytes, least: int) -> bool:
    """At least that many code points: bytes without UTF-8's continuation bytes."""
    return len(k) >= least and (len(k.decode("utf-8", "surrogatepass")) >= least)


def digest(k: bytes) -> bytes:
    return hashlib.blake2b(k, digest_size=16).digest()


def keys_of(text: str | None, least: int) -> set[bytes]:
    return {digest(k) for x in (text or "").encode().split(b"\n") if len(x) >= least and eligible(k := key(x), least)}


def hashed(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8")[::2].astype(np.uint64)


def filter_bits(docs: DataFrame) -> int:
    """About 16 bits for each 64 bytes of compressed input, within 2**20 to 2**MOST_BITS bits."""
    return int(np.clip(np.ceil(np.log2(max(1, input_bytes(docs)) / 4)), 20, MOST_BITS))


def droppable(spark: SparkSession, docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(digest, keeper): lines in at least min_docs documents, and the largest doc_id holding each."""
    bits = filter_bits(docs)
    narrow = docs.select("doc_id", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [hashed(found) for t in batch["text"].to_pylist() if (found := keys_of(t, min_chars))]
            rows = list(positions(bits, seen))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["slice", "block"])

    twice = bitmaps(spark, narrow.mapInArrow(gather, "slice long, block binary"), bits, "twice")

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = opened(twice)
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if i is not None and (found := list(keys_of(t, min_chars))):
                    for x in np.flatnonzero(member(seen, hashed(found), bits)):
                        ids.append(i)
                        out.append(found[x])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "digest"])

    held = narrow.mapInArrow(suspects, "doc_id long, digest binary").distinct()
    return held.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("digest", "keeper")


def rewritten(text: str | None, doc_id: int | None, least: int, drop) -> tuple[list[bytes], int, int]:
    """(kept lines, lines, dropped lines); drop(digest) gives the keeper, or none."""
    lines = (text or "").encode().split(b"\n")
    kept = []
    for x in lines:
        if len(x) >= least and eligible(k := key(x), least) and (keeper := drop(digest(k))) is not None and keeper != doc_id:
            continue
        kept.append(x)
    return kept, len(lines), len(lines) - len(kept)


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, drop_keys: int = DROP_KEYS) -> DataFrame:
    """Rows of docs as struct `row`, with kept (the text left), n_lines, n_dropped and kept_sha256."""
    ship(spark)
    keys = table(spark, droppable(spark, docs, min_chars, min_docs), "linekeys")
    schema = "kept string, n_lines long, n_dropped long, kept_sha256 string"

    def outputs(results) -> list[pa.Array]:
        texts = [b"\n".join(k) for k, _, _ in results]
        return [pa.array([t.decode() for t in texts], pa.string()), pa.array([n for _, n, _ in results], pa.int64()), pa.array([d for _, _, d in results], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]

    if keys.count() <= drop_keys:
        small = spark.sparkContext.broadcast({bytes(d): k for d, k in keys.toLocalIterator()})

        def by_broadcast(texts: pa.Array, rows: pa.StructArray) -> list[pa.Array]:
            drop = small.value.get
            return outputs([rewritten(t, i, min_chars, drop) for t, i in zip(texts.to_pylist(), rows.field("doc_id").to_pylist(), strict=True)])

        return append(docs, by_broadcast, schema)
    return by_join(spark, docs, keys, min_chars, outputs, schema)


def by_join(spark: SparkSession, docs: DataFrame, keys: DataFrame, min_chars: int, outputs, schema: str) -> DataFrame:
    """The same for any number of keys: each document gets its own drop list by joins on the digest and the text's hash."""
    texts = F.sha2(F.coalesce("text", F.lit("")), 256)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(keys_of(t, min_chars)) for t in batch["text"].to_pylist()]
            counts = [len(x) for x in found]
            at = np.repeat(np.arange(len(found)), counts)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at)), batch["sha"].take(pa.array(at)), pa.array([d for x in found for d in x], pa.binary())], ["doc_id", "sha", "digest"])

    held = docs.select("doc_id", "text", texts.alias("sha")).mapInArrow(lines, "doc_id long, sha string, digest binary")
    lists = held.join(keys, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "sha").agg(F.collect_set("digest").alias("drops"))
    packed = docs.select(F.struct("*").alias("own"), F.col("doc_id").alias("i"), texts.alias("s"))
    joined = packed.join(lists, packed.i.eqNullSafe(lists.doc_id) & (packed.s == lists.sha), "left").select("own", F.col("own.text").alias("text"), "drops")

    def apply(texts: pa.Array, rows: pa.StructArray) -> list[pa.Array]:
        out = []
        for t, drops in zip(texts.to_pylist(), rows.field("drops").to_pylist(), strict=True):
            drops = {bytes(d) for d in drops or ()}
            out.append(rewritten(t, None, min_chars, lambda d, drops=drops: 0 if d in drops else None))
        return outputs(out)

    added = [x.split()[0] for x in schema.split(", ")]
    return append(joined, apply, schema).select(F.col("row.own").alias("row"), *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(spark, docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH l AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
x AS (SELECT doc_id, r, unnest(generate_series(1, len(a))) AS p, unnest(a) AS line FROM l),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
d AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, d.key IS NULL OR k.doc_id = d.keeper AS stays FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""

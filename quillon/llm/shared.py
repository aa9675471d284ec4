"""What the operators share: shipping of the package, scratch tables, fixed-size hash filters, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import os
import sys
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


BATCH_SETTING, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, and bounds the batches they are sent to 8 MB.

    A session that has another limit than Spark's own default keeps it.
    """
    if spark.conf.get(BATCH_SETTING, BATCH) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="ship")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of spark.checkpoint.dir, removed when the driver's Python ends.

    Only on a local master is a temporary folder used where that setting is absent; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon")
        spark.conf.set("spark.checkpoint.dir", base)
    base = base if "://" in base else f"file://{os.path.abspath(base)}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder's owner clears it
        return


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes a compressed table to the shared folder and reads it back."""
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed block."""
    out = io.BytesIO()
    out.write(np.array([len(columns), len(columns[0])], "<i8").tobytes())
    for c in columns:
        out.write(np.array(c.dtype.str.encode().ljust(8), "S8").tobytes())
        out.write(np.ascontiguousarray(c).tobytes())
    return pa.compress(out.getvalue(), codec="zstd", asbytes=True) + len(out.getvalue()).to_bytes(8, "little")


def unpack(block: bytes) -> list[np.ndarray]:
    data = pa.decompress(block[:-8], decompressed_size=int.from_bytes(block[-8:], "little"), codec="zstd", asbytes=True)
    n, rows = np.frombuffer(data, "<i8", 2)
    at, out = 16, []
    for _ in range(n):
        kind = np.dtype(data[at : at + 8].rstrip(b"\0 ").decode())
        out.append(np.frombuffer(data, kind, rows, at + 8))
        at += 8 + rows * kind.itemsize
    return out


def input_bytes(df: DataFrame) -> int:
    """Size of the files under a DataFrame as the optimizer sees it; 0 where it has no statistics and assumes exabytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def dealt(spark: SparkSession, df: DataFrame, each: int = 64 << 20) -> int:
    """Partitions for data as large as df's files: the session's number, or one for `each` bytes where that is more.

    Partitions are sorted on disk, so beyond 2**17 they grow instead.
    """
    return max(parts(spark), min(input_bytes(df) // each, 1 << 17))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- fixed-size filters -------------------------------------------------------------------------------------------


def slices_of(bits: int) -> int:
    """Slices of a bitmap, each merged by a task: as many as keep one at 2**17 bits, 64 at least."""
    return max(64, 1 << max(0, bits - 17))


def positions(bits: int, seen: Iterable[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(slice, sorted positions in it) for 64-bit hashes cut to `bits` bits; repeats stay, as they count."""
    all_ = np.sort(np.concatenate([np.zeros(0, np.uint64), *seen]) >> np.uint64(64 - bits)).astype(np.int64)
    slices = slices_of(bits)
    width = (1 << bits) // slices
    edges = np.searchsorted(all_, np.arange(slices + 1, dtype=np.int64) * width)
    for s in range(slices):
        if edges[s] < edges[s + 1]:
            part = all_[edges[s] : edges[s + 1]] - s * width
            gaps = np.diff(part, prepend=0)
            kind = np.uint8 if gaps.max() < 256 else np.uint16 if gaps.max() < 65536 else np.uint32
            yield s, pack(gaps.astype(kind))


def merge_slices(bits: int):
    """For applyInArrow on groups of a slice: its once-seen and twice-seen bitmaps from all tasks' positions."""
    width = (1 << bits) // slices_of(bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(width, bool)
        twice = np.zeros(width, bool)
        s = None
        for batch in batches:
            for s, block in zip(batch["slice"].to_pylist(), batch["block"].to_pylist(), strict=True):
                at = np.cumsum(unpack(block)[0].astype(np.int64))
                again = at[1:][at[1:] == at[:-1]]
                twice[again] = True
                twice[at[once[at]]] = True
                once[at] = True
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(once).tobytes()]), pa.array([np.packbits(twice).tobytes()])], ["slice", "once", "twice"])

    return merge


def bits_for(items: int) -> int:
    """Bits of a bitmap that few other hashes meet: 16 an item, at least 2**20 and at most 2**30 bits (128 MB before compression)."""
    return int(np.clip(int(16 * max(1, items) - 1).bit_length(), 20, 30))


def bitmaps(spark: SparkSession, blocks: DataFrame, bits: int, which: str) -> Broadcast:
    """Broadcasts the `once` or `twice` bitmap of (slice, block) rows made by positions(): 2**bits bits, never more."""
    merged = blocks.select("slice", "block").groupBy("slice").applyInArrow(merge_slices(bits), "slice long, once binary, twice binary").select("slice", which)
    out = bytearray((1 << bits) // 8)
    step = len(out) // slices_of(bits)
    for row in merged.toLocalIterator():  # slices of a fixed size
        out[row[0] * step : (row[0] + 1) * step] = row[1]
    return spark.sparkContext.broadcast(zlib.compress(bytes(out), 1))


_held: dict[str, dict] = {}


def held(stage: str, key, make, most: int = 2):
    """make(), kept in this worker while the same stage runs: another stage's things are dropped, as are more than `most`."""
    if stage not in _held:
        _held.clear()
        _held[stage] = {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)  # else freed caches of the stage before stay with the worker
    own = _held[stage]
    if key not in own:
        while len(own) >= most:
            own.pop(next(iter(own)))
        own[key] = make()
    return own[key]


def opened(filter_: Broadcast) -> np.ndarray:
    """The bitmap's bytes, unpacked once in each worker."""
    packed = filter_.value
    return held("bitmaps", (len(packed), zlib.crc32(packed)), lambda: np.frombuffer(zlib.decompress(packed), np.uint8))


def member(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


# ---- sorted rows as whole groups ----------------------------------------------------------------------------------


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows sorted by integer `keys`, in runs that hold every group whole: a batch and one group at most are held."""
    held: list[dict[str, np.ndarray]] = []

    def joined(last: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {c: np.concatenate([*(x[c] for x in held), last[c]]) for c in last}

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: np.asarray(batch[c]) for c in batch.schema.names}
        turn = np.zeros(batch.num_rows, bool)
        for k in keys:
            turn[1:] |= columns[k][1:] != columns[k][:-1]
            turn[0] |= bool(held) and held[-1][k][-1] != columns[k][0]
        turns = np.flatnonzero(turn)
        if len(turns):
            last = int(turns[-1])
            yield joined({c: x[:last] for c, x in columns.items()})
            held, columns = [], {c: x[last:] for c, x in columns.items()}
        held.append(columns)
    if held:
        yield joined({c: x[:0] for c, x in held[0].items()})


# ---- connected components -----------------------------------------------------------------------------------------


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b) links, component the smallest node reachable.

    Alternating large-star and small-star contraction: each round points nodes at their smallest neighbour, and the
    number of rounds grows with the logarithm of the component size. Hubs are summed before the shuffle, the joins
    are plain equi-joins that adaptive execution can split, and each round's edges are cut to a written table. It ends once
    every node points at one other that points nowhere.
    """
    stars = table(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        ends = stars.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(stars.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR out = 1 AND in = 1").isEmpty():
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = table(spark, small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(stars.select("v", "v").distinct())


# ---- row-wise stages ----------------------------------------------------------------------------------------------


def append(docs: DataFrame, fn, schema: str, text: str = "text") -> DataFrame:
    """Rows of docs as one struct column `row`, beside columns that fn(texts, rows) gives for each row.

    The struct keeps any columns apart from those added, whatever their names.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(schema)
    packed = docs.select(F.struct("*").alias("row"))
    names = [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            yield pa.RecordBatch.from_arrays([rows, *fn(rows.field(text), rows)], ["row", *names])

    return packed.mapInArrow(run, StructType([*packed.schema, *added]))

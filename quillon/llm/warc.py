"""WARC output in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding several whole records of about FRAME_BYTES. Two skippable
frames end it: a record index (record id to frame number, offset and length in the frame), then the seek table of the
Zstandard seekable format, so a reader fetches the file's last bytes, the index, and the one frame it needs. Plain
`zstd -d` reads a bundle as one WARC file.

Equal payloads of at least `min_bytes` are written once: the record with the largest page_id is a response, the others are
revisits that refer to it. Only digests are shuffled to find them; the pages then meet their decisions by page_id, so a
payload shared by a third of all pages doesn't gather its copies in one task.

Defined results: a null html is an empty payload. Payloads of null page_ids take part, but the largest non-null page_id is
the response; where all are null, all are responses. Rows that repeat the response's page_id and payload are responses
too. A null url becomes an empty target URI. Each input row gives one record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import parts, scratch, ship, table

MIN_BYTES, FRAME_BYTES, BUNDLE_BYTES = 1000, 256 << 10, 64 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX_MAGIC, SEEK_MAGIC, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha1}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> tuple[str, bytes]:
    """(record id, bytes) of one WARC/1.1 record."""
    sha1 = hashlib.sha1(payload).hexdigest()
    name = record_id(page_id, sha1)
    block = HTTP if refers_to is not None else HTTP + payload
    uri = "".join(c for c in url or "" if c not in "\r\n")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha1)), ("X-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return name, head.encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(fields, payload, end) of the record at an offset. A revisit's payload is empty."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    block = data[stop + 4 : stop + 4 + size]
    return fields, block[block.index(b"\r\n\r\n") + 4 :], stop + 4 + size + 4


def skippable(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


class Writer:
    """Bundle writer over a binary stream."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.press = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frame: list[bytes] = []
        self.size = self.written = self.records = 0
        self.frames: list[tuple[int, int]] = []
        self.index: dict[str, list[tuple[int, int, int]]] = defaultdict(list)

    def add(self, name: str, data: bytes) -> None:
        if self.frame and self.size + len(data) > self.frame_bytes:
            self.flush()
        self.index[name].append((len(self.frames), self.size, len(data)))
        self.frame.append(data)
        self.size += len(data)
        self.records += 1

    def _put(self, data: bytes, size: int) -> None:
        self.out.write(data)
        self.frames.append((len(data), size))
        self.written += len(data)

    def flush(self) -> None:
        if self.frame:
            self._put(self.press.compress(b"".join(self.frame)), self.size)
            self.frame, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = zstandard.ZstdCompressor(level=3).compress(json.dumps(self.index).encode())
        self._put(skippable(INDEX_MAGIC, body), 0)
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        self.out.write(skippable(SEEK_MAGIC, entries + struct.pack("<IBI", len(self.frames), 0, SEEK_FOOTER)))
        self.out.close()


class Bundle:
    """Random access to a bundle by record id, or frame by frame."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        n, flags, magic = struct.unpack("<IBI", self._read(self.size - 9, 9))
        if magic != SEEK_FOOTER:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        table_ = self._read(self.size - 9 - n * width, n * width)
        self.frames, at = [], 0
        for i in range(n):
            packed, size = struct.unpack_from("<II", table_, i * width)
            self.frames.append((at, packed, size))
            at += packed

    @classmethod
    def open(cls, path: str) -> Bundle:
        fs, name = pafs.FileSystem.from_uri(path)
        return cls(fs.open_input_file(name))

    @classmethod
    def all_records(cls, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
        """Every record of a file, which is closed afterwards."""
        bundle = cls.open(path)
        with bundle.file:
            yield from bundle.records()

    def _read(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def index(self) -> dict[str, list[tuple[int, int, int]]]:
        at, packed, _ = self.frames[-1]
        return json.loads(zstandard.ZstdDecompressor().decompress(self._read(at + 8, packed - 8)))

    def frame(self, i: int) -> bytes:
        at, packed, size = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self._read(at, packed)) if size else b""

    def record(self, name: str) -> tuple[dict[str, str], bytes]:
        """Fields and payload of a record, from one frame."""
        i, offset, size = self.index()[name][0]
        fields, payload, _ = parse(self.frame(i)[offset : offset + size])
        return fields, payload

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i, (_, _, size) in enumerate(self.frames):
            if size:
                data, at = self.frame(i), 0
                while at < len(data):
                    fields, payload, at = parse(data, at)
                    yield fields, payload


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload another page's record holds."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    narrow = pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_bytes)
    held = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    held = table(pages.sparkSession, held.drop("n"), "held")  # a plain side, so that a payload of very many pages can be split
    return narrow.join(held, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_warc(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes bundles into `folder` (any URI that pyarrow opens); returns the manifest: path, records, bytes."""
    ship(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    back = revisits(pages, min_bytes).withColumnsRenamed({"page_id": "i", "digest": "d"})
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.withColumn("digest", digest).join(back, F.col("page_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        writer, name = None, ""

        def close() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [writer.records], "bytes": [writer.written]})

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (batch[c][i].as_py() for c in ("page_id", "url", "html", "refers_to"))
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    writer = Writer(fs.open_output_stream(f"{base}/{name}", compression=None), frame_bytes)
                writer.add(*record(page_id, url, (html or "").encode(), refers_to))
                if writer.written >= bundle_bytes:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return table(spark, rows.mapInArrow(write, "path string, records long, bytes long"), "bundles")


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row for each record of the manifest's bundles, digests and sizes taken from responses' payloads themselves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
        for batch in batches:
            for path in batch["path"].to_pylist():
                out: dict[str, list] = {c: [] for c in names}
                for fields, payload in Bundle.all_records(path):
                    own = fields["WARC-Type"] == "response"
                    told = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    real = hashlib.sha1(payload).hexdigest() if own else told
                    if real != told:
                        raise ValueError(f"damaged payload in {path}: {fields['WARC-Record-ID']}")
                    row = (int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, fields["WARC-Target-URI"], len(payload) if own else int(fields["X-Payload-Length"]), real, fields["WARC-Type"], None if own else int(fields["X-Refers-To-Page"]), fields["WARC-Record-ID"])
                    for c, v in zip(names, row, strict=True):
                        out[c].append(v)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(names, kinds, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"
    return manifest.select("path").repartition(4 * parts(manifest.sparkSession), "path").mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_warc(spark, pages, scratch(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN m.top IS NULL OR m.top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.top = page_id THEN NULL ELSE m.top END AS refers_to
FROM p LEFT JOIN m ON n >= 1000 AND p.d = m.d
"""

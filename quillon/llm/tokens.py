"""Token-ID output: documents to token ids, written as one wavelet matrix per shard file, and read back.

Documents go to shards by ranges of doc_id (approximate quantiles, so the number of rows decides, and at most MOST_SHARDS
edges reach the driver). A shard's task streams its rows in doc_id order into files of about FILE_TOKENS tokens, so
memory is bounded whatever the shard's size. A file is written under a temporary name and moved, so repeated and
speculative tasks leave one whole file; the manifest is a written table.

Defined results: a null text is an empty document and still gets its end id. Null doc_ids come first. Repeated rows are
written one after the other. Ids up to 65535 travel as 16 bits, others as 32.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import held, input_bytes, parts, scratch, ship, table
from quillon.llm.wavelet import WaveletFile, encode

FILE_TOKENS, SHARD_BYTES, MOST_SHARDS = 2_000_000, 256 << 20, 16_384
#: Odd pieces and words whose ids are remembered in a worker; longest piece that is taken apart or remembered; bytes encoded at once.
PIECES, WORDS, LONGEST, CHUNK = 700_000, 1_100_000, 64, 8 << 20

#: Byte-level alphabet: bytes that aren't printable Latin-1 stand for characters from 256 on. A blank parts words here.
_ALPHABET = np.arange(256, dtype="<u4")
_ALPHABET[[*range(33), *range(127, 161), 173]] = np.arange(256, 324)
_ALPHABET[32] = 32
#: ASCII and Latin-1 letters, then ASCII marks but no apostrophe: such a piece is a word and one run of marks.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "\xaa\xb5\xba")
_MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != "'")


class Encoder:
    """Texts to ids as bytes, the end id appended.

    A BPE tokenizer with word ends, which drops white space and lower-cases, gives the ids of a text as those of its pieces between
    ASCII white space; so each distinct piece of a chunk is encoded once, and a word once while it is remembered. Other tokenizers
    take whole texts.
    """

    def __init__(self, path: str, end_id: int, pieces: int = PIECES, words: int = WORDS):
        self.most_pieces, self.most_words = pieces, words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known_pieces: dict[bytes, bytes] = {}
        self.known_words: dict[bytes, bytes] = {}
        size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        told = json.loads(self.tokenizer.to_str())
        suffix = told["model"].get("end_of_word_suffix")
        self.split = bool(suffix) and "Lowercase" in str(told["normalizer"]) and "Removed" in str(told["pre_tokenizer"])
        if self.split:
            from tokenizers import pre_tokenizers

            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.last = np.zeros(size, bool)
            self.last[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True

    def whole(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for low in range(0, len(texts), 500):  # an encoding takes many times the text's memory
            part = self.tokenizer.encode_batch_fast([t.decode() for t in texts[low : low + 500]], add_special_tokens=False)
            out += [np.array(e.ids, self.kind).tobytes() for e in part]
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """The same for lower-case words that are one unit to the pre-tokenizer: all in one call, cut after word ends.

        They need no normalising, and go to the model in its own byte alphabet.
        """
        out = []
        for low in range(0, len(words), 20_000):
            part = words[low : low + 20_000]
            text = _ALPHABET[np.frombuffer(b" ".join(part), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                out += self.whole(part)
                continue
            data, at = ids.tobytes(), [0, *(ends * self.kind.itemsize).tolist()]
            out += [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    @staticmethod
    def recall(known: dict[bytes, bytes], most: int, keys: list[bytes], make) -> pa.Array:
        """Ids of distinct keys, as known or made; where more than `most` would be known, those of the present keys are."""
        got = list(map(known.get, keys))
        unknown = [k for k, x in zip(keys, got, strict=True) if x is None]
        made = dict(zip(unknown, make(unknown), strict=True))
        if made:
            got = [made[k] if x is None else x for k, x in zip(keys, got, strict=True)]
            if len(known) + len(made) > most:
                known.clear()
                made = dict(zip(keys, got, strict=True))
            known.update(islice(((k, x) for k, x in made.items() if len(k) <= LONGEST), most - len(known)))
        return pa.array(got, pa.large_binary())

    def pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces, by way of the words and marks they are made of."""
        words, marks = pc.ascii_rtrim(pieces, _MARKS), pc.utf8_ltrim(pieces, _LETTERS)
        size = np.asarray(pc.binary_length(pieces))
        fit = (np.asarray(pc.binary_length(words)) + np.asarray(pc.binary_length(marks)) == size) & (size <= LONGEST)
        units = pa.concat_arrays([pc.utf8_lower(words.filter(pa.array(fit))), marks.filter(pa.array(fit))]).dictionary_encode()
        ids = self.recall(self.known_words, self.most_words, units.dictionary.cast(pa.large_binary()).to_pylist(), self.units)
        n = len(units) // 2
        made = pc.binary_join_element_wise(ids.take(units.indices[:n]), ids.take(units.indices[n:]), pa.scalar(b"", pa.large_binary()))
        odd = self.recall(self.known_pieces, self.most_pieces, pieces.filter(pa.array(~fit)).cast(pa.large_binary()).to_pylist(), self.whole)
        at = np.where(fit, np.cumsum(fit), n + np.cumsum(~fit)) - 1
        return pa.concat_arrays([made, odd]).take(pa.array(at))

    def units(self, units: list[bytes]) -> list[bytes]:
        """Ids of words and runs of marks, of which one may be empty."""
        some = [u for u in units if u]
        ids = dict(zip(some, self.words(some), strict=True))
        return [ids.get(u, b"") for u in units]

    def column(self, texts: pa.Array) -> pa.Array:
        """Ids of texts as a column of bytes."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.split:
            return pa.array([x + self.end for x in self.whole(texts.cast(pa.large_binary()).to_pylist())], pa.large_binary())
        split = pc.ascii_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        ids = pa.concat_arrays([self.pieces(found.dictionary), pa.array([self.end], pa.large_binary())])
        ends = np.cumsum(np.asarray(pc.list_value_length(split)))
        codes = np.insert(np.asarray(found.indices), ends, len(found.dictionary))  # an end id after each text
        _, offsets, data = ids.take(pa.array(codes)).buffers()
        at = np.frombuffer(offsets, np.int64)[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), data])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.column(pa.array(texts, pa.large_string())).to_pylist()


def encoder_of(path: str, end_id: int, pieces: int = PIECES, words: int = WORDS) -> Encoder:
    """The encoder, made once in each worker."""
    return held("tokens", (path, end_id, pieces, words), lambda: Encoder(path, end_id, pieces, words), 1)


def edges(docs: DataFrame, shards: int) -> list[int]:
    if shards < 2:
        return []
    at = [i / shards for i in range(1, shards)]
    got = docs.agg(F.percentile_approx("doc_id", at, 100 * min(shards, 1000))).first()[0]
    return sorted(set(got or []))


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, shards: int | None = None, file_tokens: int = FILE_TOKENS, pieces: int = PIECES, words: int = WORDS) -> DataFrame:
    """Writes the shard files into `folder` (any URI that pyarrow opens) and returns the manifest.

    Manifest columns: path, shard, seq, n_docs, n_tokens, start (ids in all files before). `pieces` and `words` bound what a worker
    remembers: fewer take less memory and more time, and give the same ids.
    """
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = shards or int(np.clip(-(-input_bytes(docs) * 3 // SHARD_BYTES), 3 * parts(spark), MOST_SHARDS))
    cuts = np.array(edges(docs, shards), np.int64)
    kind = encoder_of(tokenizer_path, end_id).kind

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, end_id, pieces, words)
        for batch in batches:
            size = np.cumsum(np.asarray(pc.binary_length(batch["text"]).fill_null(0)), dtype=np.int64) // CHUNK
            for low, high in pairwise([0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]):
                part = batch.slice(low, high - low)
                shard = np.searchsorted(cuts, np.asarray(part["doc_id"].fill_null(0)), "right")
                shard[np.asarray(part["doc_id"].is_null())] = 0
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(shard, pa.int64()), encoder.column(part["text"]).cast(pa.binary())], ["doc_id", "shard", "ids"])

    rows = docs.mapInArrow(tokenize, "doc_id long, shard long, ids binary").repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("files", folder, lambda: None, 1)  # the encoder has done its work
        fs, base = pafs.FileSystem.from_uri(folder)
        shard, seq, ids, blocks, n = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"shard-{shard:06d}-{seq:06d}.qwm"
            lengths = [len(b) // kind.itemsize for b in blocks]
            data = encode(np.frombuffer(b"".join(blocks), kind), ids, lengths)
            fs.create_dir(base, recursive=True)
            draft = f"{base}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft, compression=None) as out:
                out.write(data)
            fs.move(draft, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "shard": [shard], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [n]})

        for batch in batches:
            for i, s, b in zip(batch["doc_id"].to_pylist(), batch["shard"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if blocks and (s != shard or n >= file_tokens):
                    yield flush()
                    seq, ids, blocks, n = (seq + 1 if s == shard else 0), [], [], 0
                shard = s
                ids.append(i)
                blocks.append(b)
                n += len(b) // kind.itemsize
        if blocks:
            yield flush()

    manifest = table(spark, rows.mapInArrow(write, "path string, shard long, seq long, n_docs long, n_tokens long"), "manifest")
    total, starts = 0, []
    for shard, n in manifest.groupBy("shard").agg(F.sum("n_tokens")).orderBy("shard").toLocalIterator():  # at most MOST_SHARDS rows
        starts.append((shard, total))
        total += n
    first = spark.createDataFrame(starts, "shard long, base long")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("before", before).join(F.broadcast(first), "shard").select("path", "shard", "seq", "n_docs", "n_tokens", (F.col("base") + F.col("before")).alias("start"))


def read_tokens(manifest: DataFrame, per_document) -> DataFrame:
    """doc_id, start, n_tokens and per_document(ids) of every document in the files of a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                shard = WaveletFile.open(path)
                ids, lengths = shard.tokens(), np.array(shard.lengths, np.int64)
                ends = np.cumsum(lengths)
                values = [per_document(ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.documents, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(values, pa.int64())], ["doc_id", "start", "n_tokens", "value"])

    n = parts(manifest.sparkSession)
    return manifest.select("path", "start").repartition(4 * n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, value long")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents_to_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, pieces: int = PIECES, words: int = WORDS) -> DataFrame:
    manifest = write_tokens(spark, docs, tokenizer_path or default_tokenizer(), end_id, scratch(spark, "tokens"), pieces=pieces, words=words)
    return read_tokens(manifest, crc).withColumnRenamed("value", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_to_tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

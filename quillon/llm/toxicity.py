"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is a logistic function of the distinct words, and beginnings of words, in it; a document's is the noisy-or of its sentences' scores,
1 - prod(1 - p). The weights are learned from document labels alone: the gradient of the documents' log-likelihood reaches the
sentences through the noisy-or, so that the sentences which explain a label take the blame. Sentences of a scored document that
reach LOCATE on their own are given as the offending ones.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z and Latin-1 capitals lower-cased; sentences end at `.`, `!`, `?` or a line break, and
those without words count for nothing. Whole texts are scored and learned from.

Bounds of what is learned from: SAMPLE documents a label, by least hash of the id, weighted back to their label's share; words
and stems of at least MIN_DOCS of them that toxic documents hold more often than by chance (by ASSOCIATION standard deviations), the
VOCABULARY most telling. Training is full-batch gradient ascent: each step is a job over the sample's partitions, which send one
gradient each; the driver holds weights alone.

Defined results: null and empty texts, and texts without words, have no sentence and take the learned score of an empty text, which
is 0 (a noisy-or of nothing). Without labels of both kinds every weight is 0 and each text with words scores the share of
label 1 among the labels learned (0 without any). Null doc_ids are scored, neither held out nor learned from. Labels other than 0
and 1 are ignored; of several labels of a doc_id the largest holds, and of several texts the least is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import kernel
from quillon.llm.shared import append, pack, ship, table, unpack

SAMPLE, MIN_DOCS, ASSOCIATION, VOCABULARY = 20_000, 5, 2.5, 1 << 12
#: Bytes of word beginnings that count as words of their own.
STEMS = (4, 5, 6, 7)
STEPS, RATE, RIDGE, LOCATE = 40, 0.4, 2e-5, 0.5
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def split(data: np.ndarray, offsets: np.ndarray) -> kernel.Words:
    """Words in lower case: of A-Z and of the Latin-1 letters, whose UTF-8 is C3 80 to C3 9E."""
    folded = data.copy()
    upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    folded[1:][upper] += 0x20
    return kernel.split_words(folded, offsets, kernel.PUNCTUATION, kernel.LOWER)


def parsed(data: np.ndarray, offsets: np.ndarray) -> tuple[kernel.Words, np.ndarray, np.ndarray]:
    """Words of a chunk, the sentence number of each (rising through the chunk), and the document of each sentence."""
    words = split(data, offsets)
    ended = np.concatenate([[0], np.cumsum(_ENDS[data])])
    doc = np.repeat(np.arange(len(offsets) - 1), words.counts)
    if not len(words.starts):
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    turn = np.ones(len(doc), bool)
    turn[1:] = (doc[1:] != doc[:-1]) | (ended[words.starts[1:]] != ended[words.starts[:-1]])
    return words, np.cumsum(turn) - 1, doc[turn]


def marks(words: kernel.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, hash) of the whole words, then of the beginnings of STEMS bytes of longer ones: inflected forms share those."""
    yield np.arange(len(words.starts)), words.hashes()
    length = words.ends - words.starts
    for n in STEMS:
        longer = np.flatnonzero(length > n)
        cut = kernel.Words(words.data, words.starts[longer], words.starts[longer] + n, words.first)
        yield longer, kernel.mix(cut.hashes() + kernel.U(n))


def known(words: kernel.Words, sentence: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature) for the distinct known words and stems of each sentence."""
    if not len(vocabulary) or not len(sentence):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    for word, h in marks(words):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        hit = vocabulary[at] == h
        found.append(sentence[word[hit]] * len(vocabulary) + at[hit])
    pairs = np.unique(np.concatenate(found))
    return pairs // len(vocabulary), pairs % len(vocabulary)


def sentence_scores(sentence: np.ndarray, feature: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Log of 1 - p of n sentences: weights hold one of each feature and the intercept at the end."""
    z = np.bincount(sentence, weights[feature], minlength=n) + weights[-1]
    return -np.logaddexp(0, z)


def word_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct hashes of words and stems of each text, with its label."""
    for batch in batches:
        y = np.asarray(batch["y"])
        for low, high, data, offsets in kernel.chunks(batch["text"]):
            words = split(data, offsets)
            for word, h in marks(words):
                first = np.searchsorted(word, words.first)
                seen = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                labels = np.repeat(y[low:high], [len(x) for x in seen])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seen).view(np.int64)), pa.array(labels.astype(np.int64))], ["word", "y"])


def telling(texts: DataFrame, n: int, positive: int, min_docs: int, size: int) -> np.ndarray:
    """Sorted hashes of the words most associated with label 1 in the sample of n documents."""
    share = positive / n
    counted = texts.mapInArrow(word_docs, "word long, y long").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic"))
    spread = F.sqrt(F.col("n") * share * (1 - share) * F.greatest(1 - F.col("n") / n, F.lit(1e-9)))
    told = counted.where(F.col("n") >= min_docs).withColumn("z", (F.col("toxic") - F.col("n") * share) / spread).where(F.col("z") > ASSOCIATION)
    top = told.orderBy(F.desc("z"), "word").limit(size).collect()  # `size` numbers
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """(y, text) of at most `most` documents a label, and the weight that brings each label back to its share."""
    said = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    counts = dict(map(tuple, said.groupBy("y").count().collect()))
    chosen = [said.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # 2 * most rows of two numbers
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return texts.select("y", "text"), {y: counts[y] / min(counts[y], most) for y in counts}


def features(vocabulary: np.ndarray):
    """For mapInArrow on (y, text): one packed row a chunk with its documents' labels, sentences and known words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch["y"])
            for low, high, data, offsets in kernel.chunks(batch["text"]):
                words, sentence, doc = parsed(data, offsets)
                s, f = known(words, sentence, vocabulary)
                blocks = [pack(y[low:high].astype(np.int8)), pack(doc.astype(np.int32)), pack(s.astype(np.int32), f.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blocks], ["y", "doc", "known"])

    return run


def gradient(held, share: dict[int, float]):
    """For mapInArrow on packed rows: log-likelihood and its gradient, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        total, likelihood = np.zeros(len(weights)), 0.0
        for batch in batches:
            for y_, doc_, known_ in zip(*(batch[c].to_pylist() for c in ("y", "doc", "known")), strict=True):
                (y,), (doc,), (s, f) = unpack(y_), unpack(doc_), unpack(known_)
                off = sentence_scores(s, f, len(doc), weights)
                clean = np.minimum(np.bincount(doc, off, minlength=len(y)), -1e-12)  # log of 1 - P
                clean[np.bincount(doc, minlength=len(y)) == 0] = 0
                p = -np.expm1(off)
                odds = np.where(y == 1, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-300), -1.0) * np.where(y == 1, share.get(1, 1.0), share.get(0, 1.0))
                told = np.flatnonzero(clean < 0)
                likelihood += float(np.where(y == 1, share.get(1, 1.0) * np.log(np.maximum(-np.expm1(clean), 1e-300)), share.get(0, 1.0) * clean)[told].sum())
                by = odds[doc] * p
                total[:-1] += np.bincount(f, by[s], minlength=len(weights) - 1)
                total[-1] += by.sum()
        yield pa.RecordBatch.from_arrays([pa.array([likelihood]), pa.array([total.tobytes()], pa.binary())], ["likelihood", "gradient"])

    return run


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = SAMPLE, min_docs: int = MIN_DOCS, size: int = VOCABULARY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes, and their weights with the intercept at the end."""
    texts, share = sampled(docs, labels, most)
    texts = table(spark, texts, "sample")
    n = texts.count()
    positive = texts.where("y = 1").count()
    if not n or positive in (0, n):
        rate = positive / n if n else 0.0
        return np.zeros(0, np.uint64), np.array([np.inf if rate == 1 else -np.inf])
    vocabulary = telling(texts, n, positive, min_docs, size)
    spread = max(1, min(n // 500, 64))
    rows = table(spark, texts.repartition(spread).mapInArrow(features(vocabulary), "y binary, doc binary, known binary"), "features")
    weights, first, second = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    weights[-1] = -6.0
    whole = sum(share[y] * (positive if y else n - positive) for y in share)
    for step in range(1, steps + 1):
        held = spark.sparkContext.broadcast(weights)
        parts = rows.mapInArrow(gradient(held, share), "likelihood double, gradient binary").collect()  # one row a partition of the bounded sample
        held.destroy()
        g = np.sum([np.frombuffer(r["gradient"]) for r in parts], axis=0) / whole
        g[:-1] -= RIDGE * weights[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        rate = RATE * (1 - 0.8 * (step - 1) / steps)
        weights = weights + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return vocabulary, weights


def score(spark: SparkSession, docs: DataFrame, vocabulary: np.ndarray, weights: np.ndarray, locate: float = LOCATE) -> DataFrame:
    """Rows of docs as struct `row`, with score, n_sentences and offending: (start, end, score) of sentences in bytes of UTF-8, and their text."""
    ship(spark)
    held = spark.sparkContext.broadcast((vocabulary, weights))

    def run(texts: pa.Array, rows: pa.StructArray) -> list[pa.Array]:
        vocabulary, weights = held.value
        scores, sizes, found = [], [], []
        for low, high, data, offsets in kernel.chunks(texts):
            words, sentence, doc = parsed(data, offsets)
            s, f = known(words, sentence, vocabulary)
            off = sentence_scores(s, f, len(doc), weights)
            scores.append(-np.expm1(np.bincount(doc, off, minlength=high - low)))
            sizes.append(np.bincount(doc, minlength=high - low))
            named: list[list[dict]] = [[] for _ in range(high - low)]
            worst = np.flatnonzero(-np.expm1(off) >= locate)
            begin = np.searchsorted(sentence, worst)
            end = np.searchsorted(sentence, worst, "right") - 1
            for k, a, b in zip(worst, begin, end, strict=True):
                a, b, base = int(words.starts[a]), int(words.ends[b]), int(offsets[doc[k]])
                named[doc[k]].append({"start": a - base, "end": b - base, "score": float(-np.expm1(off[k])), "text": data[a:b].tobytes().decode()})
            found += named
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())]))
        return [pa.array(np.concatenate([np.zeros(0), *scores])), pa.array(np.concatenate([np.zeros(0, np.int64), *sizes])), pa.array(found, kind)]

    return append(docs, run, "score double, n_sentences long, offending array<struct<start:long,end:long,score:double,text:string>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score(spark, docs, *learn(spark, docs, labels)).select(F.col("row.doc_id").alias("doc_id"), "score", F.size("offending").cast("long").alias("n_offending"))
    return out.withColumn("held_out", held_out("doc_id")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Language identification by cross-parsing entropy.

A suffix automaton is built over a bounded sample of labelled text for each language. A document is parsed against each
automaton: every phrase is the longest match with some place of the sample, and a new phrase starts where no match goes
on. The language needing the fewest phrases, each weighted by log2 of its sample's length, wins.

Text becomes symbols first: A-Z and the Latin-1 capitals of UTF-8 are lower-cased, letters and non-ASCII bytes are symbols, and
runs of anything else are one blank. Whole documents are parsed, and phrases are those of one pass from the first symbol to the last:
segments of SEGMENT symbols advance together through the automata's transition tables, each from the root at first; then each
goes on from where the one before it ended, until both ways begin a phrase at the same symbol, from which on they agree.

Bounds of the sample: SAMPLE_DOCS documents a language, of each the first SAMPLE_SYMBOLS / 60 (666) symbols within SAMPLE_CHARS
characters, SAMPLE_SYMBOLS symbols a language, so about 60 long documents fill it. Every label is learned: beyond
FULL_LANGUAGES languages, documents and symbols a language shrink so that those of all stay the same; so do symbols where the
automata of all languages would take more than CELLS table cells of 4 bytes in a worker.

Defined results: null texts and texts without a letter are `und` with score 0, as is all where nothing was learned. Ties
go to the first language in alphabetical order. The score is the winner's share of exp(-phrases) over the languages. The rate is
the winner's weighted phrases a symbol, null without a letter and 0 where nothing was learned.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import kernel
from quillon.llm.shared import append, held, ship

SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SYMBOLS, FULL_LANGUAGES = 400, 4000, 40_000, 64
SEGMENT, CELLS = 512, 48 << 20
#: Bytes of text parsed together.
LANES = 2 << 20
SLACK = 1.25
UNKNOWN = "und"

_NEW = 1 << 30


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes without repeated blanks (0x20), and the documents' new offsets."""
    x = kernel.LOWER[data]
    if len(x):
        upper = (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97) & (x[:-1] == 0xC3)
        x[1:][upper] += 0x20
    blank = ~(((x >= 97) & (x <= 122)) | (x >= 0x80))
    x[blank] = 0x20
    keep = np.ones(len(x), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    inner = offsets[offsets < len(x)]
    keep[inner] = True
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


class Automaton:
    """Suffix automaton of a sequence of small integers; `table` has a row of next states for each state."""

    def __init__(self, text: list[int], width: int):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.table = np.full((len(nexts), width), -1, np.int32)
        for s, out in enumerate(nexts):
            for c, t in out.items():
                self.table[s, c] = t


class Model:
    """Automata of all languages in one table, so that every language's lane is one gather a symbol."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        texts = [np.frombuffer(samples[x], np.uint8) for x in self.languages]
        counts = np.bincount(np.concatenate([np.zeros(0, np.uint8), *texts]), minlength=256)
        used = np.flatnonzero(counts).tolist()
        self.other, self.pad = len(used), len(used) + 1
        self.width = len(used) + 2
        self.code = np.full(256, self.other, np.int32)
        self.code[used] = np.arange(len(used))
        tables, self.roots, base = [np.zeros(0, np.int32)], [], 0
        for text in texts:
            t = Automaton(self.code[text].tolist(), self.width).table
            own = np.arange(len(t), dtype=np.int32)
            restart = np.where(t[0] >= 0, t[0], 0)
            step = np.where(t >= 0, t + base, (restart + base)[None, :])
            begins = t < 0
            begins[0] = True  # at the root no phrase is under way
            step = step * self.width + np.where(begins, _NEW, 0)
            step[:, self.pad] = (own + base) * self.width
            tables.append(step.astype(np.int32).ravel())
            self.roots.append(base * self.width)
            base += len(t)
        self.table = np.concatenate(tables)
        self.weights = np.array([math.log2(max(2, len(t))) for t in texts])

    def phrases(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each document (rows) against each language (columns)."""
        sizes = np.diff(offsets)
        segments = -(-sizes // SEGMENT)
        first = np.concatenate([[0], np.cumsum(segments)])
        owner = np.repeat(np.arange(len(sizes)), segments)
        within = np.arange(len(owner)) - first[owner]
        starts = offsets[owner] + within * SEGMENT
        lengths = np.minimum(SEGMENT, offsets[owner + 1] - starts)
        order = np.argsort(-lengths, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        s, n = starts[order], lengths[order]
        codes = np.append(self.code[x], self.pad)
        # begins[i]: for each language and segment of more than i symbols, longest first, whether a phrase begins at symbol i
        begins: list[np.ndarray] = []
        state = np.repeat(np.array(self.roots, np.int64)[:, None], len(order), axis=1)
        live = len(order)
        for i in range(int(n[0]) if len(n) else 0):
            while live and n[live - 1] <= i:
                live -= 1
            step = self.table[state[:, :live] + codes[s[:live] + i]]
            begins.append(step >= _NEW)
            state[:, :live] = step & (_NEW - 1)
        self._continued(begins, state, codes, s, n, place[np.flatnonzero(within) - 1], place[np.flatnonzero(within)])
        sums = np.zeros(state.shape, np.int64)
        for row in begins:
            sums[:, : row.shape[1]] += row
        out = np.zeros((len(self.languages), len(sizes)), np.int64)
        np.add.at(out, (slice(None), owner[order]), sums)
        return out.T

    def _continued(self, begins: list[np.ndarray], ends: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray, at: np.ndarray) -> None:
        """Parses the segments `at` again from the end of the ones `before` them, each until it agrees with what is known of it.

        A segment that never does ends in another state, and then the next is parsed once more.
        """
        following = np.full(len(starts), -1)
        following[before] = at
        k, at = (c.ravel() for c in np.meshgrid(np.arange(len(ends)), at, indexing="ij"))
        before = np.tile(before, len(ends))
        while len(at):
            state, i = ends[k, before], 0
            ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            while len(at):
                step = self.table[state + codes[starts[at] + i]]
                new, old = step >= _NEW, begins[i][k, at]
                begins[i][k, at] = new
                state, i = step & (_NEW - 1), i + 1
                open_ = ~(new & old)
                over = open_ & (lengths[at] == i)
                if over.any():
                    ended.append((k[over], at[over], state[over]))
                    open_ &= ~over
                k, at, state = k[open_], at[open_], state[open_]
            if not ended:
                return
            k, at, state = (np.concatenate(c) for c in zip(*ended, strict=True))
            again = (ends[k, at] != state) & (following[at] >= 0)
            ends[k, at] = state
            k, before = k[again], at[again]
            at = following[before]


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False)) if isinstance(doc_id, str) else doc_id


def sample(docs: DataFrame) -> dict[str, bytes]:
    """Bounded sample of labelled text by language, as symbols."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return {}
    # alike rows draw the same and count once, so about `each` rows a language come back, whatever repeats
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = min(1.0, FULL_LANGUAGES / len(counts))
    most, each = int(SAMPLE_SYMBOLS * part), max(1, int(SAMPLE_DOCS * part))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, each / n)) for lang, n in counts], "lang string, share double")
    out: dict[str, list[bytes]] = {lang: [] for lang, _ in counts}
    rows = known.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), draw.alias("draw"))
    sizes = dict.fromkeys(out, 0)
    for lang, text, _ in sorted(rows.distinct().collect(), key=lambda r: (r.lang, r.draw, r.text)):
        for _, _, data, offsets in kernel.chunks(pa.array([text])):
            x, _ = symbols(data, offsets)
            room = min(max(0, most - sizes[lang]), max(200, SAMPLE_SYMBOLS // 60))
            out[lang].append(x[:room].tobytes())
            sizes[lang] += len(x[:room])
    joined = {lang: b" ".join(x for x in texts if x) for lang, texts in out.items() if any(texts)}
    width = len(set().union(*joined.values())) + 2
    return {lang: text[: max(1, CELLS // (2 * width * len(joined)))] for lang, text in joined.items()}


def model(samples: dict[str, bytes]) -> Model:
    """The samples' model, built once in each worker."""
    key = hashlib.sha1(repr(sorted(samples.items())).encode()).hexdigest()
    return held("language", key, lambda: Model(samples), 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(spark: SparkSession, docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Rows of docs as struct `row`, with lang_pred, score, rate and symbols. `train` has doc_id, text and lang; docs by default."""
    ship(spark)
    samples = spark.sparkContext.broadcast(sample(docs if train is None else train))

    def run(texts: pa.Array, rows: pa.StructArray) -> list[pa.Array]:
        m = model(samples.value)
        names, scores, rates, sizes = [], [], [], []
        for low, high, data, offsets in kernel.chunks(texts, LANES):
            x, at = symbols(data, offsets)
            spoken = [has_letter(t.as_py()) for t in texts.slice(low, high - low)]
            sizes += np.diff(at).tolist()
            if not m.languages:
                names += [UNKNOWN] * (high - low)
                scores += [0.0] * (high - low)
                rates += [0.0 if ok else None for ok in spoken]
                continue
            counts = m.phrases(x, at) * m.weights / m.weights.max()
            best = counts.argmin(axis=1)
            share = 1 / np.exp(-(counts - counts.min(axis=1, keepdims=True))).sum(axis=1)
            rates += [float(c.min() / max(1, n)) if ok else None for c, n, ok in zip(counts, np.diff(at), spoken, strict=True)]
            names += [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, spoken, strict=True)]
            scores += [float(v) if ok else 0.0 for v, ok in zip(share, spoken, strict=True)]
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64()), pa.array(sizes, pa.int64())]

    return append(docs, run, "lang_pred string, score double, rate double, symbols long")


def scale(n: Column | str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(n) if isinstance(n, str) else n, F.lit(1)))).cast("int")


def limits(spark: SparkSession, docs: DataFrame) -> dict[int, float]:
    """Largest rate by scale (log2 of symbols) that text of the learned languages is given: SLACK times what held-out labelled text needs.

    Shorter texts need more a symbol, so a scale's limit is no less than those of longer ones. Scales below the shortest held-out
    text have none.
    """
    held = identify(spark, docs.where(held_out("doc_id") & F.col("lang").isNotNull()), docs)
    most = held.where("rate IS NOT NULL AND lang_pred = row.lang").groupBy(scale("symbols").alias("k")).agg(F.max("rate")).collect()
    out, limit = {}, 0.0
    for k, rate in sorted(map(tuple, most), reverse=True):
        out[k] = limit = max(limit, SLACK * rate)
    return out


def within(found: DataFrame, most: dict[int, float]) -> DataFrame:
    """Rows of identify with a letter whose rate is within the limit of the longest scale not above theirs, but for one phrase: the last may be cut short."""
    limit = F.lit(None).cast("double")
    for k, v in sorted(most.items()):
        limit = F.when(scale("symbols") >= k, F.lit(v)).otherwise(limit)
    return found.where(F.col("rate").isNotNull() & F.coalesce((F.col("rate") - limit) * F.col("symbols") <= 1, F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(spark, docs.select("doc_id", "text"), docs)
    return out.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").withColumn("held_out", held_out("doc_id"))

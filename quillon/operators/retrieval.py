"""Retrieval: scoring of chunks for batches of questions, caps, selection and citations.

Questions are few and small: they are broadcast behind a check of their number, and chunks stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Most questions that are broadcast to the chunks; each takes a few kilobytes.
BROADCAST_QUESTIONS = 20_000
#: Most ids that are broadcast alone, to read only the rows that have them.
BROADCAST_IDS = 1_000_000
#: Query vectors of one broadcast, and rows and queries of one product of matrices.
VECTOR_BLOCK, VECTOR_TILE = 4096, 1024

# Base adjustment by document type.
DOC_TYPE_BASE = {"frame": 0.10, "object": 0.09, "schema": 0.07, "guide": 0.05, "example": 0.02, "readme": -0.10}
# Concepts too general to score.
GENERIC_CONCEPTS = ("netex:NeTEx", "siri:SIRI", "transmodel:when", "transmodel:usedIn", "transmodel:NeTEx")


def small(df: DataFrame, most: int = BROADCAST_QUESTIONS) -> DataFrame:
    """Marks a side for broadcast if it has no more rows than that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scope_matches(chunk_scope: Column, asked: Column) -> Column:
    """Any common standard; an empty or null question scope takes all."""
    return (F.coalesce(F.size(asked), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap(chunk_scope, asked), F.lit(False))


def overlap_pairs(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_id, overlap) of pairs that share a token: questions' tokens meet chunks' tokens by equality.

    Tokens of one chunk are distinct, and the questions' side is broadcast, so the chunks aren't shuffled before their
    shared tokens are counted.
    """
    asked = questions.select("question_id", F.array_distinct(T.retrieval_tokens("question")).alias("q")).where(F.size("q") > 0)
    tokens = small(asked.select("question_id", F.size("q").alias("size"), F.explode("q").alias("token")))
    held = chunks.select("chunk_id", F.explode(F.array_distinct(T.retrieval_tokens("text"))).alias("token"))
    return held.join(tokens, "token").groupBy("question_id", "chunk_id").agg((F.count("*") / F.first("size")).alias("overlap"))


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "question_id", nth: str = "nth") -> DataFrame:
    """The first k rows of each question; Spark limits groups before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn(nth, F.row_number().over(w)).where(F.col(nth) <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6, block: int = VECTOR_BLOCK) -> DataFrame:
    """(question_id, chunk_id, similarity, nth): the k vectors (chunk_id, b) closest by cosine to each query vector (question_id, a).

    Queries go out in broadcasts of `block` vectors, each against all rows, and every task keeps k rows a query. Similarities
    are rounded before they are compared, and ids end ties. A vector isn't compared with a query of its own id, nor are
    null ids; null, empty, zero and unequally long vectors have similarity 0.
    """
    spark, schema = queries.sparkSession, "question_id long, chunk_id long, similarity double"
    rows = vectors.where("chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), "b")

    def units_of(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Places and unit vectors by length; null, empty and zero vectors and those with nulls are left out."""
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            if v is not None and len(v) and None not in v:
                by.setdefault(len(v), []).append(i)
        out = {}
        for n, at in by.items():
            m = np.array([vectors[i] for i in at], np.float64)
            size = np.sqrt((m * m).sum(axis=1))
            some = size != 0
            out[n] = np.array(at)[some], m[some] / size[some, None]
        return out

    def against(ids: list[int], asked: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array(ids, np.int64), units_of(asked)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, units = sent.value
            best, who = np.full((len(names), k), -np.inf), np.zeros((len(names), k), np.int64)
            for batch in batches:
                for low in range(0, batch.num_rows, VECTOR_TILE):
                    part = batch.slice(low, VECTOR_TILE)
                    own, held = part.column(0).to_numpy(zero_copy_only=False), units_of(part.column(1).to_pylist())
                    for q in range(0, len(names), VECTOR_TILE):
                        tile = slice(q, min(q + VECTOR_TILE, len(names)))
                        near = np.zeros((tile.stop - q, len(own)))
                        for n, (at, m) in held.items():
                            if n in units:
                                a, b = np.searchsorted(units[n][0], (q, tile.stop))
                                near[np.ix_(units[n][0][a:b] - q, at)] = units[n][1][a:b] @ m.T
                        near = np.round(near, digits) + 0.0
                        near[np.isnan(near)] = np.inf  # as Spark orders it
                        near[names[tile, None] == own[None, :]] = -np.inf
                        values = np.concatenate([best[tile], near], axis=1)
                        given = np.concatenate([who[tile], np.broadcast_to(own, near.shape)], axis=1)
                        first = np.lexsort((given, -values), axis=-1)[:, :k]
                        best[tile], who[tile] = np.take_along_axis(values, first, 1), np.take_along_axis(given, first, 1)
            some = best > -np.inf
            value = np.where(np.isposinf(best), np.nan, best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, some.sum(axis=1))), pa.array(who[some]), pa.array(value[some])], ["question_id", "chunk_id", "similarity"])

        return rows.mapInArrow(run, schema)

    found, ids, asked = spark.createDataFrame([], schema), [], []
    for r in queries.where("question_id IS NOT NULL").select("question_id", "a").toLocalIterator():
        ids.append(r[0])
        asked.append(r[1])
        if len(ids) == block:
            found, ids, asked = found.union(against(ids, asked)), [], []
    if ids:
        found = found.union(against(ids, asked))
    return top_k(found, k, F.desc("similarity"), F.asc("chunk_id"))


def doc_type_adjustment(hints: Column, kind: Column) -> Column:
    base = F.lit(0.0)
    for k, v in DOC_TYPE_BASE.items():
        base = F.when(kind == k, v).otherwise(base)
    hinted = (
        F.when(F.array_contains(hints, kind), 0.08)
        .when(kind == "readme", -0.05)
        .when(F.array_contains(hints, "example") & kind.isin("schema", "frame", "object"), -0.10)
        .otherwise(-0.03)
    )
    return base + F.when(F.size(hints) > 0, hinted).otherwise(0.0)


def path_adjustment(question: Column, hints: Column, path: Column) -> Column:
    p = T.lowered(path)
    named = F.coalesce(F.array_max(F.transform(F.filter(hints, lambda h: F.contains(p, h)), lambda h: F.when(F.length(h) >= 16, 0.20).otherwise(0.12))), F.lit(0.0))
    example = F.when(T.lowered(question).contains("example") & F.concat(F.lit("/"), p).contains("/examples/"), 0.04).otherwise(0.0)
    return F.least(F.lit(0.24), named + example)


def path_intent_adjustment(hints: Column, path: Column) -> Column:
    p = F.regexp_replace(T.lowered(path), "^/+", "")
    own = F.when(p.startswith("examples/"), 0.12).otherwise(0.0) - F.when(p.startswith("issues/"), 0.25).otherwise(0.0) - F.when(p.endswith(".xsd"), 0.20).otherwise(0.0)
    return F.when(F.array_contains(hints, "example"), own).otherwise(0.0)


def standard_adjustment(hinted: Column, scope: Column, repository: Column, path: Column) -> Column:
    blob = F.lower(F.concat_ws("\n", T.text(repository), T.text(path)))
    common = F.coalesce(F.arrays_overlap(scope, hinted), F.lit(False))
    named = F.exists(hinted, lambda h: F.contains(blob, F.lower(h)))
    score = F.when(common, 0.12).otherwise(0.0) + F.when(named, 0.08).otherwise(0.0) - F.when((F.size(scope) > 0) & ~common, 0.06).otherwise(0.0)
    return F.when(F.size(hinted) > 0, score).otherwise(0.0)


def intent_adjustment(question: Column, path: Column, label: Column, body: Column) -> Column:
    blob = F.lower(F.concat_ws("\n", T.text(path), T.text(label), T.text(body)))
    words = (("delayed", "late", "cancelled", "canceled"), ("journey",), ("exchange", "service delivery", "monitoring", "estimated timetable", "situation"))
    bonus = F.lit(0.0)
    for w in words:
        bonus = bonus + F.when(T.contains_any(blob, w), 0.05).otherwise(0.0)
    bonus = bonus + F.when(T.lowered(path).contains("example"), 0.02).otherwise(0.0)
    return F.when(T.delay_exchange(question), F.least(F.lit(0.15), bonus)).otherwise(0.0)


def example_boost(kind: Column, concepts: Column) -> Column:
    return F.when(kind == "xml-example", F.when(concepts > 0, 0.15).otherwise(0.10)).otherwise(0.0)


def graph_hits(chunk_concepts: Column, asked: Column, expanded: Column) -> tuple[Column, Column]:
    """(direct, expanded): concepts of a chunk that the question has, or else those that its expansion has; general concepts don't count."""
    specific = F.filter(chunk_concepts, lambda c: ~c.isin(*GENERIC_CONCEPTS))
    return F.array_intersect(specific, asked), F.array_intersect(specific, expanded)


def graph_adjustment(chunk_concepts: Column, asked: Column, expanded: Column, hints: Column, path: Column) -> Column:
    """Direct concept hits .20, and .06 where examples are asked for and the path is an example's; else expanded ones .10, and .08 for such a path."""
    direct, wider = graph_hits(chunk_concepts, asked, expanded)
    example = F.trim(T.lowered(path)).startswith("examples/")
    nearer = 0.20 + F.when(F.array_contains(hints, "example") & example, 0.06).otherwise(0.0)
    return F.when(F.size(direct) > 0, nearer).when(F.size(wider) > 0, 0.10 + F.when(example, 0.08).otherwise(0.0)).otherwise(0.0)


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def hybrid(vector: Column, lexical: Column, quality: Column, adjustments: Column, graph_hits: Column | None = None, penalty: float = 0.60) -> tuple[Column, Column]:
    """(score, rank): the larger of the hybrid and the legacy score with adjustments; a keyword trap lowers the rank alone."""
    v, lex, q = clamp(vector), clamp(lexical), clamp(quality)
    raw = F.greatest(0.5 * v + 0.3 * lex + 0.2 * q, 0.8 * q + 0.2 * lex) + adjustments
    trapped = (lex > 0.5) & (v < 0.35) & ((graph_hits if graph_hits is not None else F.lit(0)) == 0)
    rank = raw + 0.01 * lex + 0.005 * v
    return clamp(raw), F.when(trapped, rank * penalty).otherwise(rank)


def path_cap(ranked: DataFrame, most: int, *order: Column, by: str = "question_id", path: str = "source_path") -> DataFrame:
    """At most `most` rows of a path for each question, in order; an empty path isn't capped."""
    w = Window.partitionBy(by, path).orderBy(*order)
    return ranked.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= max(1, most)) | (F.coalesce(F.col(path), F.lit("")) == "")).drop("_n")


def preselect(pool: DataFrame, keep: int, k: int) -> DataFrame:
    """Scoring pool: the first graph candidates, filled up with others by (vector, lexical, quality); original order stays."""
    graph = Window.partitionBy("question_id", "from_graph").orderBy("position")
    first = pool.withColumn("_g", F.when(F.col("from_graph"), F.row_number().over(graph)))
    first = first.withColumn("_kept", F.coalesce(F.col("_g") <= min(keep, k), F.lit(False)))
    rest = Window.partitionBy("question_id").orderBy(F.desc("_kept"), "from_graph", F.desc("vector"), F.desc("lexical"), F.desc("quality"), "position")
    return first.withColumn("_r", F.row_number().over(rest)).where((F.col("_r") <= keep) & (F.col("_kept") | ~F.col("from_graph"))).drop("_g", "_kept", "_r")


def concept_cap(concepts: DataFrame, most: int) -> DataFrame:
    """Concepts of a question first, then by id, up to a number."""
    w = Window.partitionBy("question_id").orderBy(F.desc("asked"), "concept_id")
    return concepts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def merge_candidates(*frames: DataFrame) -> DataFrame:
    """Union of candidate frames, one row for each question and chunk: that of the earliest frame."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_from", F.lit(i))
        out = f if out is None else out.unionByName(f)
    w = Window.partitionBy("question_id", "chunk_id").orderBy("_from", "position")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_from")


SELECTED = "question_id long, chunk_id long, nth long, value double"


def diversify(candidates: DataFrame, k: int, weight: float = 0.92) -> DataFrame:
    """Greedy selection of k candidates a question: weight * rank - (1 - weight) * closest similarity to those selected.

    Similarity is the Jaccard index of the tokens of path, label and repository. A question's candidates are a capped
    pool, so the sequential choice runs over a few rows; questions spread over tasks. The earliest of equal values wins.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position", kind="stable")
        left = list(zip(rows["chunk_id"], rows["rank"], (set(t) for t in rows["tokens"]), strict=True))
        out, taken = [], []
        if len(left) <= k:
            out = [(c, i + 1, float(r)) for i, (c, r, _) in enumerate(left)]
        else:
            while left and len(out) < k:
                best, value = 0, None
                for i, (_, r, t) in enumerate(left):
                    near = max((len(t & s) / len(t | s) if t and s else 0.0 for s in taken), default=0.0)
                    v = weight * r - (1 - weight) * near
                    if value is None or v > value:
                        best, value = i, v
                c, _, t = left.pop(best)
                taken.append(t)
                out.append((c, len(out) + 1, float(value)))
        got = pd.DataFrame(out, columns=["chunk_id", "nth", "value"])
        got.insert(0, "question_id", rows["question_id"].iloc[0])
        return got

    tokens = T.plain_tokens(F.concat_ws(" ", "source_path", "label", "repository_url"))
    return candidates.select("question_id", "chunk_id", "rank", "position", tokens.alias("tokens")).groupBy("question_id").applyInPandas(run, SELECTED)


def citations(chunks: DataFrame, most: int) -> DataFrame:
    """Citations of each question: first the best source of every repository, then the best of all others; distinct paths.

    Documents and models come before others, READMEs last among equals, then by score and path; the input position ends ties.
    """
    p = T.lowered("source_path")
    docs = p.startswith("docs/") | p.contains("/docs/") | p.contains("model-summary") | p.startswith("models/") | p.contains("/models/")
    readme = F.regexp_extract(p, "([^/]*)$", 1).startswith("readme.")
    order = [F.when(docs, 0).otherwise(1), F.when(readme, 1).otherwise(0), -F.col("score"), p, F.col("position")]
    ranked = chunks.withColumn("_o", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))
    once = ranked.withColumn("_s", F.row_number().over(Window.partitionBy("question_id", "repository_url", "source_path").orderBy("_o"))).where("_s = 1")
    first = once.withColumn("_r", F.row_number().over(Window.partitionBy("question_id", "repository_url").orderBy("_o")))
    w = Window.partitionBy("question_id").orderBy(F.when(F.col("_r") == 1, 0).otherwise(1), "_o")
    return first.withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= most).drop("_o", "_s", "_r")

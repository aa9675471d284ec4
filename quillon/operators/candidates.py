"""Candidates of questions: chunks whose path a question names, and chunks that hold an alias of the question's concepts.

Needles (path hints, aliases) are looked for by one automaton over each text, in broadcast blocks of bounded size, so texts
are neither exploded nor crossed with questions; only ids of hits are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import ontology as O
from quillon.operators import retrieval as R
from quillon.session import cut

#: Needles of one broadcast; they take some 20 MB in a worker.
NEEDLE_BLOCK = 50_000
# Score of an alias by where it occurs, first match wins, and what its length adds at most.
PLACES = (("source_path", 1.10), ("label", 0.85), ("heading", 0.75), ("text", 0.40))
SPECIFICITY, PER_TOKEN, PER_CHARACTER, CHARACTERS = 0.75, 0.12, 0.01, 24


def holding(chunks: DataFrame, columns: Sequence[str], needles: DataFrame, block: int = NEEDLE_BLOCK) -> DataFrame:
    """(chunk_id, needle) of needles that occur in one of the columns, whatever the case; null and empty needles are left out.

    `needles` has one column, in lower case. Null columns hold nothing; repeated needles and rows give a pair once a row.
    """
    spark, schema = chunks.sparkSession, "chunk_id long, needle string"
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), *(T.lowered(c).alias(f"c{i}") for i, c in enumerate(columns)))

    def within(words: list[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for w in sent.value:
                machine.add_word(w, w)
            machine.make_automaton()
            for batch in batches:
                ids, got = [], []
                texts = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
                for n, key in enumerate(batch.column(0).to_pylist()):
                    hit = {w for t in texts for _, w in machine.iter(t[n])}
                    ids += [key] * len(hit)
                    got += hit
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.string())], ["chunk_id", "needle"])

        return rows.mapInArrow(run, schema)

    found, words = spark.createDataFrame([], schema), []
    for r in needles.toDF("needle").where("needle <> ''").distinct().toLocalIterator():
        words.append(r[0])
        if len(words) == block:
            found, words = found.union(within(words)), []
    return found.union(within(words)) if words else found


def path_hint_candidates(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(question_id, chunk_id, nth): chunks whose path holds a file name of the question, within its scope, up to max(15, 3 k) by id.

    questions: question_id, question, scope; chunks: chunk_id, source_path, standards_scope. A question without names has none.
    """
    asked = questions.select("question_id", "scope", F.explode(T.path_hints("question")).alias("needle"))
    pairs = holding(chunks, ["source_path"], asked.select("needle")).join(asked, "needle")
    scoped = pairs.join(chunks.select("chunk_id", "standards_scope"), "chunk_id").where(R.scope_matches(F.col("standards_scope"), F.col("scope")))
    return R.top_k(scoped.select("question_id", "chunk_id").distinct(), max(15, 3 * k), F.asc("chunk_id")).withColumn("nth", F.col("nth").cast("long"))


def specificity(alias: Column, tokens: Column) -> Column:
    return F.least(F.lit(SPECIFICITY), F.size(tokens) * PER_TOKEN + F.least(F.length(alias), F.lit(CHARACTERS)) * PER_CHARACTER)


def alias_score(alias: Column, places: Sequence[tuple[Column, Column, float]]) -> Column:
    """Score of a lower-case alias: that of the first place (text in lower case, its tokens, value) that holds it or all its tokens.

    Its length adds up to .75; an alias of blanks, or one that no place holds, scores 0.
    """
    tokens = T.plain_tokens(alias)
    out = F.lit(0.0)
    for body, words, value in reversed(places):
        subset = (F.size(tokens) > 0) & (F.size(F.array_except(tokens, words)) == 0)
        out = F.when(F.contains(body, alias) | subset, value + specificity(alias, tokens)).otherwise(out)
    return F.when(F.trim(alias) == "", 0.0).otherwise(out)


def graph_rank(score: Column, question: Column, hints: Column, kind: Column, path: Column, overlap: Column) -> Column:
    """Rank of a graph candidate: its best alias score, the question's token overlap, and its path and type against what is asked.

    `path` is in lower case, `hints` are document types that the question asks for.
    """
    q = T.lowered(question)
    xml = F.when(q.contains("xml"), F.when(path.endswith(".xml"), 0.35).when(path.endswith(".xsd"), -0.12).otherwise(0.0)).otherwise(0.0)
    named = F.size(F.filter(T.path_hints(question), lambda h: F.contains(path, h))) * 0.80
    asked = F.when(F.array_contains(hints, "example"), F.when(kind == "example", 0.60).when(kind == "schema", -0.10).otherwise(0.0))
    asked = asked.when(F.array_contains(hints, "schema") & (kind == "schema"), 0.20).otherwise(0.0)
    return score + 0.75 * overlap + xml + named + asked + F.when(path.startswith("examples/"), 0.15).otherwise(0.0)


def chosen_aliases(questions: DataFrame, concepts: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(question_id, alias) that a question looks for: of its concepts' aliases (concepts: question_id, concept_id), the best by `alias_choice`."""
    own = concepts.join(names.select("concept_id", "alias"), "concept_id").select("question_id", "alias").distinct()
    return O.alias_choice(own.join(questions.select("question_id", "question"), "question_id"), k).select("question_id", F.col("form").alias("alias"))


def graph_candidates(questions: DataFrame, selected: DataFrame, chunks: DataFrame, k: int, most: int | None = None, digits: int = 6) -> DataFrame:
    """(question_id, chunk_id, rank, nth): the n = max(10, 2 k) best schema and example chunks that hold an alias of the question.

    Chunks whose path or label holds one come first; a question that lacks r of n also takes, by quality and id, the
    best min(max(2 r, n), max(12, 2 n)) chunks whose text does. All are ranked together by (rank, quality, id), largest first;
    ranks have `digits` decimals.
    questions: question_id, question, scope; selected: question_id, alias in lower case; chunks: chunk_id, text, source_path,
    label, heading, doc_type, quality_score, standards_scope.
    """
    n = max(10, 2 * k) if most is None else max(0, most)
    base = chunks.where(F.col("doc_type").isin("schema", "example"))
    meta = base.select("chunk_id", "standards_scope", "quality_score")
    asked = selected.select("question_id", F.col("alias").alias("needle")).distinct()

    def hits(columns: Sequence[str], wanted: DataFrame) -> DataFrame:
        pairs = holding(base, columns, wanted.select("needle")).join(wanted, "needle").select("question_id", "chunk_id").distinct()
        scoped = pairs.join(meta, "chunk_id").join(questions.select("question_id", "scope"), "question_id")
        return scoped.where(R.scope_matches(F.col("standards_scope"), F.col("scope"))).select("question_id", "chunk_id", "quality_score")

    fast = cut(hits(["source_path", "label"], asked))
    counts = fast.groupBy("question_id").agg(F.count("*").alias("got"))
    short = asked.join(counts, "question_id", "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col("got") < n)
    slow = hits(["text"], short.select("question_id", "needle")).join(fast, ["question_id", "chunk_id"], "left_anti")
    slow = R.top_k(slow, max(12, 2 * n), F.desc("quality_score"), F.asc("chunk_id")).join(short.select("question_id", "got").distinct(), "question_id")
    slow = slow.where(F.col("nth") <= F.least(F.greatest(2 * (n - F.col("got")), F.lit(n)), F.lit(max(12, 2 * n))))
    pairs = fast.union(slow.select(*fast.columns))

    pairs = cut(pairs)
    kept = base.join(R.small(pairs.select("chunk_id").distinct(), R.BROADCAST_IDS), "chunk_id", "left_semi")  # only these are taken apart
    bodies = kept.select("chunk_id", "doc_type", *(T.lowered(c).alias(c) for c, _ in PLACES), *(F.array_distinct(T.plain_tokens(c)).alias(f"{c}_words") for c, _ in PLACES))
    bodies = bodies.withColumn("held", T.retrieval_tokens(F.concat_ws("\n", *(c for c, _ in PLACES))))
    forms = asked.groupBy("question_id").agg(F.sort_array(F.collect_list("needle")).alias("aliases"))
    about = questions.select("question_id", "question", T.retrieval_tokens("question").alias("q"), T.doc_type_hints("question").alias("hints")).join(forms, "question_id")
    places = [(F.col(c), F.col(f"{c}_words"), v) for c, v in PLACES]
    best = F.array_max(F.transform("aliases", lambda a: alias_score(a, places)))
    rank = graph_rank(best, F.col("question"), F.col("hints"), F.col("doc_type"), F.col("source_path"), T.overlap_of(F.col("q"), F.col("held")))
    scored = R.small(pairs).join(bodies, "chunk_id").join(R.small(about), "question_id").select("question_id", "chunk_id", "quality_score", F.round(rank, digits).alias("rank"))
    return R.top_k(scored, n, F.desc("rank"), F.desc("quality_score"), F.desc("chunk_id")).select("question_id", "chunk_id", "rank", F.col("nth").cast("long").alias("nth"))

"""Benchmark runs: chosen questions through a retrieval, errors as rows, measures, latencies, and gates on the run's own figures.

Questions run in batches, each one plan, and a batch's time is shared out evenly among its questions. A batch that fails is halved until the
question that breaks it is alone: that one becomes an error row, all others get their results, and the run goes on.

Defined results: an id that the questions lack is an error `not found`, a blank question `empty question`; repeated ids run once; a question that the
retrieval returns nothing for has no chunks and no error. Without a baseline only the gate on errors is judged.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import evaluation as E
from quillon.operators.analytics import latest_by
from quillon.session import cut

#: Times a batch is halved at most; ids that still fall together then fail together.
HALVINGS = 48
_RESULT = "question_id long, intent string, elapsed_ms double, paths array<string>, patterns array<string>, min_hits int, error string"


@dataclass
class Run:
    """results: question_id, intent, elapsed_ms, chunks, hit_at_5, mrr_at_10, error; stages: one dict a batch, with what was observed in it."""

    results: DataFrame
    stages: list[dict] = field(default_factory=list)


def stratified(questions: DataFrame, each: int) -> DataFrame:
    """(question_id, intent): of every intent the `each` questions whose ids have the smallest SHA-256, the same in every run."""
    order = Window.partitionBy("intent").orderBy(F.sha2(F.col("question_id").cast("string"), 256), "question_id")
    return questions.select("question_id", "intent").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).drop("_n")


def run(wanted: DataFrame, questions: DataFrame, answer: Callable[[DataFrame], DataFrame], size: int = 256, batches: int = 16, fail_fast: bool = False) -> Run:
    """Runs wanted questions (question_id, intent) of `questions` (question_id, question, patterns, min_hits).

    `answer` gives (question_id, nth, source_path) for a batch of questions. There are at most `batches` batches, of `size` questions or, where there are more, larger ones.
    """
    spark = wanted.sparkSession
    known = latest_by(questions.select(F.col("question_id").cast("long").alias("question_id"), "question", "patterns", F.col("min_hits").cast("int").alias("min_hits"), F.lit(True).alias("there")), ["question_id"], F.asc("question"))
    ids = latest_by(wanted.select(F.col("question_id").cast("long").alias("question_id"), "intent"), ["question_id"], F.asc("intent"))
    rows = ids.join(known, "question_id", "left")
    error = F.when(F.col("there").isNull(), "not found").when(F.trim(T.text("question")) == "", "empty question")
    rows = cut(rows.withColumn("error", error).drop("there"))
    ready, failed = rows.where("error IS NULL"), rows.where("error IS NOT NULL")
    none = F.array().cast("array<string>")
    done = [failed.select("question_id", "intent", F.lit(None).cast("double").alias("elapsed_ms"), none.alias("paths"), "patterns", "min_hits", "error")]
    if fail_fast and not failed.isEmpty():
        raise ValueError(f"{failed.count()} questions can't be run")
    parts = max(1, min(batches, math.ceil(ready.count() / size)))
    todo, stages = [(parts, i, 0) for i in range(parts)], []
    while todo:
        modulus, rest, depth = todo.pop(0)
        part = ready.where(F.pmod(F.xxhash64("question_id"), F.lit(modulus).cast("long")) == rest)
        n = part.count()
        if not n:
            continue
        begun, seen = time.perf_counter(), Observation()
        try:
            found = answer(part.select("question_id", "question")).observe(seen, F.count(F.lit(1)).alias("chunks"), F.max("nth").alias("deepest"))
            found = cut(found.select(F.col("question_id").cast("long").alias("question_id"), "nth", "source_path"))
        except Exception as e:  # whatever a question's plan may raise becomes its row
            if fail_fast:
                raise
            if n > 1 and depth < HALVINGS:
                todo[:0] = [(2 * modulus, rest, depth + 1), (2 * modulus, rest + modulus, depth + 1)]
                continue
            said = (str(e).strip() or type(e).__name__).splitlines()[0][:500]
            done.append(part.select("question_id", "intent", F.lit(None).cast("double").alias("elapsed_ms"), none.alias("paths"), "patterns", "min_hits", F.lit(said).alias("error")))
            continue
        elapsed = (time.perf_counter() - begun) * 1000
        stages.append({"questions": n, "elapsed_ms": elapsed, **seen.get})
        paths = found.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "source_path"))), lambda x: x["source_path"]).alias("paths"))
        own = part.join(paths, "question_id", "left").withColumn("paths", F.coalesce("paths", none))
        done.append(own.select("question_id", "intent", F.lit(elapsed / n).alias("elapsed_ms"), "paths", "patterns", "min_hits", "error"))
        if len(done) > 2 * batches:
            done = [cut(_union(done))]
    out = E.scored(_union(done) if done else spark.createDataFrame([], _RESULT), hits=(5,), ranks=(10,))
    good = F.col("error").isNull()
    measures = {"chunks": F.size("paths").cast("long"), "hit_at_5": F.when(good, F.col("hit_at_5")), "mrr_at_10": F.when(good, F.col("mrr_at_10"))}
    return Run(cut(out.withColumns(measures).select("question_id", "intent", "elapsed_ms", "chunks", "hit_at_5", "mrr_at_10", "error")), stages)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def summary(results: DataFrame) -> DataFrame:
    """One row: questions, ok, errors (a share), and latencies and measures of those that are ok."""
    bad = F.col("error").isNotNull()
    share = F.when(F.count(F.lit(1)) > 0, F.count_if(bad) / F.count(F.lit(1))).otherwise(0.0)
    return results.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(~bad).alias("ok"), share.alias("errors"), F.avg("elapsed_ms").alias("average"), E.percentile("elapsed_ms", 0.5).alias("p50"), E.percentile("elapsed_ms", 0.95).alias("p95"),
        F.avg(F.col("hit_at_5").cast("double")).alias("hit_at_5"), F.avg("mrr_at_10").alias("mrr_at_10"),
    )


def judged(results: DataFrame, kind: str, baseline: DataFrame | None = None) -> DataFrame:
    """(gate, ratio, most, passed) of a run of a kind: canary, stratified or full. A canary passes without errors only.

    `baseline` are the results of an earlier run. Without it only errors are judged; an intent that the earlier run lacks passes.
    """
    own = cut(summary(results))
    limit = E.GATES[kind].get("errors", 0.0)
    out = own.select(F.lit("errors").alias("gate"), F.col("errors").alias("ratio"), F.lit(limit).alias("most"), (F.col("errors") <= limit).alias("passed"))
    if baseline is None:
        return out
    out = out.unionByName(E.gates(own, summary(baseline), kind).where("gate <> 'errors'"))
    if "by_intent" not in E.GATES[kind]:
        return out
    most = E.GATES[kind]["by_intent"]
    means = [r.where("error IS NULL").groupBy("intent").agg(F.avg("elapsed_ms").alias("average")) for r in (results, baseline)]
    by = E.intent_gates(*means, most)
    return out.unionByName(by.select(F.concat(F.lit("intent "), F.coalesce("intent", F.lit(""))).alias("gate"), "ratio", F.lit(most).alias("most"), "passed"))

"""Retrieval evaluation: hits, reciprocal ranks, percentiles, and regression gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import STANDARDS


def matches(patterns: Column, paths: Column) -> Column:
    """Patterns that are part of any of the paths, whatever the case."""
    return F.filter(patterns, lambda p: F.exists(paths, lambda x: F.contains(F.lower(x), F.lower(p))))


def hit_at_k(patterns: Column, paths: Column, k: int, least: Column) -> Column:
    """paths in rank order."""
    return F.size(matches(patterns, F.slice(paths, 1, k))) >= least


def reciprocal_rank(patterns: Column, paths: Column, k: int) -> Column:
    first = F.array_position(F.transform(F.slice(paths, 1, k), lambda x: F.exists(patterns, lambda p: F.contains(F.lower(x), F.lower(p)))), F.lit(True))
    return F.when(F.size(patterns) == 0, 0.0).otherwise(F.when(first > 0, 1.0 / first).otherwise(0.0))


def scored(results: DataFrame, hits: Sequence[int] = (5, 10, 20), ranks: Sequence[int] = (10, 20)) -> DataFrame:
    """Results (patterns, paths, min_hits) with hit@k and reciprocal ranks."""
    p, x = F.col("patterns"), F.col("paths")
    out = {f"hit_at_{k}": hit_at_k(p, x, k, F.col("min_hits")) for k in hits} | {f"mrr_at_{k}": reciprocal_rank(p, x, k) for k in ranks}
    return results.withColumns(out)


def compared(results: DataFrame, measure: str = "mrr_at_10") -> DataFrame:
    """Means of the two modes, their difference, and how many questions the graph improved or worsened."""
    wide = results.groupBy("question_id").agg(*(F.max(F.when(F.col("mode") == m, F.col(measure))).alias(m) for m in ("control", "graph")))
    return wide.agg(F.avg("control").alias("control"), F.avg("graph").alias("graph"), (F.avg("graph") - F.avg("control")).alias("delta"), F.count_if(F.col("graph") > F.col("control")).alias("improved"), F.count_if(F.col("graph") < F.col("control")).alias("regressed"))


def percentile(c: Column | str, q: float) -> Column:
    """Linear interpolation at (n - 1) q."""
    return F.percentile(c, F.lit(q))


def latencies(results: DataFrame, by: str, value: str) -> DataFrame:
    return results.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("average"), percentile(value, 0.5).alias("p50"), percentile(value, 0.95).alias("p95"))


def stage_latencies(results: DataFrame, stages: str = "stages") -> DataFrame:
    """The same for each stage of a map of stage to milliseconds."""
    return latencies(results.select(F.explode(stages).alias("stage", "ms")), "stage", "ms")


#: Largest ratios to the baseline; errors as a share. Fixed values.
GATES = {
    "canary": {"p50": 1.15, "p95": 1.20},
    "stratified": {"errors": 0.02, "average": 1.10, "p95": 1.15, "by_intent": 1.12},
    "full": {"errors": 0.0, "average": 1.08, "p50": 1.12, "p95": 1.15},
}


def gates(summary: DataFrame, baseline: DataFrame, kind: str) -> DataFrame:
    """One row (gate, ratio, most, passed) for each limit. Both have average, p50, p95 and, the summary, errors (a share)."""
    one = summary.crossJoin(F.broadcast(baseline.select(*(F.col(c).alias(f"base_{c}") for c in ("average", "p50", "p95")))))
    ratio = lambda c: F.when(F.col(f"base_{c}") > 0, F.col(c) / F.col(f"base_{c}"))
    rows = [F.struct(F.lit(k).alias("gate"), (F.col("errors").cast("double") if k == "errors" else ratio(k)).alias("ratio"), F.lit(float(v)).alias("most")) for k, v in GATES[kind].items() if k != "by_intent"]
    return one.select(F.explode(F.array(*rows)).alias("g")).select("g.*").withColumn("passed", F.coalesce(F.col("ratio") <= F.col("most"), F.lit(False)))


def intent_gates(current: DataFrame, baseline: DataFrame, most: float = 1.12) -> DataFrame:
    """(intent, ratio, passed) of average latencies by intent; intents without a baseline pass."""
    out = current.select("intent", "average").join(baseline.select("intent", F.col("average").alias("base")), "intent", "left")
    ratio = F.when(F.col("base") > 0, F.col("average") / F.col("base"))
    return out.select("intent", ratio.alias("ratio"), F.coalesce(ratio <= most, F.lit(True)).alias("passed"))


def scope_of_tags(tags: Column) -> Column:
    """Sorted standards named by tags, or null."""
    known = {**{k: v for k, v in STANDARDS.items() if k != "transmodel"}, "datex": "DATEX II"}
    lower = F.transform(tags, F.lower)
    out = F.array_sort(F.array_compact(F.array(*(F.when(F.array_contains(lower, k), v) for k, v in known.items()))))
    return F.when(F.size(out) > 0, out)

"""Telemetry analytics over question events, queue items and FAQ versions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import retrieval_tokens, squeezed, text

# Domains of a queue item.
STATUSES = ("in_review", "approved", "rejected", "revoked", "published")
PRIORITIES = ("low", "normal", "high")
REASONS = ("LOW_CONFIDENCE", "CITATION_GAP", "POLICY_REVIEW", "USER_ESCALATION")


def since(created: Column, as_of: Column, days: int) -> Column:
    return created >= as_of - F.expr(f"INTERVAL {days} DAYS")


def promotion_candidates(events: DataFrame, as_of: Column, days: int = 14, least: int = 5, only_unresolved: bool = False) -> DataFrame:
    """Questions of the last days with how often they were asked and what that suggests."""
    key = F.lower(squeezed("question"))
    recent = events.where(since(F.col("created_at"), as_of, days)).withColumn("normalized_question", key)
    latest = F.max_by("id", F.struct("created_at", "id"))
    out = recent.groupBy("normalized_question").agg(
        F.count("*").alias("ask_count"),
        F.max("created_at").alias("last_asked_at"),
        latest.alias("latest_event_id"),
        F.bool_or(F.col("review_required") | F.col("abstained")).alias("unresolved"),
    )
    if only_unresolved:
        out = out.where("unresolved")
    action = F.when(F.col("ask_count") >= least, "CREATE_FAQ_DRAFT").when(F.col("ask_count") >= max(2, least // 2), "REVIEW_EXISTING_FAQ").otherwise("MONITOR")
    return out.withColumn("suggested_action", action).withColumn("not_helpful_rate", F.lit(0.0))


def counts_with_zeros(items: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """(dimension, value, n) for every value of a domain, absent ones with 0; other values are left out."""
    known = items.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, domain))).alias("value"))
    counted = items.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return known.join(counted, "value", "left").select(F.lit(column).alias("dimension"), "value", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def queue_counts(items: DataFrame, domains: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Counts by status, priority and reason from one pass over the items, with zeros."""
    domains = domains or {"status": STATUSES, "priority": PRIORITIES, "reason": REASONS}
    names = list(domains)
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in names)))
    counted = items.select(pairs.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    known = items.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.lit(v).alias("value")) for n in names for v in domains[n]))).alias("k")).select("k.*")
    return known.join(counted, ["dimension", "value"], "left").select("dimension", "value", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def queue_kpis(items: DataFrame, as_of: Column, sla_hours: int = 72) -> DataFrame:
    """One row: total, unresolved, overdue, and open items by age; an age of 24 hours is the youngest group's, one of 72 the middle's."""
    open_ = F.col("status") != "published"
    within = lambda hours: F.col("created_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")
    return items.agg(
        F.count("*").alias("total"),
        F.count_if(open_).alias("unresolved"),
        F.count_if(open_ & ~within(sla_hours)).alias("overdue"),
        F.count_if(open_ & within(24)).alias("lt24h"),
        F.count_if(open_ & ~within(24) & within(72)).alias("from24hto72h"),
        F.count_if(open_ & ~within(72)).alias("gt72h"),
    )


def feedback_counts(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(period, likes, dislikes, answer_success, clicks) for the last day of the window, and for the window."""
    periods = []
    for name, n in (("last24h", min(1, days)), ("window", days)):
        recent = events.where(since(F.col("created_at"), as_of, n))
        flags = (("user_likes", "likes"), ("user_dislikes", "dislikes"), ("answer_success", "answer_success"))
        periods.append(recent.agg(F.lit(name).alias("period"), *(F.count_if(c).alias(n) for c, n in flags), F.coalesce(F.sum("citation_click_count"), F.lit(0)).cast("long").alias("clicks")))
    return periods[0].union(periods[1])


def filtered(df: DataFrame, equal: Mapping[str, object] | None = None, search: str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Equality filters, each only where given, and a case-insensitive search over several columns."""
    for name, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    if search:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.lower(text(F.col(c).cast("string"))).contains(search.lower())
        df = df.where(hit)
    return df


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page, from 1, of a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def iso_time(c: Column) -> Column:
    """ISO-8601 UTC time with Z, without a fraction that is 0."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("."), micros, F.lit("Z")))


def latest_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def find_event(events: DataFrame, wanted: str) -> DataFrame:
    """By numeric id first, then by request_id; the latest of several."""
    hit = F.when(F.col("id").cast("string") == wanted, 0).when(F.col("request_id") == wanted, 1)
    return events.withColumn("_rank", hit).where("_rank IS NOT NULL").orderBy("_rank", F.desc("created_at"), F.desc("id")).limit(1).drop("_rank")


def apply_feedback(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback (request_id, likes, dislikes, clicks) applied to the latest event of its request: flags are set, clicks added.

    Feedback that both likes and dislikes is not applied.
    """
    w = Window.partitionBy("request_id").orderBy(F.desc("created_at"), F.desc("id"))
    given = feedback.where(~(F.col("likes") & F.col("dislikes"))).groupBy("request_id").agg(F.bool_or("likes").alias("_l"), F.bool_or("dislikes").alias("_d"), F.sum("clicks").alias("_c"))
    out = events.withColumn("_n", F.row_number().over(w)).join(given, "request_id", "left")
    touched = (F.col("_n") == 1) & F.col("_c").isNotNull()
    return out.select(
        *(c for c in events.columns if c not in ("user_likes", "user_dislikes", "citation_click_count")),
        F.when(touched, F.col("_l")).otherwise(F.col("user_likes")).alias("user_likes"),
        F.when(touched, F.col("_d")).otherwise(F.col("user_dislikes")).alias("user_dislikes"),
        (F.col("citation_click_count") + F.when(touched, F.col("_c")).otherwise(0)).cast("long").alias("citation_click_count"),
    )


def asked_groups(events: DataFrame) -> DataFrame:
    """Events by question text: counts, and the event that stands for them (one to be reviewed before others, then the newest)."""
    stands = F.max_by("id", F.struct("review_required", "created_at", "id"))
    return events.groupBy(F.lower(F.trim("question")).alias("question_key")).agg(
        F.count("*").alias("n"), F.count_if("user_likes").alias("likes"), F.count_if("user_dislikes").alias("dislikes"), stands.alias("representative_id")
    )


def keyword_aggregation(questions: DataFrame, group: str, body: str) -> DataFrame:
    """(group, kind, term, n, nth): the five most frequent tokens, and those of the five top bigrams that occur twice; ties go to the term seen first.

    Rows of kind `cohesion` hold in `share` the part of questions with one of the three top tokens.
    """
    base = questions.select(group, "position", retrieval_tokens(body).alias("tokens"))
    token = base.select(group, "position", F.posexplode("tokens").alias("i", "term"), F.lit("token").alias("kind"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.concat_ws(" ", F.element_at("tokens", i), F.element_at("tokens", i + 1)))
    bigram = base.where(F.size("tokens") > 1).select(group, "position", F.posexplode(pairs).alias("i", "term"), F.lit("bigram").alias("kind"))
    counted = token.union(bigram).groupBy(group, "kind", "term").agg(F.count("*").alias("n"), F.min(F.struct("position", "i")).alias("first"))
    w = Window.partitionBy(group, "kind").orderBy(F.desc("n"), "first")
    top = counted.withColumn("nth", F.row_number().over(w)).where("nth <= 5").where("kind = 'token' OR n >= 2")
    leads = top.where("kind = 'token' AND nth <= 3").groupBy(group).agg(F.collect_list("term").alias("leads"))
    cohesion = base.join(leads, group, "left").groupBy(group).agg(F.avg(F.when(F.coalesce(F.arrays_overlap("tokens", "leads"), F.lit(False)), 1.0).otherwise(0.0)).alias("share"))
    shown = top.select(group, "kind", "term", F.col("n").cast("long").alias("n"), F.col("nth").cast("long").alias("nth"), F.lit(None).cast("double").alias("share"))
    return shown.union(cohesion.select(group, F.lit("cohesion"), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long"), "share"))


def validation_signal(members: Column, similarity: Column, cohesion: Column) -> Column:
    strong = (members >= 5) & (similarity >= 0.86) & (cohesion >= 0.55)
    medium = (members >= 3) & (similarity >= 0.78) & (cohesion >= 0.35)
    return F.when(strong, "strong").when(medium, "medium").otherwise("weak")


MEMBERS = "id long, cluster long, similarity double, created_at timestamp"


def leader_clusters(events: DataFrame, vector: str = "vector", threshold: float = 0.82, newest: int = 500) -> DataFrame:
    """Members (id, cluster, similarity, created_at) of leader clusters of the newest events.

    Newest first, each event joins the cluster with the most similar centroid if that is similar enough, and moves
    its plain mean; else it founds a cluster with similarity 1. The scan is sequential by definition, and bounded by `newest`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True) if batches else pd.DataFrame()
        if not len(rows):
            return
        rows = rows.sort_values(["created_at", "id"], ascending=[False, False], kind="stable")
        sums, counts, out = [], [], []
        for i, v, at in zip(rows["id"], rows[vector], rows["created_at"], strict=True):
            v = np.asarray(v, float)
            best, score = -1, -1.0
            for k, (s, n) in enumerate(zip(sums, counts, strict=True)):
                c = s / n
                scale = float(np.linalg.norm(v) * np.linalg.norm(c))
                sim = float(v @ c) / scale if scale > 0 and len(v) == len(c) else 0.0
                if sim > score:
                    best, score = k, sim
            if best >= 0 and score >= threshold:
                sums[best] = sums[best] + v
                counts[best] += 1
            else:
                sums.append(v)
                counts.append(1)
                best, score = len(sums) - 1, 1.0
            out.append((i, best + 1, score, at))
        yield pd.DataFrame(out, columns=["id", "cluster", "similarity", "created_at"])

    recent = events.select("id", "created_at", vector).orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
    return recent.coalesce(1).mapInPandas(run, MEMBERS)


def cluster_rollup(members: DataFrame, questions: DataFrame, least: int = 2) -> DataFrame:
    """Clusters of at least `least` members with similarity, latest time, samples, keywords' cohesion and signal, largest first."""
    rows = members.join(questions.select("id", "question"), "id")
    placed = rows.withColumn("position", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("created_at"), F.desc("id"))))
    words = keyword_aggregation(placed.select("cluster", "position", "question"), "cluster", "question")
    cohesion = words.where("kind = 'cohesion'").select("cluster", F.round("share", 4).alias("cohesion"))
    label = words.where("kind = 'token' AND nth <= 3").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]), " ").alias("label"))
    out = placed.groupBy("cluster").agg(
        F.count("*").alias("members"),
        F.avg("similarity").alias("similarity"),
        F.max("created_at").alias("latest_asked_at"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("ids"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("position") <= 3, F.struct("position", "question")))), lambda x: x["question"]).alias("samples"),
    )
    out = out.join(cohesion, "cluster", "left").join(label, "cluster", "left").where(F.col("members") >= least)
    out = out.withColumn("label", F.coalesce("label", F.lit("unlabeled-intent")))
    return out.withColumn("signal", validation_signal(F.col("members"), F.col("similarity"), F.col("cohesion"))).orderBy(F.desc("members"), F.desc("latest_asked_at"))

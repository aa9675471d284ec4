"""Editorial requests: workflow transitions in order, publication as FAQ versions, audit rows, all as one commit.

Requests of one queue item follow each other by (requested_at, request_id): each sees the status that the one before left. They are
sorted within partitions and streamed, so an item with very many requests needs one task's time but not its memory.

Outcomes: ok; unknown_item (no such item, or a null id); not_allowed (no rule for the status and action); forbidden (a rule, but not for these roles);
incomplete (publishing an event without a question or an answer), which leaves the item as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import governance as G
from quillon.operators.analytics import latest_by
from quillon.session import cut, ship
from quillon.sources import commits

# Question words that are no keywords.
LOW_VALUE = ("about", "could", "does", "explain", "help", "into", "please", "should", "their", "there", "these", "this", "what", "when", "where", "which", "with", "would")

#: Tables of a state, and their keys.
KEYS = {"queue_items": ["queue_item_id"], "audit": ["request_id"], "responses": ["request_id"], "faq_entries": ["faq_entry_id"], "faq_versions": ["faq_entry_id", "version"]}


# ---- transitions --------------------------------------------------------------------------------------------------


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds from_status, to_status and outcome to rows sorted by item; the status goes from row to row, also across batches."""
    rules = {(status, action): (to, set(roles)) for action, status, to, roles in G.TRANSITIONS}
    item, status = None, None
    for b in batches:
        rows = []
        for i, first, action, roles, complete in zip(*(b.column(n).to_pylist() for n in ("queue_item_id", "status", "action", "roles", "complete")), strict=True):
            if i != item:
                item, status = i, first
            to, may = rules.get((status, action), (None, set()))
            outcome = "not_allowed" if to is None else "forbidden" if may.isdisjoint(roles or ()) else "incomplete" if to == "published" and not complete else "ok"
            rows.append((status, to if outcome == "ok" else None, outcome))
            status = to if outcome == "ok" else status
        for n, values in zip(("from_status", "to_status", "outcome"), zip(*rows, strict=True) if rows else ((), (), ()), strict=True):
            b = b.append_column(n, pa.array(values, pa.string()))
        yield b


def transitioned(items: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, queue_item_id, action, roles, requested_at) with from_status, to_status (null unless ok) and outcome.

    items: queue_item_id (unique), status, complete.
    """
    ship(requests.sparkSession)
    rows = requests.select("request_id", "queue_item_id", "action", "roles", "requested_at").join(items.select("queue_item_id", "status", "complete"), "queue_item_id", "left")
    known = rows.where("status IS NOT NULL").repartition("queue_item_id").sortWithinPartitions("queue_item_id", "requested_at", "request_id")
    schema = ", ".join(f"`{n}` {t}" for n, t in known.dtypes) + ", from_status string, to_status string, outcome string"
    none = F.lit(None).cast("string")
    unknown = rows.where("status IS NULL").withColumns({"from_status": none, "to_status": none, "outcome": F.lit("unknown_item")})
    return known.mapInArrow(_followed, schema).unionByName(unknown).drop("status", "complete")


def new_statuses(outcomes: DataFrame) -> DataFrame:
    """(queue_item_id, status, updated_at) after the last transition of each item that had one."""
    last = F.max(F.struct("requested_at", "request_id", "to_status")).alias("m")
    return outcomes.where("outcome = 'ok'").groupBy("queue_item_id").agg(last).select("queue_item_id", F.col("m.to_status").alias("status"), F.col("m.requested_at").alias("updated_at"))


# ---- publication --------------------------------------------------------------------------------------------------


def stripped(c: Column) -> Column:
    return F.regexp_replace(T.text(c), r"^\s+|\s+$", "")


def complete(question: Column, answer: Column) -> Column:
    return (stripped(question) != "") & (stripped(answer) != "")


def scope(c: Column) -> Column:
    """Names of a scope without blanks, each once, in their order."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, empty), lambda s: F.trim(s)), lambda s: F.coalesce(s != "", F.lit(False))))


def keyword_tokens(question: Column, terms: Column) -> Column:
    """Terms, then the question's words of four letters or more that are new, up to 12 in all and at least one."""
    low = F.transform(terms, lambda t: F.lower(t))
    words = F.filter(T.found(F.lower(question), "[a-z0-9]+"), lambda t: (F.length(t) >= 4) & ~t.isin(*LOW_VALUE) & ~F.array_contains(low, t))
    return F.concat(terms, F.slice(F.array_distinct(words), F.lit(1), F.greatest(F.lit(12) - F.size(terms), F.lit(1))))


def normalized_intent(question: Column, intent: Column, concept: Column) -> Column:
    """Intent and concept; the question's first 512 letters where neither is known."""
    both = F.trim(F.concat_ws(" ", intent, concept))
    return F.when(both == "unknown nits:unknown-concept", F.lower(question).substr(1, 512)).otherwise(both)


def entry_id(intent: Column, standards: Column, matched: Column) -> Column:
    """The matched entry's id, or one made of the intent and the sorted scope."""
    made = F.sha1(F.concat(intent, F.lit("|"), F.array_join(F.array_sort(standards), "|")).cast("binary")).substr(1, 12)
    return F.when(T.text(matched) != "", matched).otherwise(F.concat(F.lit("faq-auto-"), made))


def drafts(outcomes: DataFrame, items: DataFrame, events: DataFrame) -> DataFrame:
    """What published requests hold, with the entry that each belongs to.

    items: queue_item_id, event_id; events: event_id, question, answer, standards_scope, matched_faq_entry_id, core_concept, confidence.
    """
    done = outcomes.where("outcome = 'ok' AND to_status = 'published'").select(F.col("request_id").alias("draft_id"), "queue_item_id", F.col("requested_at").alias("created_at"))
    rows = done.join(items.select("queue_item_id", "event_id"), "queue_item_id").join(events, "event_id")
    rows = rows.withColumns({"question": stripped(F.col("question")), "answer": stripped(F.col("answer")), "standards_scope": scope(F.col("standards_scope"))})
    rows = rows.withColumn("normalized_intent", normalized_intent(F.col("question"), T.intent("question"), F.col("core_concept")))
    rows = rows.withColumn("faq_entry_id", entry_id(F.col("normalized_intent"), F.col("standards_scope"), F.col("matched_faq_entry_id")))
    return rows.withColumn("keyword_tokens", keyword_tokens(F.col("question"), T.original_terms("question")))


def entries_of(published: DataFrame) -> DataFrame:
    """Entries as the last of their drafts leaves them."""
    last = latest_by(published, ["faq_entry_id"], F.desc("created_at"), F.desc("draft_id"))
    return last.select("faq_entry_id", "normalized_intent", "standards_scope", "keyword_tokens", F.lit(True).alias("is_active"))


def versions_of(published: DataFrame, versions: DataFrame, links: DataFrame) -> DataFrame:
    """One version a draft, numbered on from those that the entry has, with the citations of its event."""
    cited = G.queue_citations(published.select("queue_item_id", "event_id"), links)
    rows = G.next_versions(versions, published.join(cited, "queue_item_id"))
    return rows.select("faq_entry_id", F.col("version").cast("long").alias("version"), "answer", "citations", "confidence", F.lit(False).alias("review_required"), F.lit(True).alias("is_published"))


# ---- one commit ---------------------------------------------------------------------------------------------------


def start(spark: SparkSession, root: str, items: DataFrame) -> int:
    """The first commit: the queue (queue_item_id, event_id, status, updated_at), and no other rows."""
    citation = "struct<repository_url: string, commit_sha: string, source_path: string, chunk_id: string, label: string>"
    empty = {
        "responses": "request_id string, queue_item_id string, outcome string, status string, responded_at timestamp",
        "audit": "request_id string, queue_item_id string, action string, from_status string, to_status string, actor_id string, actor_roles array<string>, comment string, created_at timestamp",
        "faq_entries": "faq_entry_id string, normalized_intent string, standards_scope array<string>, keyword_tokens array<string>, is_active boolean",
        "faq_versions": f"faq_entry_id string, version long, answer string, citations array<{citation}>, confidence double, review_required boolean, is_published boolean",
    }
    own = items.select(F.col("queue_item_id").cast("string").alias("queue_item_id"), "event_id", "status", "updated_at")
    return commits.commit(spark, root, {"queue_items": own, **{n: spark.createDataFrame([], s) for n, s in empty.items()}}, 0)


def apply_requests(spark: SparkSession, root: str, requests: DataFrame, events: DataFrame, links: DataFrame) -> int:
    """Applies requests (with actor_id, comment) to the state in `root`: queue, audit, answers and FAQ change in one commit, or not at all.

    A request that has an answer already is left out, so doing a batch again changes nothing. Returns the commit's number.
    """
    base = commits.version(spark, root)
    held = {n: commits.rows_of(spark, root, n, k, base) for n, k in KEYS.items()}
    items = held["queue_items"]
    requests = requests.withColumns({c: F.col(c).cast("string") for c in ("request_id", "queue_item_id")})
    new = latest_by(requests, ["request_id"], F.asc("requested_at")).join(held["responses"].select("request_id"), "request_id", "left_anti")
    ready = items.join(events.select("event_id", complete(F.col("question"), F.col("answer")).alias("complete")), "event_id", "left")
    outcomes = cut(transitioned(ready, new))
    published = cut(drafts(outcomes, items, events))
    said = new.select("request_id", "actor_id", "comment")
    audit = outcomes.where("outcome = 'ok'").join(said, "request_id")
    status = F.coalesce("to_status", "from_status")
    changes = {
        "queue_items": new_statuses(outcomes).join(items.select("queue_item_id", "event_id"), "queue_item_id").select("queue_item_id", "event_id", "status", "updated_at"),
        "audit": audit.select("request_id", "queue_item_id", "action", "from_status", "to_status", "actor_id", F.array_sort("roles").alias("actor_roles"), T.text("comment").alias("comment"), F.col("requested_at").alias("created_at")),
        "responses": outcomes.select("request_id", "queue_item_id", "outcome", status.alias("status"), F.col("requested_at").alias("responded_at")),
        "faq_entries": entries_of(published),
        "faq_versions": versions_of(published, held["faq_versions"], links),
    }
    return commits.commit(spark, root, changes, base)

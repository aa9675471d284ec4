"""Queries on events and queue items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import analytics as A
from quillon.operators import governance as G
from quillon.plans.frames import EVENTS, QUEUE, events, latest, queue, squeezed, tokens
from quillon.streaming import events as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "promotion_candidates",
    rf"""WITH {EVENTS}, r AS (SELECT *, lower({squeezed("question")}) AS nq FROM ev WHERE created_at >= (SELECT max(created_at) FROM ev) - INTERVAL 14 DAY)
SELECT nq AS normalized_question, count(*) AS ask_count, max(created_at) AS last_asked_at, (list(id ORDER BY created_at DESC, id DESC))[1] AS latest_event_id, bool_or(review_required OR abstained) AS unresolved,
CASE WHEN count(*) >= 5 THEN 'CREATE_FAQ_DRAFT' WHEN count(*) >= 2 THEN 'REVIEW_EXISTING_FAQ' ELSE 'MONITOR' END AS suggested_action, CAST(0.0 AS DOUBLE) AS not_helpful_rate FROM r GROUP BY nq""",
)
def promotion_candidates(spark, d):
    ev = events(spark, d)
    return A.promotion_candidates(ev, latest(ev, "created_at"))


@query(
    "promotion_candidates_unresolved",
    rf"""WITH {EVENTS}, r AS (SELECT *, lower({squeezed("question")}) AS nq FROM ev WHERE created_at >= (SELECT max(created_at) FROM ev) - INTERVAL 30 DAY)
SELECT nq AS normalized_question, count(*) AS ask_count, max(created_at) AS last_asked_at FROM r GROUP BY nq HAVING bool_or(review_required OR abstained) ORDER BY ask_count DESC, last_asked_at DESC, nq LIMIT 50""",
)
def promotion_unresolved(spark, d):
    ev = events(spark, d)
    out = A.promotion_candidates(ev, latest(ev, "created_at"), days=30, only_unresolved=True)
    return out.orderBy(F.desc("ask_count"), F.desc("last_asked_at"), "normalized_question").limit(50).select("normalized_question", "ask_count", "last_asked_at")


@query(
    "queue_kpis",
    f"""WITH {QUEUE}, a AS (SELECT max(created_at) AS t FROM q), x AS (SELECT status <> 'published' AS o, created_at AS c, a.t FROM q, a)
SELECT count(*) AS total, count(*) FILTER (o) AS unresolved, count(*) FILTER (o AND c < t - INTERVAL 2160 HOUR) AS overdue, count(*) FILTER (o AND c >= t - INTERVAL 24 HOUR) AS lt24h,
count(*) FILTER (o AND c < t - INTERVAL 24 HOUR AND c >= t - INTERVAL 72 HOUR) AS from24hto72h, count(*) FILTER (o AND c < t - INTERVAL 72 HOUR) AS gt72h FROM x""",
)
def queue_kpis(spark, d):
    q = queue(spark, d)
    return A.queue_kpis(q, latest(q, "created_at"), sla_hours=2160)


@query(
    "queue_counts",
    f"""WITH {QUEUE}, k AS (SELECT 'status' AS dimension, unnest(['in_review', 'approved', 'rejected', 'revoked', 'published']) AS value UNION ALL SELECT 'priority', unnest(['low', 'normal', 'high'])
UNION ALL SELECT 'reason', unnest(['LOW_CONFIDENCE', 'CITATION_GAP', 'POLICY_REVIEW', 'USER_ESCALATION']))
SELECT dimension, value, CAST((SELECT count(*) FROM q WHERE (dimension = 'status' AND status = value) OR (dimension = 'priority' AND priority = value) OR (dimension = 'reason' AND reason = value)) AS BIGINT) AS n FROM k""",
)
def queue_counts(spark, d):
    return A.queue_counts(queue(spark, d))


@query(
    "feedback_counts",
    f"""WITH {EVENTS}, a AS (SELECT max(created_at) AS t FROM ev)
SELECT p AS period, count(*) FILTER (user_likes) AS likes, count(*) FILTER (user_dislikes) AS dislikes, count(*) FILTER (answer_success) AS answer_success, CAST(coalesce(sum(citation_click_count), 0) AS BIGINT) AS clicks
FROM (SELECT 'last24h' AS p, ev.* FROM ev, a WHERE created_at >= a.t - INTERVAL 1 DAY UNION ALL SELECT 'window', ev.* FROM ev, a WHERE created_at >= a.t - INTERVAL 30 DAY) GROUP BY p""",
)
def feedback_counts(spark, d):
    ev = events(spark, d)
    return A.feedback_counts(ev, latest(ev, "created_at"))


@query(
    "event_search_page",
    f"""WITH {EVENTS} SELECT id, request_id, question, mode, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created FROM ev
WHERE mode = 'rag' AND NOT review_required AND (lower(question) LIKE '%view%' OR lower(request_id) LIKE '%view%' OR CAST(id AS VARCHAR) LIKE '%view%') ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 100""",
)
def event_search_page(spark, d):
    found = A.filtered(events(spark, d), {"mode": "rag", "review_required": False, "user_likes": None}, "VIEW", ("question", "request_id", "id"))
    return A.page(found, 2, 100, F.desc("created_at"), F.desc("id")).select("id", "request_id", "question", "mode", F.substring(A.iso_time(F.col("created_at")), 1, 19).alias("created"))


@query("event_totals", f"WITH {EVENTS} SELECT mode, count(*) AS n FROM ev GROUP BY mode")
def event_totals(spark, d):
    return events(spark, d).groupBy("mode").agg(F.count("*").alias("n"))


@query(
    "queue_search_page",
    f"""WITH {QUEUE}, {EVENTS} SELECT q.queue_item_id, q.status, q.priority, q.reason, ev.request_id, ev.question FROM q JOIN ev ON q.event_id = ev.id
WHERE q.status = 'in_review' AND q.priority = 'high' AND lower(ev.question) LIKE '%click%' ORDER BY q.created_at DESC, q.queue_item_id LIMIT 20""",
)
def queue_search_page(spark, d):
    joined = queue(spark, d).join(events(spark, d).select(F.col("id").alias("event_id"), "request_id", "question"), "event_id")
    found = A.filtered(joined, {"status": "in_review", "priority": "high", "reason": None}, "click", ("question",))
    return A.page(found, 1, 20, F.desc("created_at"), F.asc("queue_item_id")).select("queue_item_id", "status", "priority", "reason", "request_id", "question")


@query("event_by_request", f"WITH {EVENTS} SELECT id, request_id, question FROM ev WHERE request_id = 'req-42' ORDER BY created_at DESC, id DESC LIMIT 1")
def event_by_request(spark, d):
    return A.find_event(events(spark, d), "req-42").select("id", "request_id", "question")


@query("latest_event_per_request", f"WITH {EVENTS} SELECT request_id, id, question FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, id DESC) AS n FROM ev) WHERE n = 1")
def latest_event_per_request(spark, d):
    return A.latest_by(events(spark, d), ["request_id"], F.desc("created_at"), F.desc("id")).select("request_id", "id", "question")


@query(
    "feedback_on_latest_event",
    f"""WITH {EVENTS}, g AS (SELECT request_id, bool_or(user_likes) AS l, bool_or(FALSE) AS d, sum(3) AS c FROM (SELECT DISTINCT request_id, user_likes FROM ev WHERE id % 7 = 0) GROUP BY request_id),
x AS (SELECT ev.*, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, id DESC) AS n FROM ev)
SELECT x.id, CASE WHEN n = 1 AND g.c IS NOT NULL THEN g.l ELSE user_likes END AS user_likes, CASE WHEN n = 1 AND g.c IS NOT NULL THEN g.d ELSE user_dislikes END AS user_dislikes,
CAST(citation_click_count + CASE WHEN n = 1 THEN coalesce(g.c, 0) ELSE 0 END AS BIGINT) AS citation_click_count FROM x LEFT JOIN g ON x.request_id = g.request_id""",
)
def feedback_on_latest(spark, d):
    ev = events(spark, d)
    given = ev.where("id % 7 = 0").select("request_id", F.col("user_likes").alias("likes")).distinct().select("request_id", "likes", F.lit(False).alias("dislikes"), F.lit(3).alias("clicks"))
    return A.apply_feedback(ev, given).select("id", "user_likes", "user_dislikes", "citation_click_count")


@query(
    "asked_question_groups",
    f"""WITH {EVENTS} SELECT lower(trim(question)) AS question_key, count(*) AS n, count(*) FILTER (user_likes) AS likes, count(*) FILTER (user_dislikes) AS dislikes,
(list(id ORDER BY review_required DESC, created_at DESC, id DESC))[1] AS representative_id FROM ev GROUP BY 1""",
)
def asked_question_groups(spark, d):
    return A.asked_groups(events(spark, d))


@query(
    "latest_version_per_entry",
    """SELECT l_orderkey AS faq_entry_id, CAST(l_linenumber AS BIGINT) AS version, l_partkey AS answer FROM
(SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS n FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' AND o_orderstatus <> 'P') WHERE n = 1""",
)
def latest_version_per_entry(spark, d):
    """Lines may repeat a version's number, which the SQL's order leaves open: the first line as stored counts, as it does where the SQL reads in order."""
    lines, orders = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "orders"))
    stored = F.struct("_metadata.file_path", "_metadata.row_index")
    versions = lines.select(F.col("l_orderkey").alias("faq_entry_id"), F.col("l_linenumber").cast("long").alias("version"), (F.col("l_returnflag") != "R").alias("is_published"), F.col("l_partkey").alias("answer"), stored.alias("stored"))
    entries = orders.select(F.col("o_orderkey").alias("faq_entry_id"), (F.col("o_orderstatus") != "P").alias("is_active"))
    return G.current_faqs(entries, versions, F.asc("stored")).select("faq_entry_id", "version", "answer")


@query(
    "next_faq_version",
    """WITH v AS (SELECT l_orderkey AS e, max(l_linenumber) AS m FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1)
SELECT o_custkey AS faq_entry_id, o_orderkey AS draft_id, CAST(coalesce(v.m, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version,
CASE WHEN o_orderkey % 3 = 0 THEN 0.85 ELSE CAST(o_orderkey % 3 AS DOUBLE) / 4 END AS confidence FROM orders LEFT JOIN v ON o_custkey = v.e""",
)
def next_faq_version(spark, d):
    lines, orders = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "orders"))
    versions = lines.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("faq_entry_id"), F.col("l_linenumber").cast("long").alias("version"))
    drafts = orders.select(F.col("o_custkey").alias("faq_entry_id"), F.col("o_orderkey").alias("draft_id"), F.col("o_orderdate").alias("created_at"), ((F.col("o_orderkey") % 3) / 4.0).alias("confidence"))
    return G.next_versions(versions, drafts).select("faq_entry_id", "draft_id", "version", "confidence")


@query(
    "question_keywords",
    f"""WITH {EVENTS}, t AS (SELECT mode, id AS position, {tokens("question")} AS w FROM ev),
tok AS (SELECT mode, position, unnest(generate_series(1, len(w))) AS i, unnest(w) AS term, w FROM t),
pos AS (SELECT mode, 'token' AS kind, term, position, i FROM tok UNION ALL SELECT mode, 'bigram', w[i] || ' ' || w[i + 1], position, i FROM tok WHERE i < len(w)),
g AS (SELECT mode, kind, term, count(*) AS n, min(position * 1000 + i) AS f FROM pos GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY mode, kind ORDER BY n DESC, f) AS nth FROM g)
SELECT mode, kind, term, n, nth, CAST(0 AS DOUBLE) AS share FROM r WHERE nth <= 5 AND (kind = 'token' OR n >= 2)
UNION ALL SELECT t.mode, 'cohesion', '', 0, 0, round(avg(CASE WHEN list_has_any(t.w, (SELECT list(term) FROM r WHERE r.mode = t.mode AND kind = 'token' AND nth <= 3)) THEN 1.0 ELSE 0.0 END), 6) FROM t GROUP BY t.mode""",
)
def question_keywords(spark, d):
    ev = events(spark, d).withColumn("position", F.col("id"))
    return A.keyword_aggregation(ev, "mode", "question").withColumn("share", F.round("share", 6)).na.fill(0).na.fill("")


@query(
    "workflow_allowed_actions",
    f"""WITH {QUEUE} SELECT queue_item_id, status, CASE WHEN status = 'in_review' AND queue_item_id % 2 = 0 THEN 'approve,reject' WHEN status = 'approved' AND queue_item_id % 2 = 0 THEN 'revoke' WHEN status = 'approved' AND queue_item_id % 3 = 0 THEN 'publish' ELSE '' END AS actions FROM q""",
)
def workflow_allowed_actions(spark, d):
    n = F.col("queue_item_id")
    roles = F.when(n % 2 == 0, F.array(F.lit("reviewer"))).when(n % 3 == 0, F.array(F.lit("publisher"))).otherwise(F.array().cast("array<string>"))
    return G.allowed_actions(queue(spark, d).withColumn("roles", roles)).select("queue_item_id", "status", F.array_join("actions", ",").alias("actions"))


@query(
    "workflow_transitions",
    f"""WITH {QUEUE}, r AS (SELECT *, CASE queue_item_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'publish' WHEN 2 THEN 'request_changes' ELSE 'revoke' END AS action, queue_item_id % 5 AS role FROM q),
x AS (SELECT *, CASE WHEN action = 'approve' AND status = 'in_review' THEN 'approved' WHEN action = 'publish' AND status = 'approved' THEN 'published' WHEN action = 'revoke' AND status = 'approved' THEN 'revoked' END AS t FROM r)
SELECT queue_item_id, action, CASE WHEN t IS NULL THEN 'not_allowed' WHEN role = 0 OR (role = 1 AND action <> 'publish') THEN 'ok' ELSE 'forbidden' END AS outcome,
CASE WHEN t IS NOT NULL AND (role = 0 OR (role = 1 AND action <> 'publish')) THEN t ELSE status END AS new_status FROM x""",
)
def workflow_transitions(spark, d):
    n = F.col("queue_item_id")
    action = F.when(n % 4 == 0, "approve").when(n % 4 == 1, "publish").when(n % 4 == 2, "request_changes").otherwise("revoke")
    roles = F.when(n % 5 == 0, F.array(F.lit("admin"))).when(n % 5 == 1, F.array(F.lit("reviewer"))).otherwise(F.array(F.lit("viewer")))
    asked = queue(spark, d).withColumns({"action": action, "roles": roles})
    return G.apply_transitions(asked).select("queue_item_id", "action", "outcome", "new_status")


@query(
    "windowed_questions",
    f"""WITH {EVENTS} SELECT date_trunc('hour', created_at) AS window_start, lower({squeezed("question")}) AS normalized_question, count(*) AS ask_count, bool_or(review_required OR abstained) AS unresolved FROM ev GROUP BY 1, 2""",
)
def windowed_questions(spark, d):
    return S.windowed_questions(events(spark, d))


@query("semantic_clusters")
def semantic_clusters(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    ev = events(spark, d).select("id", "question", F.col("created_at").cast("timestamp").alias("created_at")).join(vectors, "id")
    members = A.leader_clusters(ev, threshold=0.3, newest=500)
    return A.cluster_rollup(members, ev, 2)

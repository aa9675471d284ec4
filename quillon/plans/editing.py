"""Queries on spelling, publication and benchmark runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import publication as P
from quillon.operators import retrieval as R
from quillon.operators import rules as U
from quillon.operators import runners as N
from quillon.operators import spelling as S
from quillon.plans.frames import BENCHMARK, CHUNKS, QUESTIONS, QUEUE, benchmark, chunks, questions, queue, read, squeezed, tokens
from quillon.session import cut

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- spelling -----------------------------------------------------------------------------------------------------

# Distances count bytes in SQL, so letters beyond ASCII stand as single capitals there; the words are in lower case.
_BYTES = "translate({}, 'áäçèéêíñóöúüß', 'ABCDEFGHIJKLM')"


@query(
    "spelling_corrections",
    rf"""WITH {QUESTIONS}, lex AS MATERIALIZED (SELECT lang, word, count(*) AS n FROM (SELECT coalesce(lang, '') AS lang, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+'))) AS word FROM documents) GROUP BY ALL HAVING count(*) >= 5),
sp AS (SELECT question_id, question, string_split({squeezed('question')}, ' ') AS tokens FROM qu),
pl AS (SELECT question_id, place, token, regexp_replace(token, '^[.,;:!?"'']+|[.,;:!?"'']+$', '', 'g') AS clean FROM (SELECT question_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM sp)),
la AS (SELECT question_id, lang FROM (SELECT question_id, lang, count(*) AS n FROM pl JOIN lex ON lex.word = lower(clean) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, lang) = 1),
ow AS MATERIALIZED (SELECT question_id, lang, place, token, clean, lower(clean) AS word FROM pl JOIN la USING (question_id) WHERE regexp_matches(clean, '^\p{{L}}+$') AND NOT regexp_matches(clean, '^[\p{{Lu}}\p{{Lt}}]')),
un AS MATERIALIZED (SELECT DISTINCT lang, word FROM ow ANTI JOIN lex USING (lang, word)),
ca AS (SELECT un.lang, un.word, lex.word AS correction, n, damerau_levenshtein({_BYTES.format('un.word')}, {_BYTES.format('lex.word')}) AS d FROM un JOIN lex ON un.lang = lex.lang AND abs(length(un.word) - length(lex.word)) <= 2),
co AS (SELECT lang, word, correction FROM ca WHERE d <= 2 QUALIFY row_number() OVER (PARTITION BY lang, word ORDER BY d, n DESC, correction) = 1),
fx AS (SELECT question_id, place, replace(token, clean, correction) AS token FROM ow JOIN co USING (lang, word)),
re AS (SELECT question_id, string_agg(coalesce(fx.token, pl.token), ' ' ORDER BY place) AS corrected, count(fx.token) AS changes FROM pl LEFT JOIN fx USING (question_id, place) GROUP BY 1)
SELECT question_id, CASE WHEN changes > 0 THEN corrected ELSE question END AS corrected, changes FROM qu JOIN re USING (question_id)""",
)
def spelling_corrections(spark, d):
    """What users said, with misspelt words corrected by the words of at least five documents of its language."""
    return S.corrected(questions(spark, d), S.lexicon(read(spark, d, "documents"))).select("question_id", "corrected", "changes")


# ---- workflow and publication -------------------------------------------------------------------------------------

_LONG = " alpha bravo charlie delta echoes foxtrot golf hotel india juliet kilo lima mike november please oscar"

_OUTCOMES = f"""{QUEUE}, me AS (SELECT c_custkey AS event_id, CASE c_custkey % 3 WHEN 0 THEN 'What is ' || c_mktsegment || '?' WHEN 1 THEN ' Where: ' || c_mktsegment ELSE c_mktsegment || '{_LONG}' END AS question,
CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS answer, CASE WHEN c_custkey % 2 = 0 THEN ['SIRI ', 'NeTEx', '', 'SIRI'] END AS standards_scope, CASE WHEN c_custkey % 11 = 0 THEN 'faq-' || (c_custkey % 10) END AS matched,
CASE WHEN c_custkey % 4 < 2 THEN 'nits:unknown-concept' ELSE 'netex:' || c_mktsegment END AS core_concept, CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_custkey % 5 > 0 THEN 0.5 END AS confidence FROM customer),
rq AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_id, l_orderkey AS item, ['revoke', 'approve', 'publish', 'reject', 'reopen', 'publish', 'request_changes'][l_linenumber % 7 + 1] AS action,
[['reviewer'], ['publisher'], ['editor', 'reviewer'], ['admin']][l_suppkey % 4 + 1] AS roles, l_shipdate AS requested_at FROM lineitem),
ru(action, from_status, to_status, may) AS (VALUES ('approve', 'in_review', 'approved', ['reviewer', 'admin']), ('reject', 'in_review', 'rejected', ['reviewer', 'admin']), ('reopen', 'rejected', 'in_review', ['editor', 'reviewer', 'admin']),
('publish', 'approved', 'published', ['publisher', 'admin']), ('revoke', 'approved', 'revoked', ['reviewer', 'admin'])),
nt AS MATERIALIZED (SELECT rq.*, coalesce(trim(question) <> '' AND trim(answer) <> '', false) AS complete, q.status AS initial, row_number() OVER (PARTITION BY item ORDER BY requested_at, request_id) AS nth FROM rq LEFT JOIN q ON item = queue_item_id LEFT JOIN me USING (event_id)),
st AS (SELECT DISTINCT item, CAST(0 AS BIGINT) AS nth, initial AS status FROM nt WHERE initial IS NOT NULL UNION ALL
SELECT nt.item, nt.nth, CASE WHEN list_has_any(roles, may) AND (to_status <> 'published' OR complete) THEN to_status ELSE status END FROM st JOIN nt ON nt.item = st.item AND nt.nth = st.nth + 1 LEFT JOIN ru ON ru.action = nt.action AND from_status = status),
oc AS (SELECT request_id, nt.item, requested_at, status AS from_status, CASE WHEN initial IS NULL THEN 'unknown_item' WHEN to_status IS NULL THEN 'not_allowed' WHEN NOT list_has_any(roles, may) THEN 'forbidden' WHEN to_status = 'published' AND NOT complete THEN 'incomplete' ELSE 'ok' END AS outcome, to_status AS target
FROM nt LEFT JOIN st ON nt.item = st.item AND st.nth = nt.nth - 1 LEFT JOIN ru ON ru.action = nt.action AND ru.from_status = status)"""

_DRAFTS = f"""WITH RECURSIVE {_OUTCOMES},
dr AS (SELECT request_id AS draft_id, requested_at, item, event_id, trim(question) AS question, trim(answer) AS answer, CASE WHEN standards_scope IS NULL THEN CAST([] AS VARCHAR[]) ELSE ['SIRI', 'NeTEx'] END AS scope, matched, confidence,
CASE event_id % 3 WHEN 0 THEN 'definition' WHEN 1 THEN 'location' ELSE 'unknown' END || ' ' || core_concept AS known FROM oc JOIN q ON item = queue_item_id JOIN me USING (event_id) WHERE outcome = 'ok' AND target = 'published'),
di AS (SELECT *, CASE WHEN known = 'unknown nits:unknown-concept' THEN left(lower(question), 512) ELSE known END AS normalized_intent FROM dr),
de AS (SELECT *, coalesce(matched, 'faq-auto-' || left(sha1(normalized_intent || '|' || array_to_string(list_sort(scope), '|')), 12)) AS faq_entry_id FROM di)"""


def _editorial(spark, d):
    """Customers as events, orders as queue items, order lines as requests: (items, events, outcomes)."""
    n, segment, name = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_name")
    question = F.when(n % 3 == 0, F.concat(F.lit("What is "), segment, F.lit("?"))).when(n % 3 == 1, F.concat(F.lit(" Where: "), segment)).otherwise(F.concat(segment, F.lit(_LONG)))
    events = read(spark, d, "customer").select(
        n.alias("event_id"), question.alias("question"), F.when(n % 7 == 0, " ").otherwise(name).alias("answer"), F.when(n % 2 == 0, F.array(*map(F.lit, ("SIRI ", "NeTEx", "", "SIRI")))).alias("standards_scope"),
        F.when(n % 11 == 0, F.concat(F.lit("faq-"), (n % 10).cast("string"))).alias("matched_faq_entry_id"), F.when(n % 4 < 2, "nits:unknown-concept").otherwise(F.concat(F.lit("netex:"), segment)).alias("core_concept"),
        F.when(F.col("c_acctbal") < 0, 0.0).when(n % 5 > 0, 0.5).alias("confidence"),
    )
    pick = lambda values, at: F.element_at(F.array(*values), (at + 1).cast("int"))
    actions = [F.lit(a) for a in ("revoke", "approve", "publish", "reject", "reopen", "publish", "request_changes")]
    roles = [F.array(*map(F.lit, r)) for r in (("reviewer",), ("publisher",), ("editor", "reviewer"), ("admin",))]
    key = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    requests = read(spark, d, "lineitem").select(key.alias("request_id"), F.col("l_orderkey").alias("queue_item_id"), pick(actions, F.col("l_linenumber") % 7).alias("action"), pick(roles, F.col("l_suppkey") % 4).alias("roles"), F.col("l_shipdate").alias("requested_at"))
    items = queue(spark, d).select("queue_item_id", "event_id", "status")
    ready = items.join(events.select("event_id", P.complete(F.col("question"), F.col("answer")).alias("complete")), "event_id", "left")
    return items, events, P.transitioned(ready, requests)


def _drafts(spark, d):
    items, events, outcomes = _editorial(spark, d)
    return P.drafts(cut(outcomes), items, events)


@query(
    "editorial_outcomes",
    f"""WITH RECURSIVE {_OUTCOMES} SELECT request_id, from_status, CASE WHEN outcome = 'ok' THEN target END AS to_status, outcome FROM oc""",
)
def editorial_outcomes(spark, d):
    """Every request with its outcome, each on the status that the item's earlier ones left."""
    return _editorial(spark, d)[2].select("request_id", "from_status", "to_status", "outcome")


@query(
    "faq_entries_published",
    f"""{_DRAFTS}, te AS (SELECT *, list_filter(regexp_split_to_array(question, '[^A-Za-z0-9]+'), lambda t: length(t) >= 4) AS w FROM de),
tk AS (SELECT *, w[1:12] AS terms, list_filter(list_transform(w, lambda t: lower(t)), lambda t: t NOT IN ('what', 'where', 'please') AND NOT list_contains(list_transform(w[1:12], lambda x: lower(x)), t)) AS more FROM te)
SELECT faq_entry_id, normalized_intent, array_to_string(scope, ',') AS standards_scope, array_to_string(list_concat(terms, more[1:greatest(12 - len(terms), 1)]), ',') AS keyword_tokens, true AS is_active
FROM tk QUALIFY row_number() OVER (PARTITION BY faq_entry_id ORDER BY requested_at DESC, draft_id DESC) = 1""",
)
def faq_entries_published(spark, d):
    rows = P.entries_of(_drafts(spark, d))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("standards_scope", "keyword_tokens")})


@query(
    "faq_versions_published",
    f"""{_DRAFTS}, ve AS (SELECT 'faq-' || (s_suppkey % 10) AS faq_entry_id, max(s_suppkey // 10 + 1) AS last FROM supplier GROUP BY 1), li AS (SELECT p_partkey % 700 AS event_id, count(*) AS citations FROM part GROUP BY 1)
SELECT faq_entry_id, coalesce(last, 0) + row_number() OVER (PARTITION BY faq_entry_id ORDER BY requested_at, draft_id) AS version, answer, coalesce(citations, 0) AS citations, CASE WHEN coalesce(confidence, 0) = 0 THEN 0.85 ELSE confidence END AS confidence
FROM de LEFT JOIN ve USING (faq_entry_id) LEFT JOIN li USING (event_id)""",
)
def faq_versions_published(spark, d):
    n = F.col("s_suppkey")
    held = read(spark, d, "supplier").select(F.concat(F.lit("faq-"), (n % 10).cast("string")).alias("faq_entry_id"), F.floor(n / 10 + 1).alias("version"))
    key = F.col("p_partkey").cast("string")
    links = read(spark, d, "part").select(
        (F.col("p_partkey") % 700).alias("event_id"), F.lit("2026-01-01").alias("created_at"), key.alias("link_id"), F.lit("https://example.org/r").alias("repository_url"), F.lit("main").alias("commit_sha"),
        F.concat(F.lit("docs/"), key).alias("source_path"), key.alias("chunk_id"), F.col("p_name").alias("label"),
    )
    rows = P.versions_of(_drafts(spark, d), held, links)
    return rows.select("faq_entry_id", "version", "answer", F.size("citations").cast("long").alias("citations"), "confidence")


# ---- benchmark runs -----------------------------------------------------------------------------------------------


def _run(spark, d):
    """Ten questions of each intent, and two ids that aren't there, by their overlap with all chunks."""
    n = F.col("question_id")
    intent = F.element_at(F.array(*map(F.lit, ("definition", "location", "comparison", "unknown"))), (n % 4 + 1).cast("int"))
    patterns = F.array(F.concat(F.lit("/"), (n % 40).cast("string"), F.lit(".md")), F.lit("README"))
    asked = benchmark(spark, d).select("question_id", "question", intent.alias("intent"), patterns.alias("patterns"), F.lit(1).alias("min_hits"))
    missing = spark.range(1, 3).select((-F.col("id")).alias("question_id"), F.lit("unknown").alias("intent"))
    body = chunks(spark, d)

    def answer(batch):
        pairs = R.overlap_pairs(batch, body).withColumn("overlap", F.round("overlap", 9))
        return R.top_k(pairs, 10, F.desc("overlap"), F.asc("chunk_id")).join(body.select("chunk_id", "source_path"), "chunk_id")

    return N.run(N.stratified(asked, 10).unionByName(missing), asked, answer).results


@query(
    "canary_run",
    f"""WITH {BENCHMARK}, {CHUNKS}, w AS (SELECT *, ['definition', 'location', 'comparison', 'unknown'][question_id % 4 + 1] AS intent FROM b QUALIFY row_number() OVER (PARTITION BY question_id % 4 ORDER BY sha256(CAST(question_id AS VARCHAR)), question_id) <= 10),
a AS (SELECT question_id, list_distinct({tokens("question")}) AS t FROM w), q AS (SELECT question_id, len(t) AS n, unnest(t) AS t FROM a), h AS (SELECT chunk_id, unnest(list_distinct({tokens("text")})) AS t FROM c),
s AS (SELECT question_id, chunk_id, round(CAST(count(*) AS DOUBLE) / max(n), 9) AS overlap FROM q JOIN h ON q.t = h.t GROUP BY ALL),
k AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, chunk_id) AS nth FROM s QUALIFY nth <= 10),
m AS (SELECT question_id, nth, contains(source_path, '/' || (question_id % 40) || '.md') OR contains(source_path, 'README') AS hit FROM k JOIN c USING (chunk_id)),
g AS (SELECT question_id, count(*) AS chunks, bool_or(hit AND nth <= 5) AS hit_at_5, round(coalesce(1.0 / min(nth) FILTER (hit), 0.0), 9) AS mrr_at_10 FROM m GROUP BY 1)
SELECT question_id, intent, coalesce(chunks, 0) AS chunks, coalesce(hit_at_5, false) AS hit_at_5, coalesce(mrr_at_10, 0.0) AS mrr_at_10, NULL AS error FROM w LEFT JOIN g USING (question_id)
UNION ALL SELECT unnest([-1, -2]), 'unknown', 0, NULL, NULL, 'not found'""",
)
def canary_run(spark, d):
    return _run(spark, d).select("question_id", "intent", "chunks", "hit_at_5", F.round("mrr_at_10", 9).alias("mrr_at_10"), "error")


@query("canary_gates")
def canary_gates(spark, d):
    """Gates of a stratified run against itself as the baseline: latencies pass, the missing questions break the gate on errors."""
    results = _run(spark, d)
    return N.judged(results, "stratified", results)


# ---- rules and graph scores ---------------------------------------------------------------------------------------


@query(
    "evaluated_rules",
    f"""WITH {BENCHMARK}, {CHUNKS}, a AS (SELECT question_id, list_distinct({tokens("question")}) AS t FROM b), qt AS (SELECT question_id, len(t) AS n, unnest(t) AS t FROM a), ht AS (SELECT chunk_id, unnest(list_distinct({tokens("text")})) AS t FROM c),
sc AS (SELECT question_id, chunk_id, round(CAST(count(*) AS DOUBLE) / max(n), 9) AS overlap FROM qt JOIN ht ON qt.t = ht.t GROUP BY ALL),
k AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, chunk_id) AS nth FROM sc QUALIFY nth <= 8),
h AS (SELECT question_id, nth, source_path, standards_scope[1] AS standard, chunk_type = 'schema_fragment' AS is_schema, chunk_type = 'schema_fragment' AND chunk_id % 2 = 0 AS bound, chunk_id % 40 = 0 AS anchor FROM k JOIN c USING (chunk_id)),
f AS (SELECT question_id, bool_or(is_schema) AS has_schema, bool_or(anchor) AS anchored, list_sort(list(DISTINCT standard) FILTER (standard <> '')) AS seen FROM h GROUP BY 1),
ar AS (SELECT question_id, string_agg(source_path, ',' ORDER BY nth) AS artifacts FROM (SELECT * FROM h WHERE bound QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY nth) <= 3) GROUP BY 1),
x AS (SELECT b.question_id, CASE WHEN b.question_id % 4 = 0 THEN ['en'] ELSE [] END AS scope, CASE WHEN len(coalesce(seen, [])) > 0 THEN seen WHEN b.question_id % 4 = 0 THEN ['en'] ELSE [] END AS seen, coalesce(has_schema, false) AS has_schema, coalesce(anchored, false) AS anchored, artifacts FROM b LEFT JOIN f USING (question_id) LEFT JOIN ar USING (question_id)),
r(id, standard, requires_rule) AS (VALUES ('CQ-EN-STOP-01', 'en', true), ('CQ-FR-RT-01', 'fr', false), ('CQ-DE-ROLE-01', 'de', false), ('CQ-SVC-02', '', true)),
m AS (SELECT question_id, string_agg(id, ',' ORDER BY id) AS ids, count(*) FILTER (requires_rule) AS requires FROM x, r WHERE (standard = '' OR len(CASE WHEN len(scope) > 0 THEN scope ELSE seen END) = 0 OR list_contains(CASE WHEN len(scope) > 0 THEN scope ELSE seen END, standard))
AND (NOT requires_rule OR question_id % 3 = 0) AND (NOT contains(id, 'STOP') OR question_id % 2 = 0) AND (NOT contains(id, 'SVC') OR question_id % 5 = 0) AND (NOT contains(id, 'ROLE') OR question_id % 3 > 0) GROUP BY 1),
y AS (SELECT *, question_id % 3 = 1 AND len(seen) > 1 AS crossed FROM x LEFT JOIN m USING (question_id))
SELECT question_id, 'schema_evidence_present' AS rule_id, has_schema AS matched, CASE WHEN has_schema THEN 'SCHEMA_EVIDENCE_PRESENT' END AS kind, NULL AS standards, NULL AS competency_ids, CAST(NULL AS BIGINT) AS requires_rule_count, NULL AS artifacts FROM y
UNION ALL SELECT question_id, 'mandatory_schema_constraint', artifacts IS NOT NULL, CASE WHEN artifacts IS NOT NULL THEN 'MANDATORY_SCHEMA_CONSTRAINT' END, NULL, NULL, NULL, artifacts FROM y WHERE question_id % 3 = 0
UNION ALL SELECT question_id, 'competency_questions_matched', ids IS NOT NULL, CASE WHEN ids IS NOT NULL THEN 'COMPETENCY_QUESTION_MATCH' END, NULL, ids, requires, NULL FROM y
UNION ALL SELECT question_id, 'cross_standard_review', crossed, CASE WHEN crossed THEN 'CROSS_STANDARD_REVIEW_RECOMMENDED' END, CASE WHEN crossed THEN array_to_string(seen, ',') END, NULL, NULL, NULL FROM y
UNION ALL SELECT question_id, 'ontology_anchor_present', anchored, CASE WHEN anchored THEN 'ONTOLOGY_ANCHOR_PRESENT' END, NULL, NULL, NULL, NULL FROM y""",
)
def evaluated_rules(spark, d):
    """Rules over the eight chunks that overlap most with each benchmark question."""
    n, i = F.col("chunk_id"), F.col("question_id")
    none = F.array().cast("array<string>")
    body = chunks(spark, d)
    pairs = R.overlap_pairs(benchmark(spark, d), body).withColumn("overlap", F.round("overlap", 9))
    found = R.top_k(pairs, 8, F.desc("overlap"), F.asc("chunk_id")).join(body, "chunk_id").select(
        "question_id", "nth", "source_path", "heading", "standards_scope", F.when(F.col("chunk_type") == "schema_fragment", "schema").otherwise("guide").alias("doc_type"),
        F.when(n % 2 == 0, F.array(F.lit("x"))).otherwise(none).alias("required_children"), none.alias("required_attributes"), F.when(n % 40 == 0, F.array(F.lit("c"))).otherwise(none).alias("concepts"),
    )
    word = F.when(i % 3 == 0, "shall ").when(i % 3 == 1, "compare ").otherwise("define: define ")
    terms = F.array_compact(F.array(F.when(i % 2 == 0, "stop"), F.when(i % 5 == 0, "timetable")))
    asked = benchmark(spark, d).select("question_id", F.concat(word, F.col("question")).alias("question"), F.when(i % 4 == 0, F.array(F.lit("en"))).otherwise(none).alias("scope"), terms.alias("terms"))
    rows = (("CQ-EN-STOP-01", "en", True), ("CQ-FR-RT-01", "fr", False), ("CQ-DE-ROLE-01", "de", False), ("CQ-SVC-02", "", True))
    registry = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("id"), F.lit(b).alias("standard"), F.lit(c).alias("requires_rule"), F.lit("").alias("rule_id")) for a, b, c in rows))).alias("r")).select("r.*")
    out = U.evaluated(cut(found), asked, registry)
    joined = {c: F.array_join(c, ",") for c in ("standards", "competency_ids")}
    return out.withColumns({**joined, "artifacts": F.array_join(F.transform("artifacts", lambda a: a["source_path"]), ",")})


@query(
    "graph_adjusted_scores",
    f"""WITH {CHUNKS}, k AS (SELECT chunk_id, starts_with(source_path, 'examples/') AS example, chunk_id % 3 = 0 AS direct, chunk_id % 3 = 1 OR chunk_id % 5 = 0 AS wider, chunk_id % 4 = 0 AS seeking FROM c)
SELECT chunk_id, CASE WHEN direct THEN 0.2 + CASE WHEN seeking AND example THEN 0.06 ELSE 0 END WHEN wider THEN 0.1 + CASE WHEN example THEN 0.08 ELSE 0 END ELSE 0 END :: DOUBLE AS adjustment FROM k""",
)
def graph_adjusted_scores(spark, d):
    """Every chunk against a question that shares a concept with it directly, by its expansion, by a general concept alone, or not at all."""
    n = F.col("chunk_id")
    held = F.array_compact(F.array(F.when(n % 3 == 0, "netex:Line"), F.when((n % 3 == 1) | (n % 5 == 0), "siri:Call"), F.when(n % 7 == 0, "transmodel:when")))
    asked, expanded = F.array(F.lit("netex:Line"), F.lit("transmodel:when")), F.array(F.lit("netex:Line"), F.lit("siri:Call"), F.lit("transmodel:when"))
    hints = F.when(n % 4 == 0, F.array(F.lit("example"))).otherwise(F.array(F.lit("schema")))
    return chunks(spark, d).select("chunk_id", F.round(R.graph_adjustment(held, asked, expanded, hints, F.col("source_path")), 9).alias("adjustment"))

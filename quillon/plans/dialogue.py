"""Queries on candidates of questions, prompts, controller decisions, the queue and names, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import dialogue as D
from quillon.functions import text as T
from quillon.operators import candidates as C
from quillon.operators import governance as G
from quillon.operators import graph as K
from quillon.operators import indexing as I
from quillon.operators import ontology as O
from quillon.plans.frames import BENCHMARK, CHUNKS, EVENTS, QUEUE, benchmark, chunks, events, queue, read, squeezed, tokens

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- candidates ---------------------------------------------------------------------------------------------------

_PLAIN = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(
    "path_hint_candidates",
    f"""WITH {CHUNKS}, q AS (SELECT s_suppkey AS question_id, 'readme.' || (s_suppkey % 45) || '.xml' AS hint, CASE WHEN s_suppkey % 3 = 0 THEN ['en'] ELSE [] END AS scope FROM supplier)
SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY chunk_id) AS nth FROM q JOIN c ON contains(lower(source_path), hint) AND (len(scope) = 0 OR list_has_any(scope, standards_scope)) QUALIFY nth <= 15""",
)
def path_hint_candidates(spark, d):
    n = F.col("s_suppkey")
    scope = F.when(n % 3 == 0, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>"))
    asked = read(spark, d, "supplier").select(n.alias("question_id"), F.concat(F.lit("Where is ReadMe."), (n % 45).cast("string"), F.lit(".xml?")).alias("question"), scope.alias("scope"))
    return C.path_hint_candidates(asked, chunks(spark, d), 5)


@query(
    "graph_candidates",
    f"""WITH {CHUNKS}, {BENCHMARK}, t AS (SELECT question_id, question, {_PLAIN.format("question")} AS t FROM b),
k AS (SELECT question_id AS concept, unnest([t[1], t[2] || ' ' || t[3], t[3] || ' ' || t[5]]) AS alias FROM t WHERE len(t) > 4),
g AS (SELECT DISTINCT t.question_id, question, alias FROM t JOIN k ON concept IN (t.question_id, t.question_id + 1) WHERE length(alias) >= 3),
f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY len(list_intersect(list_distinct(list_filter({_PLAIN.format("question")}, lambda x: length(x) > 2)), list_filter({_PLAIN.format("alias")}, lambda x: length(x) > 2))) DESC, least(length(alias), 120) DESC, alias) AS r FROM g),
s AS (SELECT question_id, question, alias FROM f WHERE r <= 30),
e AS (SELECT *, CASE WHEN chunk_id % 8 = 0 THEN 'example' ELSE 'schema' END AS kind, lower(source_path) AS p, lower(label) AS l, lower(heading) AS h, lower(text) AS x, {_PLAIN.format("source_path")} AS pt, {_PLAIN.format("label")} AS lt, {_PLAIN.format("heading")} AS ht, {_PLAIN.format("text")} AS xt FROM c WHERE chunk_id % 8 = 0 OR chunk_id % 9 = 0),
a AS (SELECT question_id, chunk_id, quality_score, bool_or(contains(p, alias) OR contains(l, alias)) AS fast, bool_or(contains(x, alias)) AS slow FROM s, e GROUP BY ALL),
n AS (SELECT *, count(*) FILTER (fast) OVER (PARTITION BY question_id) AS got FROM a),
w AS (SELECT *, row_number() OVER (PARTITION BY question_id, NOT fast AND slow ORDER BY quality_score DESC, chunk_id) AS o FROM n),
z AS (SELECT question_id, chunk_id FROM w WHERE fast OR (slow AND got < 10 AND o <= least(greatest(2 * (10 - got), 10), 20))),
m AS (SELECT question_id, question, chunk_id, quality_score, kind, p, l, h, x, max(CASE WHEN contains(p, alias) OR list_has_all(pt, {_PLAIN.format("alias")}) THEN 1.10 WHEN contains(l, alias) OR list_has_all(lt, {_PLAIN.format("alias")}) THEN 0.85 WHEN contains(h, alias) OR list_has_all(ht, {_PLAIN.format("alias")}) THEN 0.75 WHEN contains(x, alias) OR list_has_all(xt, {_PLAIN.format("alias")}) THEN 0.40 ELSE -1 END
 + least(0.75, len({_PLAIN.format("alias")}) * 0.12 + least(length(alias), 24) * 0.01)) AS best FROM z JOIN s USING (question_id) JOIN e USING (chunk_id) GROUP BY ALL),
y AS (SELECT question_id, chunk_id, quality_score, list_distinct({tokens("question")}) AS q, {tokens("p || chr(10) || l || chr(10) || h || chr(10) || x")} AS held, CAST(best AS DOUBLE) + CASE WHEN p LIKE 'examples/%' THEN 0.15 ELSE 0 END AS base FROM m),
v AS (SELECT question_id, chunk_id, quality_score, round(CAST(base + 0.75 * CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, held)) / len(q) END AS DOUBLE), 6) AS rank FROM y)
SELECT question_id, chunk_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY rank DESC, quality_score DESC, chunk_id DESC) AS nth FROM v QUALIFY nth <= 10""",
)
def graph_candidates(spark, d):
    """Items as questions, each asking for two concepts whose aliases are words of items."""
    q = benchmark(spark, d)
    t = F.col("t")
    names = q.select(F.col("question_id").alias("concept_id"), T.plain_tokens("question").alias("t")).where(F.size("t") > 4)
    names = names.select("concept_id", F.explode(F.array(t[0], F.concat_ws(" ", t[1], t[2]), F.concat_ws(" ", t[2], t[4]))).alias("alias"))
    concepts = q.select("question_id", F.explode(F.array(F.col("question_id"), F.col("question_id") + 1)).alias("concept_id"))
    asked = q.withColumn("scope", F.array().cast("array<string>"))
    kind = F.when(F.col("chunk_id") % 8 == 0, "example").when(F.col("chunk_id") % 9 == 0, "schema").otherwise("guide")
    own = chunks(spark, d).withColumn("doc_type", kind)
    return C.graph_candidates(asked, C.chosen_aliases(q, concepts, names, 5), own, 5)


# ---- questions, prompts, controller -------------------------------------------------------------------------------


@query(
    "normalized_questions",
    f"SELECT conv_id, turn, {squeezed('text')} || ' No. 1/2 fi' AS question FROM conversations",
)
def normalized_questions(spark, d):
    wide = F.concat(F.lit("  　"), T.text("text"), F.lit(" № １/２\tﬁ "))
    return read(spark, d, "conversations").select("conv_id", "turn", F.replace(D.normalized(wide), F.lit("No 1"), F.lit("No. 1")).alias("question"))


@query(
    "answer_prompts",
    f"""WITH {CHUNKS}, r AS (SELECT *, chunk_id // 6 AS question_id, chunk_id % 6 + 1 AS nth FROM c),
l AS (SELECT question_id, nth, '[E' || nth || '] repository=' || repository_url || chr(10) || '[E' || nth || '] commit=' || chr(10) || '[E' || nth || '] source=' || source_path || chr(10) || '[E' || nth || '] chunk=' || chunk_id || chr(10) || '[E' || nth || '] text='
 || CASE WHEN length(coalesce(text, '')) <= 1800 THEN coalesce(text, '') ELSE regexp_replace(left(text, 1800), '\\s+$', '') || chr(10) || '...[truncated for latency]' END AS b FROM r)
SELECT question_id, sha256('Question:' || chr(10) || 'q' || question_id || chr(10) || chr(10) || 'Requested scope: ' || CASE WHEN question_id % 2 = 0 THEN 'A, B' ELSE 'all approved standards' END || chr(10) || chr(10) || 'Evidence blocks:' || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY nth)) AS prompt_sha256 FROM l GROUP BY question_id""",
)
def answer_prompts(spark, d):
    n = F.col("chunk_id")
    block = D.evidence_block(n % 6 + 1, F.col("repository_url"), F.lit(None).cast("string"), F.col("source_path"), n, F.col("text"))
    held = chunks(spark, d).select(F.floor(n / 6).alias("question_id"), F.struct((n % 6).alias("i"), block.alias("b")).alias("s")).groupBy("question_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    q = F.col("question_id")
    scope = F.when(q % 2 == 0, F.array(F.lit("A"), F.lit("B")))
    return held.select("question_id", F.sha2(D.user_prompt(F.concat(F.lit("q"), q.cast("string")), scope, F.transform("s", lambda s: s["b"])), 256).alias("prompt_sha256"))


@query(
    "controller_decisions",
    f"""WITH {EVENTS}, x AS (SELECT id, CAST(id % 7 AS INTEGER) AS m, id % 300 AS c FROM ev) SELECT id,
CASE m WHEN 1 THEN 'faq' WHEN 2 THEN 'rag' WHEN 3 THEN 'rag' WHEN 5 THEN 'rag' END AS route, CASE WHEN m IN (1, 2) THEN 'definition' WHEN m IN (3, 5) THEN 'unknown' END AS intent,
CASE WHEN m IN (1, 2, 3) THEN least(CAST(c AS DOUBLE) / 100, 1) WHEN m = 5 THEN 0.5 END AS confidence, CASE m WHEN 0 THEN 'payload' WHEN 4 THEN 'route' WHEN 6 THEN 'confidence' END AS error FROM x""",
)
def controller_decisions(spark, d):
    n = F.col("id")
    share = (n % 300 / 100).cast("string")
    said = F.array(
        F.lit('loading {"route": "faq"} done'),
        F.concat(F.lit('{"route": "rag", "confidence": 0.1} then {"route": " FAQ ", "intent": "definition", "confidence": '), share, F.lit("}")),
        F.concat(F.lit('log {x} {"route": "rag", "intent": "definition", "confidence": "'), share, F.lit('"} end')),
        F.concat(F.lit('{"route": "faq|rag", "confidence": '), share, F.lit("}")),
        F.lit('{"route": "chat", "confidence": 1}'),
        F.lit('{"route": "use rag", "intent": " ", "confidence": 0.5} {"route": "faq", "confidence": broken}'),
        F.lit('{"route": "faq", "confidence": "high"}'),
    )
    out = D.decision(D.payload(F.element_at(said, (n % 7 + 1).cast("int"))))
    return events(spark, d).select("id", out.alias("o")).select("id", "o.*")


# ---- concepts -----------------------------------------------------------------------------------------------------

_CORE = "example.org/core"
_TRIPLES = """p AS (SELECT p_partkey AS n FROM part), tr AS (SELECT 'https://netex.org.uk/v#P' || n AS s, 'Part ' || n AS l, 'https://example.org/core#Core' || (n % 97) AS core FROM p WHERE n % 3 = 0
UNION ALL SELECT 'https://www.siri.org.uk/v#P' || n, 'Part ' || n, 'https://example.org/core#Core' || (n % 97) FROM p WHERE n % 3 = 1 UNION ALL SELECT 'https://example.org/x#P' || n, 'Part ' || n, 'https://example.org/core#Core' || (n % 97) FROM p WHERE n % 3 = 2)"""


def _triples(spark, d):
    """Parts as concepts of two standards and others; each is aligned with a core concept, every fifth from the core's side."""
    n = F.col("p_partkey")
    at = lambda s: F.concat(F.lit(s), n.cast("string"))
    s = F.when(n % 3 == 0, at("https://netex.org.uk/v#P")).when(n % 3 == 1, at("https://www.siri.org.uk/v#P")).otherwise(at("https://example.org/x#P"))
    core = F.concat(F.lit("https://example.org/core#Core"), (n % 97).cast("string"))
    near = F.when(n % 2 == 0, "http://www.w3.org/2004/02/skos/core#closeMatch").otherwise("http://www.w3.org/2000/01/rdf-schema#subClassOf")
    label = F.struct(s.alias("s"), F.lit("http://www.w3.org/2004/02/skos/core#prefLabel").alias("p"), at("Part ").alias("o"), F.lit("literal").alias("o_kind"))
    link = F.struct(F.when(n % 5 == 0, core).otherwise(s).alias("s"), near.alias("p"), F.when(n % 5 == 0, s).otherwise(core).alias("o"), F.lit("iri").alias("o_kind"))
    kind = F.struct(core.alias("s"), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type").alias("p"), F.lit("http://www.w3.org/2002/07/owl#Class").alias("o"), F.lit("iri").alias("o_kind"))
    return read(spark, d, "part").select(F.explode(F.array(label, link, kind)).alias("t")).select("t.*")


@query(
    "anchored_terms",
    f"WITH {_TRIPLES}, s AS (SELECT s_suppkey AS question_id, 'part ' || (s_suppkey * 2) AS term FROM supplier) SELECT DISTINCT question_id, core FROM s JOIN tr ON lower(l) = term",
)
def anchored_terms(spark, d):
    n = F.col("s_suppkey")
    return K.anchored(read(spark, d, "supplier").select(n.alias("question_id"), F.concat(F.lit("PART "), (n * 2).cast("string")).alias("term")), _triples(spark, d))


@query(
    "discovered_standards",
    f"""WITH {_TRIPLES}, k AS (SELECT 'core-' || n_nationkey AS slug, 'https://example.org/core#Core' || n_nationkey AS core FROM nation), e AS (SELECT DISTINCT core, CASE WHEN contains(s, 'netex.org.uk') THEN 'NeTEx' WHEN contains(s, 'siri.org.uk') THEN 'SIRI' END AS standard FROM tr)
SELECT slug, string_agg(standard, ',' ORDER BY standard) AS standards FROM k JOIN e USING (core) WHERE standard IS NOT NULL GROUP BY slug""",
)
def discovered_standards(spark, d):
    triples = _triples(spark, d)
    slugs = read(spark, d, "nation").select(F.concat(F.lit("core-"), F.col("n_nationkey").cast("string")).alias("slug"))
    cores = K.core_by_slug(slugs, triples, _CORE)
    return cores.join(K.standards_of(cores, triples, _CORE), "core").groupBy("slug").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("standards")))), ",").alias("standards"))


@query(
    "concept_examples",
    """WITH x AS (SELECT doc_id AS example, CASE doc_id % 5 WHEN 0 THEN 'netex:ServiceJourney' WHEN 1 THEN 'netex:JourneyPattern' ELSE 'k:' || (doc_id % 50) END AS concept_id FROM documents),
q AS (SELECT s_suppkey AS question_id, CASE WHEN s_suppkey % 4 = 0 THEN 'netex:TemplateServiceJourney' ELSE 'k:' || (s_suppkey % 50) END AS concept_id FROM supplier),
r AS (SELECT question_id, concept_id, example, 'direct_example' AS match FROM q JOIN x USING (concept_id) UNION ALL SELECT question_id, q.concept_id, example, 'template_realization' FROM q JOIN x ON x.concept_id IN ('netex:ServiceJourney', 'netex:JourneyPattern') WHERE q.concept_id = 'netex:TemplateServiceJourney')
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY concept_id, example) AS nth FROM r QUALIFY nth <= 20""",
)
def concept_examples(spark, d):
    n, k = F.col("doc_id"), F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("k:"), (c % 50).cast("string"))
    examples = read(spark, d, "documents").select(n.alias("example"), F.when(n % 5 == 0, "netex:ServiceJourney").when(n % 5 == 1, "netex:JourneyPattern").otherwise(name(n)).alias("concept_id"))
    asked = read(spark, d, "supplier").select(k.alias("question_id"), F.when(k % 4 == 0, O.TEMPLATE).otherwise(name(k)).alias("concept_id"))
    return O.concept_examples(asked, examples)


@query(
    "concept_addresses",
    """WITH k AS (SELECT p_partkey AS n, CASE p_partkey % 5 WHEN 0 THEN 'https://NeTEx.org.uk/v#Stop#x' WHEN 1 THEN 'https://opra.org.uk/Quay' WHEN 2 THEN 'http://www.siri.org.uk/siri/2.1#Call' WHEN 3 THEN 'http://transmodel-cen.eu/a#Line' ELSE 'https://example.org/' END AS iri FROM part)
SELECT n, CASE n % 5 WHEN 0 THEN 'NeTEx' WHEN 1 THEN 'OpRa' WHEN 2 THEN 'SIRI' WHEN 3 THEN 'Transmodel' ELSE 'Ontology' END AS standard, CASE n % 5 WHEN 0 THEN 'Stop' WHEN 1 THEN 'Quay' WHEN 2 THEN 'Call' WHEN 3 THEN 'Line' ELSE '' END AS name FROM k""",
)
def concept_addresses(spark, d):
    n = F.col("p_partkey")
    all_of = ("https://NeTEx.org.uk/v#Stop#x", "https://opra.org.uk/Quay", "http://www.siri.org.uk/siri/2.1#Call", "http://transmodel-cen.eu/a#Line", "https://example.org/")
    iri = F.element_at(F.array(*map(F.lit, all_of)), (n % 5 + 1).cast("int"))
    return read(spark, d, "part").select(n.alias("n"), D.address_standard(iri).alias("standard"), D.address_name(iri).alias("name"))


@query(
    "example_names",
    r"""SELECT p_partkey AS n, 'nexample:NeTEx' || CASE p_partkey % 3 WHEN 0 THEN 'Entur' ELSE '' END || CASE p_partkey % 3 WHEN 0 THEN 'stops' ELSE 'Stops' END || 'Of' || p_partkey AS name, 'stop place ref' AS label FROM part""",
)
def example_names(spark, d):
    n = F.col("p_partkey")
    first = F.when(n % 3 == 0, "a/ENTUR-stops").when(n % 3 == 1, "Netex_51.1_STOPS").otherwise("b/c/stops")
    path = F.concat(first, F.lit("-of "), n.cast("string"), F.lit(".xml"))
    return read(spark, d, "part").select(n.alias("n"), D.instance_name(path).alias("name"), D.element_label(F.lit("StopPlaceRef")).alias("label"))


@query(
    "stored_standards",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'netex,siri' WHEN conv_id % 2 = 0 THEN 'opra' ELSE '' END AS standards FROM conversations""",
)
def stored_standards(spark, d):
    scope = F.when(F.col("turn") % 2 == 0, F.array(F.lit(" NeTEx"), F.lit("Transmodel"))).otherwise(F.array(F.lit("Profile Documentation")))
    hinted = F.when(F.col("turn") % 2 == 0, F.array(F.lit("SIRI"), F.lit("netex"))).when(F.col("conv_id") % 2 == 0, F.array(F.lit("OpRa")))
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(D.stored_standards(scope, hinted), ",").alias("standards"))


# ---- queue --------------------------------------------------------------------------------------------------------


@query(
    "routed_answers",
    f"""WITH {EVENTS}, x AS (SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CITATION_GAP' WHEN 2 THEN 'other' ELSE 'POLICY_REVIEW' END AS reason, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'high' ELSE 'urgent' END AS priority FROM ev),
y AS (SELECT id AS event_id, coalesce(reason, 'USER_ESCALATION') AS reason, coalesce(priority, 'normal') AS priority, CASE WHEN reason = 'other' THEN 'reason' WHEN priority = 'urgent' THEN 'priority' END AS error FROM x) SELECT *, CASE WHEN error IS NULL THEN 'in_review' END AS status FROM y""",
)
def routed_answers(spark, d):
    n = F.col("id")
    reason = F.when(n % 5 == 1, "CITATION_GAP").when(n % 5 == 2, "other").when(n % 5 > 2, "POLICY_REVIEW")
    return G.routed(events(spark, d).select(n.alias("event_id"), reason.alias("reason"), F.when(n % 3 == 1, "high").when(n % 3 == 2, "urgent").alias("priority")))


@query(
    "queue_citations",
    f"""WITH {QUEUE}, {CHUNKS}, k AS (SELECT chunk_id % 300 AS event_id, string_agg(repository_url || '/blob/main/' || source_path || '|' || chunk_id, chr(10) ORDER BY chunk_id % 7, chunk_id) AS cited FROM c WHERE NOT regexp_matches(source_path, '^issues/[0-9]+\\.md$') GROUP BY 1)
SELECT queue_item_id, coalesce(cited, '') AS cited FROM q LEFT JOIN k USING (event_id)""",
)
def queue_citations(spark, d):
    n = F.col("chunk_id")
    links = chunks(spark, d).where(~F.col("source_path").rlike(r"^issues/[0-9]+\.md$"))
    links = links.select((n % 300).alias("event_id"), (n % 7).alias("created_at"), n.alias("link_id"), "repository_url", F.lit("main").alias("commit_sha"), "source_path", n.cast("string").alias("chunk_id"), "label")
    out = G.queue_citations(queue(spark, d), links)
    return out.select("queue_item_id", F.array_join(F.transform("citations", lambda c: F.concat_ws("|", c["repository_url"], c["chunk_id"])), "\n").alias("cited"))


@query(
    "console_page",
    f"""WITH {EVENTS}, {QUEUE}, a AS (SELECT id AS request_id, created_at AS asked_at, value AS confidence, k % 9 AS likes, k % 4 AS dislikes FROM ev), s AS (SELECT event_id AS request_id, arg_max(status, (created_at, queue_item_id)) AS status FROM q GROUP BY event_id)
SELECT request_id, status, likes - dislikes AS balance FROM a JOIN s USING (request_id) WHERE status = 'in_review' ORDER BY likes - dislikes DESC, request_id LIMIT 50""",
)
def console_page(spark, d):
    asked = events(spark, d).select(F.col("id").alias("request_id"), F.col("created_at").alias("asked_at"), F.col("value").alias("confidence"), (F.col("k") % 9).alias("likes"), (F.col("k") % 4).alias("dislikes"))
    rows = G.console_rows(asked, queue(spark, d).withColumnRenamed("event_id", "request_id"), "in_review")
    return rows.orderBy(*G.console_order("likes", descending=True)).limit(50).select("request_id", "status", (F.col("likes") - F.col("dislikes")).alias("balance"))


@query(
    "exported_chunks",
    f"WITH {CHUNKS} SELECT repository_url, count(*) AS n, min(quality_score) AS least FROM c WHERE quality_score >= 0.75 GROUP BY 1",
)
def exported_chunks(spark, d):
    return I.exportable(chunks(spark, d), quality=0.75).groupBy("repository_url").agg(F.count("*").alias("n"), F.min("quality_score").alias("least"))


@query(
    "repaired_roots",
    f"WITH {CHUNKS} SELECT chunk_id, repository_url AS root FROM c",
)
def repaired_roots(spark, d):
    stored = F.when(F.col("chunk_id") % 2 == 0, F.concat("repository_url", F.lit("/blob/main/a/blob/"), "source_path")).otherwise(F.col("repository_url"))
    return chunks(spark, d).select("chunk_id", D.repaired_root(stored).alias("root"))

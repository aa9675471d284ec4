"""Queries on texts, chunks and indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import chunking, indexing
from quillon.operators import governance as G
from quillon.operators import ontology as O
from quillon.operators import retrieval as R
from quillon.plans.frames import BENCHMARK, CHUNKS, QUESTIONS, benchmark, chunks, questions, read, squeezed, tokens
from quillon.sources import files, turtle

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("retrieval_tokens", f"SELECT doc_id, CAST(len({tokens('text')}) AS BIGINT) AS n, CAST(len(list_distinct({tokens('text')})) AS BIGINT) AS n_distinct, sha256(array_to_string({tokens('text')}, ' ')) AS digest FROM documents")
def retrieval_tokens(spark, d):
    t = read(spark, d, "documents").select("doc_id", T.retrieval_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query(
    "token_jaccard",
    f"""WITH {QUESTIONS}, {BENCHMARK}, x AS (SELECT question_id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS t FROM qu), y AS (SELECT question_id AS item_id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS t FROM b),
z AS (SELECT x.question_id, item_id, len(list_intersect(x.t, y.t)) AS i, len(x.t) AS a, len(y.t) AS b FROM x, y)
SELECT question_id, item_id, round(CASE WHEN a = 0 OR b = 0 THEN 0.0 ELSE CAST(i AS DOUBLE) / (a + b - i) END, 9) AS jaccard FROM z""",
)
def token_jaccard(spark, d):
    """Every pair has a row, 0 where no token is shared, so the result is the product of both sides itself."""
    x = questions(spark, d).select("question_id", F.array_distinct(T.plain_tokens("question")).alias("x"))
    y = benchmark(spark, d).select(F.col("question_id").alias("item_id"), F.array_distinct(T.plain_tokens("question")).alias("y"))
    return x.crossJoin(R.small(y)).select("question_id", "item_id", F.round(T.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


def _stem_sql(c: str) -> str:
    out = "CASE "
    for s, p in T.STEMS:
        out += f"WHEN {c} LIKE '%{s}' AND length({c}) - {len(s) - len(p)} >= 4 THEN left({c}, length({c}) - {len(s)}) || '{p}' "
    return out + f"ELSE {c} END"


@query(
    "word_stems",
    f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]*')) AS w FROM documents) SELECT stem, count(*) AS n_words, min(w) AS first_word FROM (SELECT w, {_stem_sql('w')} AS stem FROM w) GROUP BY stem",
)
def word_stems(spark, d):
    words = read(spark, d, "documents").select(F.explode(T.found(T.lowered("text"), "[a-z][a-z0-9]*")).alias("w")).distinct()
    return words.groupBy(T.stem("w").alias("stem")).agg(F.count("*").alias("n_words"), F.min("w").alias("first_word"))


@query(
    "fixed_window_chunks",
    rf"""WITH s AS (SELECT doc_id, {squeezed("text")} AS t FROM documents), p AS (SELECT doc_id, t, unnest(generate_series(0, CAST(ceil(greatest(0, length(t) - 1200) / 1000.0) AS INTEGER))) AS i FROM s WHERE t <> '')
SELECT doc_id, CAST(i AS BIGINT) AS position, CAST(length(c) AS BIGINT) AS n_chars, sha256(c) AS digest FROM (SELECT doc_id, i, trim(substring(t, i * 1000 + 1, 1200)) AS c FROM p) WHERE c <> ''""",
)
def fixed_window_chunks(spark, d):
    cut = chunking.window_chunks(read(spark, d, "documents"), "doc_id", "text")
    return cut.select("doc_id", "position", F.length("chunk_text").cast("long").alias("n_chars"), F.sha2("chunk_text", 256).alias("digest"))


def _markdown(spark, d):
    """Every fifth line becomes a heading, as documents have none."""
    lines = F.transform(F.split(T.text("text"), "\n"), lambda x, i: F.when((i % 5 == 4) & (F.trim(x) != ""), F.concat(F.lit("# "), F.trim(x))).otherwise(x))
    return read(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


@query(
    "markdown_sections",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), x AS (SELECT doc_id, unnest(generate_series(1, len(a))) AS i, unnest(a) AS line FROM l),
y AS (SELECT doc_id, i, i % 5 = 0 AND trim(line) <> '' AS h, CASE WHEN i % 5 = 0 AND trim(line) <> '' THEN '# ' || trim(line) ELSE line END AS line FROM x),
z AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM y),
g AS (SELECT doc_id, s, max(CASE WHEN h THEN trim(line[2:]) ELSE '' END) AS heading, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS t FROM z GROUP BY doc_id, s)
SELECT doc_id, heading, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS digest FROM g WHERE t <> ''""",
)
def markdown_sections(spark, d):
    out = chunking.markdown_sections(_markdown(spark, d), "doc_id", "text")
    return out.select("doc_id", "heading", F.length("section_text").cast("long").alias("n_chars"), F.sha2("section_text", 256).alias("digest"))


@query("markdown_chunks")
def markdown_chunks(spark, d):
    out = chunking.markdown_chunks(_markdown(spark, d), "doc_id", "text")
    return out.select("doc_id", "position", "chunk_type", "heading", F.length("chunk_text").cast("long").alias("n_chars"))


_DOC_TYPE = """CASE WHEN regexp_extract(p, '([^/]*)$', 1) LIKE 'readme%' THEN 'readme' WHEN p LIKE '%/examples/%' OR p LIKE 'examples/%' THEN 'example' WHEN chunk_type = 'schema_fragment' OR p LIKE '%.xsd' THEN 'schema'
WHEN regexp_matches(blob, ' frame|frame[ :-]') THEN 'frame' WHEN regexp_matches(blob, ' object|object[ :-]') THEN 'object' ELSE 'guide' END"""
_CLASSIFIED = rf"""{CHUNKS}, k0 AS (SELECT *, lower(source_path) AS p, lower(source_path || chr(10) || heading || chr(10) || left(text, 500)) AS blob, len(regexp_extract_all(text, '[^\s]+')) AS words FROM c),
k1 AS (SELECT *, {_DOC_TYPE} AS doc_type FROM k0),
k AS (SELECT *, least(greatest(CASE doc_type WHEN 'frame' THEN 0.88 WHEN 'object' THEN 0.86 WHEN 'schema' THEN 0.84 WHEN 'guide' THEN 0.76 WHEN 'example' THEN 0.74 ELSE 0.62 END
+ CASE WHEN words < 20 THEN -0.12 WHEN words < 60 THEN 0.01 WHEN words <= 280 THEN 0.06 WHEN words > 500 THEN -0.04 ELSE 0.0 END + CASE WHEN heading <> '' THEN 0.03 ELSE 0.0 END
+ CASE WHEN chunk_type = 'heading_section' THEN 0.03 ELSE 0.0 END + 0.04 - CASE WHEN p LIKE 'issues/%' THEN 0.04 ELSE 0.0 END, 0.0), 1.0) AS q FROM k1)"""


@query("chunk_classify_quality", f"WITH {_CLASSIFIED} SELECT chunk_id, doc_type, round(CAST(q AS DOUBLE), 6) AS quality FROM k")
def chunk_classify_quality(spark, d):
    c = chunks(spark, d)
    kind = T.doc_type(F.col("source_path"), F.col("chunk_type"), F.col("heading"), F.col("text"))
    out = c.withColumn("doc_type", kind)
    q = indexing.quality(F.col("doc_type"), F.col("text"), F.col("heading"), F.col("chunk_type"), F.col("standards_scope"), F.col("source_path"))
    return out.select("chunk_id", "doc_type", F.round(q, 6).alias("quality"))


@query(
    "inferred_scope",
    f"""WITH {CHUNKS}, m AS (SELECT chunk_id, CASE chunk_id % 5 WHEN 0 THEN 'https://example.org/NeTEx' WHEN 1 THEN 'https://example.org/siri-core' ELSE repository_url END AS r, source_path || chr(10) || CASE WHEN chunk_id % 7 = 0 THEN 'about OpRa and Transmodel ' ELSE '' END || text AS t FROM c)
SELECT chunk_id, array_to_string(list_sort(list_filter([CASE WHEN contains(lower(t), 'netex') OR contains(lower(r), 'netex') THEN 'NeTEx' END, CASE WHEN contains(lower(t), 'siri') OR contains(lower(r), 'siri') THEN 'SIRI' END,
CASE WHEN contains(lower(t), 'opra') OR contains(lower(r), 'opra') THEN 'OpRa' END, CASE WHEN contains(lower(t), 'transmodel') THEN 'Transmodel' END], lambda x: x IS NOT NULL)), ',') AS scope FROM m""",
)
def inferred_scope(spark, d):
    n = F.col("chunk_id")
    repo = F.when(n % 5 == 0, "https://example.org/NeTEx").when(n % 5 == 1, "https://example.org/siri-core").otherwise(F.col("repository_url"))
    body = F.concat(F.when(n % 7 == 0, "about OpRa and Transmodel ").otherwise(""), "text")
    return chunks(spark, d).select("chunk_id", F.array_join(T.infer_scope(F.col("source_path"), body, repo), ",").alias("scope"))


@query("chunk_ids", f"WITH {CHUNKS} SELECT chunk_id, 'src-' || left(sha1(repository_url || '|' || source_path || '|0|' || text), 24) AS stable_id, sha1(text) AS content_hash FROM c")
def chunk_ids(spark, d):
    return chunks(spark, d).select("chunk_id", T.chunk_id(F.col("repository_url"), F.col("source_path"), F.lit(0), F.col("text")).alias("stable_id"), indexing.content_hash("text").alias("content_hash"))


def _manifest(spark, d):
    files_ = chunks(spark, d).select("repository_url", F.concat("source_path", F.lit("#"), F.col("chunk_id").cast("string")).alias("source_path"), indexing.content_hash("text").alias("content_hash"), "chunk_id")
    old = files_.where("chunk_id % 4 <> 0").withColumn("content_hash", F.when(F.col("chunk_id") % 7 == 0, "old").otherwise(F.col("content_hash")))
    return files_, old


_FILES = f"{CHUNKS}, f AS (SELECT repository_url, source_path || '#' || chunk_id AS source_path, sha1(text) AS content_hash, chunk_id FROM c), o AS (SELECT repository_url, source_path, CASE WHEN chunk_id % 7 = 0 THEN 'old' ELSE content_hash END AS content_hash, chunk_id FROM f WHERE chunk_id % 4 <> 0)"


@query("hash_diff_changed", f"WITH {_FILES} SELECT f.repository_url, f.source_path, f.content_hash FROM f LEFT JOIN o ON f.repository_url = o.repository_url AND f.source_path = o.source_path AND f.content_hash = o.content_hash WHERE o.source_path IS NULL")
def hash_diff_changed(spark, d):
    new, old = _manifest(spark, d)
    return indexing.changed(new, old).select("repository_url", "source_path", "content_hash")


@query(
    "index_upsert",
    f"WITH {_FILES}, n AS (SELECT * FROM f WHERE chunk_id % 3 <> 0) SELECT coalesce(n.chunk_id, o.chunk_id) AS chunk_id, CASE WHEN o.chunk_id IS NULL THEN 'created' WHEN n.chunk_id IS NOT NULL THEN 'updated' ELSE 'kept' END AS change, coalesce(n.content_hash, o.content_hash) AS content_hash FROM n FULL JOIN o ON n.chunk_id = o.chunk_id",
)
def index_upsert(spark, d):
    new, old = _manifest(spark, d)
    return indexing.upserted(old, new.where("chunk_id % 3 <> 0")).select("chunk_id", "change", "content_hash")


@query("stale_chunks_removed", f"WITH {_FILES} SELECT chunk_id, source_path FROM o WHERE NOT (chunk_id % 5 = 0 AND chunk_id % 2 = 1)")
def stale_chunks_removed(spark, d):
    _, old = _manifest(spark, d)
    return indexing.without_stale(old, old.where("chunk_id % 5 <> 0").select("chunk_id"), old.where("chunk_id % 2 = 1").select("repository_url", "source_path")).select("chunk_id", "source_path")


@query("manifest_pruned", f"WITH {_FILES} SELECT repository_url, source_path FROM o WHERE chunk_id % 6 <> 1")
def manifest_pruned(spark, d):
    _, old = _manifest(spark, d)
    return indexing.pruned_manifest(old, old.where("chunk_id % 6 <> 1")).select("repository_url", "source_path")


@query("profile_filter", f"WITH {CHUNKS} SELECT chunk_id, source_path FROM c WHERE (contains(lower(source_path), 'docs/') OR contains(lower(source_path), '.xsd')) AND NOT contains(lower(source_path), 'readme')")
def profile_filter(spark, d):
    return chunks(spark, d).where(indexing.matches_profile(F.col("source_path"), ["Docs/", ".xsd"], ["README"])).select("chunk_id", "source_path")


@query("repository_allow_list", f"WITH {CHUNKS} SELECT chunk_id, repository_url FROM c WHERE label IN ('src1', 'src2', 'src3')")
def repository_allow_list(spark, d):
    own = chunks(spark, d).where(F.col("label").isin("src1", "src2", "src3"))
    return indexing.allowed_repositories(own, [f"https://example.org/src{i}" for i in (1, 2, 3)]).select("chunk_id", "repository_url")


@query(
    "question_intents",
    rf"""WITH {QUESTIONS}, l AS (SELECT question_id, lower(question) AS q FROM (SELECT question_id, question || CASE question_id % 9 WHEN 0 THEN ' shall' WHEN 1 THEN ' what is it' WHEN 2 THEN ' where' WHEN 3 THEN ' between them' WHEN 4 THEN ' compare' WHEN 5 THEN ' may' ELSE '' END AS question FROM qu))
SELECT question_id, CASE WHEN regexp_matches(q, '\b(shall|must|should|may)\b') THEN 'normative_status' WHEN regexp_matches(q, '\b(what is|define|meaning of)\b') THEN 'definition' WHEN regexp_matches(q, '\b(where|in which|which file)\b') THEN 'location'
WHEN regexp_matches(q, '\b(relate|cross[- ]standard|between)\b') THEN 'cross_standard_relation' WHEN regexp_matches(q, '\b(compare|difference|vs|versus)\b') THEN 'comparison' ELSE 'unknown' END AS intent,
CASE WHEN regexp_matches(q, '\b(shall|must|required)\b') THEN 'mandatory' WHEN regexp_matches(q, '\bshould\b') THEN 'recommended' WHEN regexp_matches(q, '\bmay\b') THEN 'optional' ELSE 'unspecified' END AS normativity FROM l""",
)
def question_intents(spark, d):
    n = F.col("question_id") % 9
    tail = F.when(n == 0, " shall").when(n == 1, " what is it").when(n == 2, " where").when(n == 3, " between them").when(n == 4, " compare").when(n == 5, " may").otherwise("")
    asked = questions(spark, d).withColumn("question", F.concat("question", tail))
    return asked.select("question_id", T.intent("question").alias("intent"), T.normativity("question").alias("normativity"))


_KINDS = {k: v for k, v in T.QUESTION_KINDS.items()}


@query("question_kinds", "SELECT item_id AS question_id, " + ", ".join(f"regexp_matches(lower(text || ' how to list unclear mapping'), '{v}') AS {k}" for k, v in _KINDS.items()) + " FROM benchmark")
def question_kinds(spark, d):
    asked = F.concat("question", F.lit(" how to list unclear mapping"))
    return benchmark(spark, d).select("question_id", *(T.question_kind(asked, k).alias(k) for k in _KINDS))


@query(
    "doc_type_hints",
    r"""WITH l AS (SELECT conv_id * 1000 + turn AS question_id, lower(text || CASE (conv_id * 1000 + turn) % 6 WHEN 0 THEN ' example xml' WHEN 1 THEN ' what is a frame' WHEN 2 THEN ' xsd elements' WHEN 3 THEN ' entity overview' ELSE '' END) AS q FROM conversations WHERE role = 'user'),
m AS (SELECT question_id, q, regexp_matches(q, 'frame|hierarchy') AS fr, regexp_matches(q, 'object|entity|entities') AS ob, regexp_matches(q, 'schema|xsd|xml|element|attribute') AS sc, regexp_matches(q, 'example|sample') AS ex, regexp_matches(q, 'overview|introduction') AS re, regexp_matches(q, 'guide|guidance|tutorial|how') AS gu,
contains(q, 'example') AND contains(q, 'xml') AND NOT contains(q, 'xsd') AND NOT contains(q, 'schema') AS inst, regexp_matches(q, '\b(what\s+is|what\s+are|define|definition\s+of|what\s+does|explain|describe|meaning\s+of)\b') AS def FROM l)
SELECT question_id, array_to_string(list_filter([CASE WHEN ex OR inst THEN 'example' END, CASE WHEN fr THEN 'frame' END, CASE WHEN gu THEN 'guide' END, CASE WHEN ob THEN 'object' END, CASE WHEN re THEN 'readme' END, CASE WHEN (sc AND NOT inst) OR (def AND NOT (ex OR inst)) THEN 'schema' END], lambda x: x IS NOT NULL), ',') AS hints FROM m""",
)
def doc_type_hints(spark, d):
    n = F.col("question_id") % 6
    tail = F.when(n == 0, " example xml").when(n == 1, " what is a frame").when(n == 2, " xsd elements").when(n == 3, " entity overview").otherwise("")
    return questions(spark, d).select("question_id", F.array_join(T.doc_type_hints(F.concat("question", tail)), ",").alias("hints"))


@query(
    "path_hints",
    r"""WITH l AS (SELECT question_id, 'see Schedule-File.' || (question_id % 7) || ' and Journey_Note' || (question_id % 3) || '.xml. then ' || question AS q FROM (SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations WHERE role = 'user')),
t AS (SELECT question_id, list_transform(regexp_extract_all(q, '[A-Za-z][A-Za-z0-9_.-]{7,}'), lambda x: lower(regexp_replace(x, '^\.+|\.+$', '', 'g'))) AS h FROM l)
SELECT question_id, array_to_string(list_sort(list_distinct(list_filter(h, lambda x: regexp_matches(x, '\.(xml|xsd|md)$|[_/0-9-]')))), ',') AS hints FROM t""",
)
def path_hints(spark, d):
    n = F.col("question_id")
    asked = F.concat(F.lit("see Schedule-File."), (n % 7).cast("string"), F.lit(" and Journey_Note"), (n % 3).cast("string"), F.lit(".xml. then "), "question")
    return questions(spark, d).select("question_id", F.array_join(F.array_sort(T.path_hints(asked)), ",").alias("hints"))


@query("example_seeking", "SELECT item_id AS question_id, regexp_matches(lower(text), '" + "|".join(T.EXAMPLE_WORDS) + "') AS seeks FROM benchmark")
def example_seeking(spark, d):
    return benchmark(spark, d).select("question_id", T.example_seeking("question").alias("seeks"))


@query("original_terms")
def original_terms(spark, d):
    return questions(spark, d).select("question_id", F.array_join(T.original_terms("question", ("that", "this", "with")), ",").alias("terms"))


@query(
    "xml_signals",
    r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '</?([A-Za-z_][A-Za-z0-9_:.-]*)', 1) AS a, regexp_extract_all(html, '(?s)<!--\s*(.*?)\s*-->', 1) AS b FROM pages),
u AS (SELECT page_id, list_concat(list_transform(a, lambda x: lower(trim(regexp_replace(regexp_replace(regexp_replace(x, '[:_-]', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g')))), list_transform(b, lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g'))))) AS s FROM t),
v AS (SELECT page_id, unnest(generate_series(1, len(s))) AS i, unnest(s) AS s FROM u), w AS (SELECT page_id, s, min(i) AS i FROM v WHERE s <> '' GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM w)
SELECT page_id, string_agg(s, '|' ORDER BY i) AS signals FROM x WHERE n <= 18 GROUP BY page_id""",
)
def xml_signals(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(T.xml_signals("html"), "|").alias("signals"))


@query("repository_roots", r"SELECT page_id, regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+[^?#]*)', 1), '/+$', '') AS root FROM pages")
def repository_roots(spark, d):
    return read(spark, d, "pages").select("page_id", T.repository_root("url").alias("root"))


@query("file_urls", f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN regexp_matches(source_path, '^issues/[0-9]+\\.md$') THEN repository_url || '/issues/' || regexp_extract(source_path, '^issues/([0-9]+)\\.md$', 1) ELSE repository_url || '/blob/main/' || replace(source_path, '#', '%23') END AS url FROM c")
def file_urls(spark, d):
    return chunks(spark, d).select("chunk_id", T.file_url(F.col("repository_url"), F.lit("main"), F.col("source_path")).alias("url"))


@query("evidence_markers", "SELECT doc_id, CASE WHEN regexp_matches(t, '\\[E[0-9]+\\]') THEN t ELSE regexp_replace(t, '^([^.!?]*[.!?]+)', '\\1 [E1]') END AS answer FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def evidence_markers(spark, d):
    return read(spark, d, "documents").select("doc_id", T.with_marker(F.col("text"), F.lit(1)).alias("answer"))


@query(
    "hash_embedding",
    f"""WITH t AS (SELECT item_id, unnest({tokens("text")}) AS t FROM benchmark), h AS (SELECT item_id, ('0x' || left(sha256(t), 4))::INTEGER % 1536 AS slot, ('0x' || substring(sha256(t), 5, 2))::INTEGER / 127.5 - 1.0 AS w FROM t),
s AS (SELECT item_id, slot, sum(CAST(w AS DOUBLE)) AS w FROM h GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM s GROUP BY item_id)
SELECT s.item_id, CAST(slot AS INTEGER) AS slot, round(w / n, 6) AS weight FROM s JOIN n ON s.item_id = n.item_id""",
)
def hash_embedding(spark, d):
    return V.hash_embedding(read(spark, d, "benchmark"), "item_id", "text").withColumn("weight", F.round("weight", 6))


@query("issue_documents", f"WITH q AS (SELECT o_orderkey AS number, 'Issue ' || o_orderkey AS title, o_orderpriority AS body FROM orders WHERE o_orderkey % 5 <> 0), l AS (SELECT l_orderkey AS number, string_agg('Line ' || l_linenumber, chr(10) || chr(10) ORDER BY l_linenumber) AS said FROM lineitem GROUP BY 1) SELECT 'issues/' || q.number || '.md' AS source_path, '# ' || title || chr(10) || chr(10) || body || coalesce(chr(10) || chr(10) || said, '') AS text FROM q LEFT JOIN l ON q.number = l.number")
def issue_documents(spark, d):
    n = F.col("o_orderkey")
    issues = read(spark, d, "orders").select(n.alias("number"), F.concat(F.lit("Issue "), n.cast("string")).alias("title"), F.col("o_orderpriority").alias("body"), (n % 5 == 0).alias("is_pull_request"), F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("string").alias("updated_at"))
    said = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("number"), F.col("l_linenumber").alias("position"), F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("body"))
    return files.issue_documents(issues, said, "https://example.org/orders").select("source_path", "text")


@query("asset_versions", "SELECT 'a/' || doc_id AS path, 'v' || (doc_id % 9) AS version, sha256('owl:versionInfo \"v' || (doc_id % 9) || '\" ; ' || text) AS content_hash FROM documents")
def asset_versions(spark, d):
    body = F.concat(F.lit('owl:versionInfo "v'), (F.col("doc_id") % 9).cast("string"), F.lit('" ; '), "text")
    return O.asset_versions(read(spark, d, "documents").select(F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), body.alias("text")))


@query("schema_declarations")
def schema_declarations(spark, d):
    """XSDs made of parts: one element each, with a sequence of the part's type words."""
    inner = F.array_join(F.transform(F.split("p_type", " "), lambda t: F.concat(F.lit('<xs:element name="'), t, F.lit('" minOccurs="'), (F.col("p_size") % 2).cast("string"), F.lit('"/>'))), "")
    body = F.concat(F.lit('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="Part'), F.col("p_partkey").cast("string"), F.lit('"><xs:complexType><xs:sequence>'), inner, F.lit('</xs:sequence><xs:attribute name="id" use="required"/></xs:complexType></xs:element></xs:schema>'))
    parts = read(spark, d, "part").select("p_partkey", body.alias("text"))
    return chunking.schema_metadata(parts, "p_partkey", "text").select("p_partkey", "declaration_name", F.array_join("child_elements", ",").alias("children"), F.array_join("required_child_elements", ",").alias("required"), F.array_join("required_attributes", ",").alias("required_attributes"))


SQL["schema_declarations"] = """WITH t AS (SELECT p_partkey, p_size, string_split(p_type, ' ') AS w FROM part), u AS (SELECT p_partkey, p_size, unnest(generate_series(1, len(w))) AS i, unnest(w) AS w FROM t), v AS (SELECT p_partkey, p_size, w, min(i) AS i FROM u GROUP BY ALL)
SELECT p_partkey, 'Part' || p_partkey AS declaration_name, string_agg(w, ',' ORDER BY i) AS children, CASE WHEN p_size % 2 = 1 THEN string_agg(w, ',' ORDER BY i) ELSE '' END AS required, 'id' AS required_attributes FROM v GROUP BY p_partkey, p_size"""


@query("xml_chunks")
def xml_chunks(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".xml")).alias("path"), F.replace("html", F.lit("<p>"), F.lit("\n<p>")).alias("html"))
    return chunking.markup_chunks(pages, "page_id", "path", "html").select("page_id", "position", F.length("chunk_text").cast("long").alias("n_chars"))


@query(
    "turtle_triples",
    "SELECT 'https://example.org/n#' || n_nationkey AS s, 'https://example.org/v#label' AS p, n_name AS o, 'literal' AS o_kind, 'en' AS lang FROM nation UNION ALL SELECT 'https://example.org/n#' || n_nationkey, 'https://example.org/v#related', 'https://example.org/n#' || ((n_nationkey + 1) % 25), 'iri', '' FROM nation",
)
def turtle_triples(spark, d):
    n = F.col("n_nationkey")
    body = F.concat(F.lit("@prefix n: <https://example.org/n#> . @prefix v: <https://example.org/v#> .\nn:"), n.cast("string"), F.lit(' v:label "'), "n_name", F.lit('"@en ; # a comment\n  v:related n:'), ((n + 1) % 25).cast("string"), F.lit(" ."))
    return turtle.triples(read(spark, d, "nation").select(n.cast("string").alias("graph"), body.alias("text"))).select("s", "p", "o", "o_kind", "lang")


def _category_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{k}'" for k, p, _ in O.CATEGORIES) + " END"


@query(
    "alignment_gap",
    f"""WITH k AS (SELECT DISTINCT replace(initcap_(p_type), ' ', '') || CASE p_partkey % 6 WHEN 0 THEN 'Zone' WHEN 1 THEN 'JourneyPattern' WHEN 2 THEN 'Ref' WHEN 3 THEN 'Operator' WHEN 4 THEN 'Network' ELSE '' END AS name FROM part),
a AS (SELECT name FROM k WHERE length(name) % 4 = 0), r AS (SELECT name, {_category_sql("name")} AS category FROM k WHERE name NOT IN (SELECT name FROM a)) SELECT category, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM r GROUP BY category""".replace("initcap_(p_type)", "lower(p_type)"),
)
def alignment_gap(spark, d):
    n = F.col("p_partkey") % 6
    tail = F.when(n == 0, "Zone").when(n == 1, "JourneyPattern").when(n == 2, "Ref").when(n == 3, "Operator").when(n == 4, "Network").otherwise("")
    names = read(spark, d, "part").select(F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("")), tail).alias("name")).distinct()
    out = O.alignment_gap(names, names.where(F.length("name") % 4 == 0))
    return out.select("category", "n", F.array_join("names", ",").alias("names"))


@query(
    "top_element_names",
    """WITH t AS (SELECT page_id, regexp_extract_all(replace(html, '<p', '<P'), '<(?:[A-Za-z_][A-Za-z0-9_.-]*:)?([A-Z][A-Za-z0-9_.-]*)', 1) AS a FROM pages), u AS (SELECT page_id, unnest(generate_series(1, len(a))) AS i, unnest(a) AS name FROM t),
g AS (SELECT page_id, name, count(*) AS n, min(i) AS i FROM u GROUP BY ALL) SELECT page_id, name, n, nth FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, i) AS nth FROM g) WHERE nth <= 3""",
)
def top_element_names(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.replace("html", F.lit("<p"), F.lit("<P")).alias("html"))
    return O.top_names(pages, "page_id", "html", 3)


@query("faq_ids", rf"SELECT item_id, 'faq-auto-' || left(sha1(lower({squeezed('text')})), 12) AS faq_id FROM benchmark")
def faq_ids(spark, d):
    return benchmark(spark, d).select(F.col("question_id").alias("item_id"), G.faq_id(F.col("question")).alias("faq_id"))


_CLASS = "SELECT DISTINCT 'Stop' || replace(lower(p_type), ' ', '') || CASE p_partkey % 9 WHEN 0 THEN 'Zone' WHEN 1 THEN 'JourneyPattern' WHEN 2 THEN 'Ref' WHEN 3 THEN 'Operator' WHEN 4 THEN '_View' WHEN 5 THEN 'Group' WHEN 6 THEN 'Code' ELSE '' END AS name FROM part"


def _classes(spark, d):
    n = F.col("p_partkey") % 9
    tail = F.lit("")
    for i, word in enumerate(("Zone", "JourneyPattern", "Ref", "Operator", "_View", "Group", "Code")):
        tail = F.when(n == i, word).otherwise(tail)
    return read(spark, d, "part").withColumn("name", F.concat(F.lit("Stop"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("")), tail))


def _reason_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{r.replace(chr(39), chr(39) * 2)}'" for _, p, r in O.CATEGORIES) + " END"


@query("class_categories", f"WITH k AS ({_CLASS}) SELECT name, {_category_sql('name')} AS category, {_reason_sql('name')} AS reason FROM k")
def class_categories(spark, d):
    return _classes(spark, d).select("name").distinct().withColumn("x", O.categorised(F.col("name"))).select("name", "x.category", "x.reason")


def _any_sql(c: str, words, test: str) -> str:
    return "(" + " OR ".join(f"{test}({c}, '{w}')" for w in words) + ")"


_DOCUMENTED = f"""SELECT p_partkey, 'Stop' || replace(lower(p_type), ' ', '') || CASE p_partkey % 9 WHEN 0 THEN 'Zone' WHEN 1 THEN 'JourneyPattern' WHEN 2 THEN 'Ref' WHEN 3 THEN 'Operator' WHEN 4 THEN '_View' WHEN 5 THEN 'Group' WHEN 6 THEN 'Code' ELSE '' END AS name,
CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'The stop' || replace(lower(p_type), ' ', '') || ' (one)  of ' || p_name WHEN 2 THEN 'Type for zone ' || p_name WHEN 3 THEN 'A zone of the ' || p_name ELSE 'zone that ' END AS doc FROM part"""


def _documented(spark, d):
    c, n = _classes(spark, d), F.col("p_partkey") % 5
    said = F.when(n == 0, "").when(n == 1, F.concat(F.lit("The stop"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("")), F.lit(" (one)  of "), "p_name")).when(n == 2, F.concat(F.lit("Type for zone "), "p_name"))
    return c.withColumn("doc", said.when(n == 3, F.concat(F.lit("A zone of the "), "p_name")).otherwise("zone that "))


@query("domain_concepts", f"WITH k AS ({_DOCUMENTED}) SELECT p_partkey, name, name <> '' AND NOT {_any_sql('name', O.TECHNICAL_PARTS, 'contains')} AND NOT {_any_sql('name', O.TECHNICAL_ENDS, 'ends_with')} AND length(doc) > 25 AS is_domain, {_any_sql('name', O.NOISY_ENDS, 'ends_with')} OR contains(name, '{O.NOISY_PART}') AS is_noisy FROM k")
def domain_concepts(spark, d):
    name, doc = F.col("name"), F.col("doc")
    return _documented(spark, d).select("p_partkey", "name", O.domain_concept(name, doc).alias("is_domain"), O.noisy_name(name).alias("is_noisy"))


@query(
    "concept_labels",
    rf"""WITH k AS ({_DOCUMENTED}), w AS (SELECT p_partkey, lower(name) AS own, lower(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g')) AS camel, trim(regexp_replace(lower(name), '_+', ' ', 'g')) AS parts,
trim(regexp_replace(regexp_replace(lower(array_to_string(string_split({squeezed("doc")}, ' ')[1:5], ' ')), '^(a|an|the) ', ''), '[^a-z0-9\s]', '', 'g')) AS phrase FROM k),
x AS (SELECT *, phrase <> '' AND len(list_intersect(list_filter(string_split(replace(camel, '_', ' '), ' '), lambda t: length(t) > 2), list_filter(string_split(phrase, ' '), lambda t: length(t) > 2))) > 0 AND NOT {_any_sql("phrase", O.GENERIC_STARTS, "starts_with")} AND NOT {_any_sql("phrase", O.GENERIC_ENDS, "ends_with")} AS said FROM w)
SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE WHEN said THEN [own, camel, parts, phrase] ELSE [own, camel, parts] END)), ',') AS labels FROM x""",
)
def concept_labels(spark, d):
    return _documented(spark, d).select("p_partkey", F.array_join(O.labels(F.col("name"), F.col("doc")), ",").alias("labels"))

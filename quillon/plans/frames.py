"""The driver's tables in the roles of the engine's own, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, column: str) -> Column:
    """The largest time of a column as a literal of its type."""
    value = df.agg(F.max(column).cast("string")).first()[0]
    return F.lit(value).cast(dict(df.dtypes)[column])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("req-"), (F.col("event_id") % 500).cast("string")).alias("request_id"),
        F.concat_ws(" ", kind, k.cast("string")).alias("question"),
        "user_id", "event_type", F.col("ts").alias("created_at"), k.alias("k"), "value",
        F.when(kind == "error", "abstain").when(kind == "purchase", "faq").otherwise("rag").alias("mode"),
        (kind == "error").alias("review_required"), (kind == "signup").alias("abstained"), (kind == "purchase").alias("user_likes"), (kind == "error").alias("user_dislikes"),
        (k % 5).alias("citation_click_count"), F.when(k % 3 != 1, k % 3 == 0).alias("answer_success"),
    )


EVENTS = r"""ev AS (SELECT event_id AS id, 'req-' || (event_id % 500) AS request_id, event_type || ' ' || k AS question, user_id, event_type, ts AS created_at, k, value,
CASE event_type WHEN 'error' THEN 'abstain' WHEN 'purchase' THEN 'faq' ELSE 'rag' END AS mode, event_type = 'error' AS review_required, event_type = 'signup' AS abstained,
event_type = 'purchase' AS user_likes, event_type = 'error' AS user_dislikes, k % 5 AS citation_click_count, CASE WHEN k % 3 <> 1 THEN k % 3 = 0 END AS answer_success
FROM (SELECT *, CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) AS k FROM events))"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    reasons = F.array(*map(F.lit, ("USER_ESCALATION", "LOW_CONFIDENCE", "POLICY_REVIEW", "CITATION_GAP")))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("queue_item_id"), F.col("o_custkey").alias("event_id"),
        F.when(status == "F", "published").when(status == "O", "in_review").when(F.col("o_orderkey") % 3 == 0, "revoked").otherwise("approved").alias("status"),
        F.when(priority.isin("1", "2"), "high").when(priority.isin("3", "4"), "normal").otherwise("low").alias("priority"),
        F.element_at(reasons, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("reason"), F.col("o_orderdate").alias("created_at"),
    )


QUEUE = """q AS (SELECT o_orderkey AS queue_item_id, o_custkey AS event_id, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'in_review' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'revoked' ELSE 'approved' END END AS status,
CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'high' WHEN left(o_orderpriority, 1) IN ('3', '4') THEN 'normal' ELSE 'low' END AS priority,
['USER_ESCALATION', 'LOW_CONFIDENCE', 'POLICY_REVIEW', 'CITATION_GAP'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS reason, o_orderdate AS created_at FROM orders)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks; every eighth is an example, every ninth a schema, some are issues or READMEs."""
    n = F.col("doc_id")
    folder = F.when(n % 8 == 0, "examples/").when(n % 11 == 0, "issues/").otherwise("docs/")
    suffix = F.when(n % 9 == 0, ".xsd").when(n % 10 == 0, ".xml").otherwise(".md")
    name = F.when(n % 13 == 0, F.concat(F.lit("README."), (n % 40).cast("string"))).otherwise((n % 40).cast("string"))
    return read(spark, sf_dir, "documents").select(
        n.alias("chunk_id"), F.concat(F.lit("https://example.org/"), "source").alias("repository_url"), F.concat(folder, name, suffix).alias("source_path"),
        F.col("source").alias("label"), "text", F.array("lang").alias("standards_scope"), F.when(n % 3 == 0, F.concat(F.lit("Part "), (n % 5).cast("string"))).otherwise("").alias("heading"),
        F.when(n % 9 == 0, "schema_fragment").when(n % 3 == 0, "heading_section").otherwise("prose").alias("chunk_type"), ((n % 50) / 100.0 + 0.5).alias("quality_score"),
    )


CHUNKS = """c AS (SELECT doc_id AS chunk_id, 'https://example.org/' || source AS repository_url,
(CASE WHEN doc_id % 8 = 0 THEN 'examples/' WHEN doc_id % 11 = 0 THEN 'issues/' ELSE 'docs/' END) || (CASE WHEN doc_id % 13 = 0 THEN 'README.' ELSE '' END) || (doc_id % 40) || (CASE WHEN doc_id % 9 = 0 THEN '.xsd' WHEN doc_id % 10 = 0 THEN '.xml' ELSE '.md' END) AS source_path,
source AS label, text, [lang] AS standards_scope, CASE WHEN doc_id % 3 = 0 THEN 'Part ' || (doc_id % 5) ELSE '' END AS heading,
CASE WHEN doc_id % 9 = 0 THEN 'schema_fragment' WHEN doc_id % 3 = 0 THEN 'heading_section' ELSE 'prose' END AS chunk_type, CAST(doc_id % 50 AS DOUBLE) / 100.0 + 0.5 AS quality_score FROM documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users said, as questions."""
    said = read(spark, sf_dir, "conversations").where("role = 'user'")
    return said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))


QUESTIONS = "qu AS (SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations WHERE role = 'user')"


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


BENCHMARK = "b AS (SELECT item_id AS question_id, text AS question FROM benchmark)"

#: Retrieval tokens of a text in SQL.
_VARIANTS = "CASE t WHEN 'delayed' THEN 'late' WHEN 'delay' THEN 'late' WHEN 'delays' THEN 'late' WHEN 'journeys' THEN 'journey' WHEN 'services' THEN 'service' WHEN 'metrics' THEN 'metric' ELSE t END"


def tokens(c: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda t: length(t) > 2), lambda t: {_VARIANTS})"


def squeezed(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval results made of documents: each answers question doc_id % 50, with scores from its number."""
    n = F.col("chunk_id")
    own = chunks(spark, sf_dir).withColumns({"question_id": n % 50, "position": F.floor(n / 50).cast("long"), "score": ((n * 37) % 101) / 100.0, "vector": ((n * 53) % 97) / 100.0, "lexical": ((n * 29) % 89) / 100.0})
    return own


HITS = "h AS (SELECT *, chunk_id % 50 AS question_id, CAST(floor(chunk_id / 50) AS BIGINT) AS position, CAST((chunk_id * 37) % 101 AS DOUBLE) / 100.0 AS score, CAST((chunk_id * 53) % 97 AS DOUBLE) / 100.0 AS vector, CAST((chunk_id * 29) % 89 AS DOUBLE) / 100.0 AS lexical FROM c)"

"""Gates, rules, policy, FAQ matching, citations' provenance, and the editorial workflow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.analytics import PRIORITIES, REASONS
from quillon.operators.analytics import latest_by
from quillon.operators.retrieval import small

# Workflow rules as action, from, to, roles.
TRANSITIONS = (
    ("approve", "in_review", "approved", ("reviewer", "admin")),
    ("reject", "in_review", "rejected", ("reviewer", "admin")),
    ("reopen", "rejected", "in_review", ("editor", "reviewer", "admin")),
    ("publish", "approved", "published", ("publisher", "admin")),
    ("revoke", "approved", "revoked", ("reviewer", "admin")),
)
# Words of a strong claim.
STRONG_CLAIMS = ("always", "never", "guarantee", "must", "shall")


# ---- gates --------------------------------------------------------------------------------------------------------


def coverage_level(chunks: Column, average: Column) -> Column:
    return F.when((chunks >= 4) & (average >= 0.75), "high").when((chunks >= 2) & (average >= 0.62), "medium").otherwise("low")


def evidence_stats(hits: DataFrame) -> DataFrame:
    """Per question: chunks, average score, repositories (non-blank), alignment (mean vector score, 4 decimals)."""
    repository = F.when(F.trim("repository_url") != "", F.col("repository_url"))
    return hits.groupBy("question_id").agg(F.count("*").alias("chunks"), F.avg("score").alias("average"), F.count_distinct(repository).alias("repositories"), F.round(F.avg("vector"), 4).alias("alignment"))


def partial_evidence(chunks: Column, average: Column, confidence: Column, alignment: Column, repositories: Column, scopes: Column, answered: Column) -> Column:
    """Reason why an answer is provisional, or null. `answered`: it comes from retrieval and isn't an abstention."""
    reason = (
        F.when(chunks == 0, "LIMITED_EVIDENCE_COVERAGE")
        .when((confidence < 0.72) | (alignment < 0.40), "LOW_RETRIEVAL_CONFIDENCE")
        .when((chunks < 2) | (coverage_level(chunks, average) == "low"), "LIMITED_EVIDENCE_COVERAGE")
        .when((scopes > 1) & (repositories < F.least(F.lit(2), scopes)), "CROSS_STANDARD_GAP")
    )
    return F.when(answered, reason)


def evidence_gate(chunks: Column, alignment: Column, repositories: Column, scopes: Column, least: int = 1, aligned: float = 0.30, spread: int = 2) -> Column:
    """Reason why generation is refused, or null."""
    gap = (scopes > 1) & (repositories < F.least(scopes, F.lit(spread)))
    return F.when(chunks < least, "INSUFFICIENT_EVIDENCE").when(alignment < aligned, "LOW_RETRIEVAL_CONFIDENCE").when(gap, "CROSS_STANDARD_GAP")


def dominant_repository(hits: DataFrame) -> DataFrame:
    """(question_id, repository_url): the largest sum of scores, which lose 8 % a rank down to half; ties by name."""
    weight = F.greatest(F.lit(0.5), 1 - 0.08 * (F.col("nth") - 1))
    sums = hits.groupBy("question_id", "repository_url").agg(F.sum(F.col("score") * weight).alias("weight"))
    return latest_by(sums, ["question_id"], F.desc("weight"), F.asc("repository_url"))


def standard_partitions(hits: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(question_id, standard, evidence_count, avg_score, signals): each chunk goes to the first standard it is scoped to, else names.

    `conflict` tells that one standard's texts oblige, another's allow, and a subject is shared.
    """
    blob = F.lower(F.concat_ws("\n", "repository_url", "source_path", "label", "text"))
    own, named = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in reversed(scope):
        own = F.when(F.array_contains("standards_scope", s), s).otherwise(own)
        named = F.when(blob.contains(s.lower()), s).otherwise(named)
    body = F.lower("text")
    placed = hits.withColumn("standard", F.coalesce(own, named)).where("standard IS NOT NULL")
    has = lambda *words: F.bool_or(T.contains_any(body, words))
    out = placed.groupBy("question_id", "standard").agg(
        F.count("*").alias("evidence_count"),
        F.avg("score").alias("avg_score"),
        has("shall", "must", "required").alias("mandatory"),
        has("may", "optional").alias("optional"),
        has("journey", "delay", "pattern", "timetable", "exchange").alias("subject"),
    )
    w = Window.partitionBy("question_id")
    conflict = F.bool_or("mandatory").over(w) & F.bool_or("optional").over(w) & F.bool_or("subject").over(w)
    return out.withColumn("conflict", conflict if len(scope) > 1 else F.lit(False))


def semantic_rules(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: which evidence rules match, and how many."""
    schema = F.lower("doc_type") == "schema"
    required = (F.size("required_children") > 0) | (F.size("required_attributes") > 0)
    seen = hits.groupBy("question_id").agg(
        F.bool_or(schema).alias("schema_evidence"), F.bool_or(schema & required).alias("constrained"), F.bool_or(F.size("concepts") > 0).alias("ontology_anchor"), F.array_distinct(F.flatten(F.collect_list("standards_scope"))).alias("standards")
    )
    out = questions.join(seen, "question_id", "left").withColumns({"intent": T.intent("question"), "normativity": T.normativity("question")})
    no = lambda c: F.coalesce(c, F.lit(False))
    out = out.select(
        "question_id",
        no(F.col("schema_evidence")).alias("schema_evidence"),
        no((F.col("normativity") == "mandatory") & F.col("constrained")).alias("mandatory_constraint"),
        no(F.col("intent").isin("cross_standard_relation", "comparison") & (F.size("standards") > 1)).alias("cross_standard"),
        no(F.col("ontology_anchor")).alias("ontology_anchor"),
    )
    flags = ("schema_evidence", "mandatory_constraint", "cross_standard", "ontology_anchor")
    return out.withColumn("matched", sum(F.col(f).cast("int") for f in flags))


def competency_matches(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """(question_id, id): competency questions whose standard, rule and terms fit. questions: scope, terms, intent, normativity.

    A question without a scope is held to the standards of its chunks, if it has them as `seen`; without either, every standard fits.
    """
    given = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.trim(T.text(s)) != "")
    scope = given("scope")
    if "seen" in questions.columns:
        scope = F.when(F.size(scope) > 0, scope).otherwise(given("seen"))
    questions = questions.withColumn("scope", scope)
    any_term = lambda *t: F.arrays_overlap("terms", F.array(*map(F.lit, t)))
    named = lambda part, ok: ~F.col("id").contains(part) | ok
    standard = F.lower(F.trim("standard"))
    fits = (
        ((standard == "") | (F.size("scope") == 0) | F.array_contains(F.transform("scope", lambda s: F.lower(F.trim(s))), standard))
        & (~F.col("requires_rule") | F.col("normativity").isin("mandatory", "recommended"))
        & named("STOP", any_term("stop", "stopplace", "stop place"))
        & named("SVC", any_term("service", "timetable"))
        & named("JRP", any_term("journeypattern", "servicejourneypattern", "journey pattern"))
        & named("ID", any_term("id"))
        & named("ROLE", F.col("intent").isin("definition", "cross_standard_relation", "comparison"))
    )
    return questions.join(small(registry.where("id <> ''")), fits).select("question_id", "id", "requires_rule", "rule_id")


def policy(answer: Column, citations: Column, approved: Sequence[str], strict: bool = False) -> Column:
    """Reason why an answer is blocked, or null. citations: array of addresses."""
    known = F.forall(citations, lambda u: T.repository_root(u).isin(*approved))
    out = F.when(F.trim(T.text(answer)) == "", "UNKNOWN").when(F.size(citations) <= 0, "INSUFFICIENT_EVIDENCE").when(~known, "POLICY_BLOCK")
    return out.when(T.contains_any(T.lowered(answer), STRONG_CLAIMS) & (F.size(citations) < 2), "INSUFFICIENT_EVIDENCE") if strict else out


def draft_answer(question: Column, top_score: Column, chunks: Column, repositories: Column) -> Column:
    """Deterministic answer (text, confidence, review_required) where no model answers; lists of examples excepted."""
    markers = F.array_join(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.greatest(F.lit(1), chunks.cast("int")))), lambda i: F.concat(F.lit("[E"), i.cast("string"), F.lit("]"))), ", ")
    body = F.concat(F.lit("Based on retrieved approved-source evidence ("), markers, F.lit("), follow the relevant profile specification and validate implementation against published examples or test cases before deployment."))
    body = F.concat(body, F.when(repositories >= 2, " Evidence spans multiple repositories.").otherwise(""))
    confidence = F.when(chunks == 0, 0.0).otherwise(F.least(F.lit(0.9), F.greatest(F.lit(0.55), top_score)))
    none = F.lit("I do not have sufficient approved-source evidence to answer this safely.")
    return F.struct(F.when(chunks == 0, none).otherwise(body).alias("answer"), confidence.alias("confidence"), ((chunks > 0) & (confidence < 0.8)).alias("review_required"))


def grounded_lines(c: Column) -> Column:
    """Normalised lines of eight characters or more that look like code."""
    lines = F.transform(F.split(T.text(c), r"\r\n|\r|\n"), lambda x: F.lower(T.squeezed(x)))
    return F.filter(lines, lambda x: (F.length(x) >= 8) & x.rlike("[<>/=]"))


def grounded_example(answer: Column, evidence: Column) -> Column:
    """Whether the lines of an answer's fenced blocks are found in the evidence: 3 at least, and two thirds of them."""
    blocks = F.regexp_extract_all(T.text(answer), F.lit(r"(?s)```[A-Za-z]*\n(.*?)```"), F.lit(1))
    known = grounded_lines(evidence)

    def ok(block: Column) -> Column:
        lines = grounded_lines(block)
        hit = F.size(F.filter(lines, lambda x: F.array_contains(known, x)))
        return (F.size(lines) == 0) | (hit >= F.greatest(F.lit(3), F.floor((F.size(lines) * 2 + 2) / 3)))

    return F.forall(blocks, ok)


# ---- FAQ ----------------------------------------------------------------------------------------------------------


def current_faqs(entries: DataFrame, versions: DataFrame, *ties: Column) -> DataFrame:
    """Active entries with their latest published version; rows of one version number are ordered by `ties`."""
    live = versions.where("is_published").join(entries.where("is_active"), "faq_entry_id")
    return latest_by(live, ["faq_entry_id"], F.desc("version"), *ties)


def faq_matches(questions: DataFrame, faqs: DataFrame) -> DataFrame:
    """The best FAQ of each question that doesn't seek examples: stemmed hits over keyword tokens; two hits where there are three tokens.

    Stems meet by equality, so questions and entries are never paired without a common one. Ties go to the smaller entry id.
    """
    given = F.filter("keyword_tokens", lambda t: t.isNotNull())
    base = F.array_distinct(F.when(F.size(given) > 0, given).otherwise(F.filter(F.split(T.text("normalized_intent"), r"\s+"), lambda t: F.length(t) > 2)))
    keys = faqs.withColumn("base", base).select("faq_entry_id", F.size("base").alias("size"), F.explode(F.array_distinct(F.transform("base", T.stem))).alias("stem"))
    asked = questions.where(~T.example_seeking("question")).select("question_id", F.explode(T.stems("question")).alias("stem"))
    hits = asked.join(keys, "stem").groupBy("question_id", "faq_entry_id", "size").agg(F.count("*").alias("hits"))
    scored = hits.where(F.col("hits") >= F.when(F.col("size") >= 3, 2).otherwise(1)).withColumn("score", F.col("hits") / F.col("size"))
    return latest_by(scored, ["question_id"], F.desc("score"), F.asc("faq_entry_id"))


def next_versions(versions: DataFrame, drafts: DataFrame) -> DataFrame:
    """Drafts as new versions of their entries: numbers continue after the largest; confidence 0 becomes .85."""
    last = versions.groupBy("faq_entry_id").agg(F.max("version").alias("last"))
    nth = F.row_number().over(Window.partitionBy("faq_entry_id").orderBy("created_at", "draft_id"))
    confidence = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.85).otherwise(F.col("confidence"))
    return drafts.join(last, "faq_entry_id", "left").withColumn("version", F.coalesce("last", F.lit(0)) + nth).withColumn("confidence", confidence).drop("last")


def faq_id(question: Column) -> Column:
    return F.concat(F.lit("faq-auto-"), F.sha1(F.lower(T.squeezed(question)).cast("binary")).substr(1, 12))


# ---- provenance ---------------------------------------------------------------------------------------------------


def cited_chunks(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (answer_id, position, chunk_id) with their retrieved chunk; those without one are left out, and positions close up.

    Links are named by the citation's own position, so after a gap later pairs shift: `link_id` is that of the closed-up position.
    """
    out = citations.join(chunks, "chunk_id")
    nth = F.row_number().over(Window.partitionBy("answer_id").orderBy("position"))
    return out.withColumn("nth", nth.cast("long")).withColumn("link_id", F.concat(F.lit("el-"), F.col("answer_id").cast("string"), F.lit("-"), F.col("nth").cast("string")))


def evidence_links(citations: DataFrame) -> DataFrame:
    return citations.withColumn("link_id", F.concat_ws("-", F.lit("el"), F.col("answer_id").cast("string"), F.col("position").cast("string")))


# ---- workflow -----------------------------------------------------------------------------------------------------


def transitions(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(a).alias("action"), F.lit(x).alias("from_status"), F.lit(y).alias("to_status"), F.array(*map(F.lit, r)).alias("roles")) for a, x, y, r in TRANSITIONS]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def allowed_actions(items: DataFrame) -> DataFrame:
    """items (status, roles) with the sorted actions their roles may take."""
    out = F.array().cast("array<string>")
    for action, status, _, roles in TRANSITIONS:
        may = (F.col("status") == status) & F.arrays_overlap("roles", F.array(*map(F.lit, roles)))
        out = F.when(F.coalesce(may, F.lit(False)), F.concat(out, F.array(F.lit(action)))).otherwise(out)
    return items.withColumn("actions", F.array_sort(out))


def apply_transitions(requests: DataFrame) -> DataFrame:
    """Requests (status, action, roles) with outcome ok, forbidden or not_allowed, and the new status."""
    rules = transitions(requests.sparkSession).withColumnsRenamed({"from_status": "status", "roles": "may"})
    out = requests.join(F.broadcast(rules), ["status", "action"], "left")
    outcome = F.when(F.col("to_status").isNull(), "not_allowed").when(F.coalesce(F.arrays_overlap("roles", "may"), F.lit(False)), "ok").otherwise("forbidden")
    out = out.withColumn("outcome", outcome)
    return out.withColumn("new_status", F.when(F.col("outcome") == "ok", F.col("to_status")).otherwise(F.col("status"))).drop("may", "to_status")


# ---- queue --------------------------------------------------------------------------------------------------------



def routed(requests: DataFrame) -> DataFrame:
    """Requests (event_id, reason, priority) as queue items in review; a missing reason or priority takes the default.

    `error` names a field that holds another value, or event_id where it is blank; such rows have no status.
    """
    reason, priority = F.coalesce("reason", F.lit("USER_ESCALATION")), F.coalesce("priority", F.lit("normal"))
    error = F.when(F.trim(T.text(F.col("event_id").cast("string"))) == "", "event_id").when(~reason.isin(*REASONS), "reason").when(~priority.isin(*PRIORITIES), "priority")
    return requests.withColumns({"error": error, "reason": reason, "priority": priority}).withColumn("status", F.when(F.col("error").isNull(), "in_review"))


def queue_citations(items: DataFrame, links: DataFrame) -> DataFrame:
    """(queue_item_id, citations) of each item: its event's evidence links by time and id, with their files' addresses; none is an empty list."""
    fields = [T.file_url(F.col("repository_url"), F.col("commit_sha"), F.col("source_path")).alias("repository_url"), "commit_sha", "source_path", "chunk_id", "label"]
    held = links.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "link_id", F.struct(*fields).alias("c")))).alias("l"))
    out = items.select("queue_item_id", "event_id").join(held, "event_id", "left").withColumn("citations", F.transform("l", lambda x: x["c"]))
    none = F.filter(F.array(F.struct(*(F.lit("").alias(n) for n in ("repository_url", "commit_sha", "source_path", "chunk_id", "label")))), lambda _: F.lit(False))
    return out.select("queue_item_id", F.coalesce("citations", none).alias("citations"))


def console_rows(asked: DataFrame, board: DataFrame, status: str | None = None) -> DataFrame:
    """Asked questions with their board status ('' without an item, the last item's where there are several), those of one status if given."""
    latest = board.groupBy("request_id").agg(F.max_by("status", F.struct("created_at", "queue_item_id")).alias("status"))
    out = asked.join(latest, "request_id", "left").withColumn("status", F.coalesce("status", F.lit("")))
    return out if status is None else out.where(F.col("status") == status)


def console_order(by: str | None, descending: bool = False) -> list[Column]:
    """Order of the console's rows by asked_at, confidence, likes (less dislikes) or status; request ids end ties. None keeps ids alone."""
    keys = {"asked_at": F.col("asked_at"), "confidence": F.col("confidence"), "likes": F.col("likes") - F.col("dislikes"), "status": F.col("status")}
    if by is None:
        return [F.asc("request_id")]
    return [keys[by].desc() if descending else keys[by].asc(), F.asc("request_id")]


def competency_registry(spark: SparkSession, path: str) -> DataFrame:
    """Competency questions (id, standard, requires_rule, rule_id) of a JSON document {"competencyQuestions": [...]}; a missing file has none."""
    schema = "competencyQuestions array<struct<id: string, standard: string, requiresRule: boolean, ruleId: string>>"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], "id string, standard string, requires_rule boolean, rule_id string")
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("competencyQuestions").alias("q"))
    return rows.select(T.text("q.id").alias("id"), T.text("q.standard").alias("standard"), F.coalesce("q.requiresRule", F.lit(False)).alias("requires_rule"), F.col("q.ruleId").alias("rule_id"))

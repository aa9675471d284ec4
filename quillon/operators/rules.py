"""Evidence rules of an answer: which were evaluated for a question, which matched, and what follows from them.

One row a question and rule: `kind` names the conclusion of a matched rule, and the columns after it what it rests on. The rule on mandatory
constraints is evaluated for mandatory questions only. Defined results: a question without chunks has its rules unmatched; chunks
without standards leave the question's scope as the standards seen; null lists and types are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import governance as G
from quillon.operators.retrieval import top_k

# Rules, and the conclusion each leads to.
RULES = (
    ("schema_evidence_present", "SCHEMA_EVIDENCE_PRESENT"),
    ("mandatory_schema_constraint", "MANDATORY_SCHEMA_CONSTRAINT"),
    ("competency_questions_matched", "COMPETENCY_QUESTION_MATCH"),
    ("cross_standard_review", "CROSS_STANDARD_REVIEW_RECOMMENDED"),
    ("ontology_anchor_present", "ONTOLOGY_ANCHOR_PRESENT"),
)
#: Constrained schema chunks that a conclusion names. Fixed value.
ARTIFACTS = 3


def evaluated(hits: DataFrame, questions: DataFrame, registry: DataFrame) -> DataFrame:
    """(question_id, rule_id, matched, kind, standards, competency_ids, requires_rule_count, artifacts).

    hits: question_id, nth, doc_type, standards_scope, source_path, heading, required_children, required_attributes, concepts;
    questions: question_id (unique), question, scope, terms; registry: id, standard, requires_rule, rule_id.
    """
    none = F.array().cast("array<string>")
    filled = lambda c: F.coalesce(F.col(c), none)
    schema = F.lower(T.text("doc_type")) == "schema"
    required = (F.size(filled("required_children")) > 0) | (F.size(filled("required_attributes")) > 0)
    flags = hits.groupBy("question_id").agg(F.bool_or(schema).alias("has_schema"), F.bool_or(F.size(filled("concepts")) > 0).alias("anchored"))
    seen = hits.select("question_id", F.explode("standards_scope").alias("s")).where(T.text("s") != "").groupBy("question_id").agg(F.array_sort(F.collect_set("s")).alias("seen"))
    bound = top_k(hits.where(schema & required), ARTIFACTS, F.asc("nth"), F.asc("source_path"))
    artifact = F.struct("nth", F.struct("source_path", "heading", "required_children", "required_attributes").alias("a"))
    bound = bound.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(artifact)), lambda x: x["a"]).alias("artifacts"))
    asked = questions.select("question_id", filled("scope").alias("scope"), filled("terms").alias("terms"), T.intent("question").alias("intent"), T.normativity("question").alias("normativity"))
    rows = asked.join(flags, "question_id", "left").join(seen, "question_id", "left").join(bound, "question_id", "left")
    rows = rows.withColumn("seen", F.when(F.size(filled("seen")) > 0, F.col("seen")).otherwise(F.array_sort(F.array_distinct(F.filter("scope", lambda s: T.text(s) != "")))))
    fits = G.competency_matches(rows.select("question_id", "scope", "seen", "terms", "intent", "normativity"), registry)
    fits = fits.groupBy("question_id").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count_if("requires_rule").alias("requires"))
    rows = rows.join(fits, "question_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    matched = {
        "schema_evidence_present": no(F.col("has_schema")),
        "mandatory_schema_constraint": F.col("artifacts").isNotNull(),
        "competency_questions_matched": F.col("ids").isNotNull(),
        "cross_standard_review": F.col("intent").isin("cross_standard_relation", "comparison") & (F.size("seen") > 1),
        "ontology_anchor_present": no(F.col("anchored")),
    }
    each = F.array(*(F.struct(F.lit(r).alias("rule_id"), matched[r].alias("matched"), F.when(matched[r], k).alias("kind")) for r, k in RULES))
    each = F.filter(each, lambda r: (r["rule_id"] != "mandatory_schema_constraint") | (F.col("normativity") == "mandatory"))
    out = rows.select("*", F.explode(each).alias("r")).select("*", "r.rule_id", "r.matched", "r.kind")
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    return out.select(
        "question_id", "rule_id", "matched", "kind", of("CROSS_STANDARD_REVIEW_RECOMMENDED", "seen").alias("standards"), of("COMPETENCY_QUESTION_MATCH", "ids").alias("competency_ids"),
        of("COMPETENCY_QUESTION_MATCH", "requires").alias("requires_rule_count"), of("MANDATORY_SCHEMA_CONSTRAINT", "artifacts").alias("artifacts"),
    )


def counts(rules: DataFrame) -> DataFrame:
    """(question_id, evaluated, matched, competency_ids) of evaluated rules."""
    ids = F.coalesce(F.flatten(F.collect_list("competency_ids")), F.array().cast("array<string>"))
    return rules.groupBy("question_id").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("matched").alias("matched"), ids.alias("competency_ids"))

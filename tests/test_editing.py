"""Spelling, publication and benchmark runs against plain Python versions and broken writes."""


from datetime import datetime, timedelta
from hashlib import sha1, sha256

import pytest
from pyspark.sql import functions as F

from quillon.operators import publication as P
from quillon.operators import rules as U
from quillon.operators import runners as N
from quillon.operators import spelling as S
from quillon.sources import commits


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    yield from (a + b[1:] for a, b in cuts if b)
    yield from (a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1)
    yield from (a + c + b[1:] for a, b in cuts if b for c in letters)
    yield from (a + c + b for a, b in cuts for c in letters)


def nearest(word, known):
    """The known word that edits of edits reach first, most frequent first."""
    letters = sorted(set("".join(known)))
    one = set(edits(word, letters))
    for d, reach in ((1, one), (2, {y for x in one for y in edits(x, letters)})):
        found = [w for w in reach if w in known]
        if found:
            return min(found, key=lambda w: (-known[w], w)), d
    return None


def test_corrections_against_edits_of_edits(spark):
    known = {"stop": 9, "stops": 4, "journey": 7, "journeys": 7, "abc": 3, "été": 5, "timetable": 6, "time": 8, "tame": 8, "on": 2, "no": 2}
    words = ["sotp", "stpo", "ca", "ete", "timetabel", "timteabel", "tmie", "jorney", "jurneys", "timetablexx", "xxtimetable", "stop", "zzzzzz", "b", "tine", "nn", "itmetabel", "ournej"]
    lexicon = spark.createDataFrame([("x", w, n) for w, n in known.items()] + [("y", "sotp", 50)], "lang string, word string, documents long")
    asked = spark.createDataFrame([("x", w) for w in words * 2], "lang string, word string")
    got = {r.word: (r.correction, r.distance) for r in S.corrections(asked, lexicon).collect()}
    want = {w: nearest(w, known) for w in words if w not in known}
    assert got == {w: v for w, v in want.items() if v}
    assert got["ca"] == ("abc", 2) and got["sotp"] == ("stop", 1) and "zzzzzz" not in got
    near = {r.word: r.correction for r in S.corrections(asked, lexicon, most=1).collect()}
    assert near == {w: v[0] for w, v in want.items() if v and v[1] == 1}
    with pytest.raises(ValueError):
        S.corrections(asked, lexicon, most=3)


def test_questions_keep_technical_words_and_marks(spark):
    texts = ["where does the journey begin", "the journey ends where it begin", "le voyage commence", None, ""]
    chunks = spark.createDataFrame([(t, "fr" if t and t.startswith("le") else "en", "s") for t in texts], "text string, lang string, source string")
    known = S.lexicon(chunks, 1)
    assert {(r.lang, r.word): r.documents for r in known.collect()}["en", "journey"] == 2
    asked = [(1, 'where  does the "jorney" beginn?'), (2, "Jorney jorney_x <jorney> StopPlace the j0rney where"), (3, None), (4, ""), (5, "zq xv"), (6, "le voyge"), (7, "where does  the journey")]
    got = {r.question_id: (r.corrected, r.changes) for r in S.corrected(spark.createDataFrame(asked, "question_id long, question string"), known).collect()}
    assert got == {
        1: ('where does the "journey" begin?', 2), 2: (asked[1][1], 0), 3: (None, 0), 4: ("", 0), 5: ("zq xv", 0), 6: ("le voyage", 1), 7: ("where does  the journey", 0),
    }
    none = chunks.where("false")
    assert S.corrected(spark.createDataFrame(asked, "question_id long, question string"), S.lexicon(none)).where("changes > 0").count() == 0


# ---- workflow and publication -------------------------------------------------------------------------------------

EVENTS = "event_id string, question string, answer string, standards_scope array<string>, matched_faq_entry_id string, core_concept string, confidence double"
LINKS = "event_id string, created_at string, link_id string, repository_url string, commit_sha string, source_path string, chunk_id string, label string"
REQUESTS = "request_id string, queue_item_id string, action string, roles array<string>, requested_at timestamp, actor_id string, comment string"


def at(n):
    return datetime(2026, 1, 1) + timedelta(minutes=n)


def asked(spark, *rows):
    """Requests from (id, item, action, roles, minute)."""
    return spark.createDataFrame([(r, i, a, who.split(), at(m), "me", None) for r, i, a, who, m in rows], REQUESTS)


@pytest.fixture
def desk(spark, tmp_path):
    """A state with four items, and their events and links."""
    root = str(tmp_path / "state")
    items = [("q1", "e1", "in_review"), ("q2", "e2", "in_review"), ("q3", "e3", "approved"), ("q4", "e4", "approved")]
    P.start(spark, root, spark.createDataFrame([(*i, at(0)) for i in items], "queue_item_id string, event_id string, status string, updated_at timestamp"))
    events = spark.createDataFrame(
        [("e1", " What is a journey? ", "A ride.\n", ["SIRI", " NeTEx", "", "SIRI"], "", "netex:Journey", 0.0), ("e2", "Hello", "World", None, "faq-7", "nits:unknown-concept", 0.4), ("e3", "Hello", "Again", None, "faq-7", "nits:unknown-concept", None), ("e4", "Hello", " ", None, None, "x", 0.4)],
        EVENTS,
    )
    links = spark.createDataFrame([("e1", "2", "b", "https://example.org/r", "main", "docs/b.md", "c2", "B"), ("e1", "1", "a", "https://example.org/r", "main", "docs/a.md", "c1", "A")], LINKS)
    return root, events, links


def table(spark, root, name, upto=None):
    return {tuple(r[k] for k in P.KEYS[name]): r for r in commits.rows_of(spark, root, name, P.KEYS[name], upto).collect()}


def test_requests_follow_each_other_and_publish(spark, desk):
    root, events, links = desk
    batch = asked(
        spark, ("r3", "q1", "publish", "publisher", 3), ("r1", "q1", "publish", "publisher", 1), ("r2", "q1", "approve", "reviewer", 2), ("r4", "q1", "revoke", "admin", 4), ("r5", "q2", "approve", "editor", 1), ("r6", "q2", "request_changes", "admin", 2),
        ("r7", "q2", "approve", "editor admin", 3), ("r8", "q2", "publish", "admin", 4), ("r9", "q3", "publish", "admin", 9), ("ra", "q4", "publish", "admin", 1), ("rb", "q4", "revoke", "reviewer", 2), ("rc", "no", "revoke", "admin", 1), ("rd", None, "revoke", "admin", 1), ("r9", "q3", "publish", "admin", 10),
    )
    assert P.apply_requests(spark, root, batch, events, links) == 2
    said = {k[0]: v.outcome for k, v in table(spark, root, "responses").items()}
    assert said == {"r1": "not_allowed", "r2": "ok", "r3": "ok", "r4": "not_allowed", "r5": "forbidden", "r6": "not_allowed", "r7": "ok", "r8": "ok", "r9": "ok", "ra": "incomplete", "rb": "ok", "rc": "unknown_item", "rd": "unknown_item"}
    assert {k[0]: v.status for k, v in table(spark, root, "queue_items").items()} == {"q1": "published", "q2": "published", "q3": "published", "q4": "revoked"}
    audit = table(spark, root, "audit")
    assert {k[0] for k in audit} == {k for k, v in said.items() if v == "ok"}
    assert (audit["r7",].from_status, audit["r7",].to_status, audit["r7",].actor_roles, audit["r7",].comment) == ("in_review", "approved", ["admin", "editor"], "")
    made = "faq-auto-" + sha1(b"definition netex:Journey|NeTEx|SIRI").hexdigest()[:12]
    entries, versions = table(spark, root, "faq_entries"), table(spark, root, "faq_versions")
    assert set(entries) == {(made,), ("faq-7",)} and entries[made,].standards_scope == ["SIRI", "NeTEx"] and entries["faq-7",].normalized_intent == "hello"
    assert {k: (v.answer, v.confidence, [c.chunk_id for c in v.citations]) for k, v in versions.items()} == {(made, 1): ("A ride.", 0.85, ["c1", "c2"]), ("faq-7", 1): ("World", 0.4, []), ("faq-7", 2): ("Again", 0.85, [])}

    before = {n: table(spark, root, n) for n in P.KEYS}
    assert P.apply_requests(spark, root, batch, events, links) == 3  # again: every request has its answer
    assert {n: table(spark, root, n) for n in P.KEYS} == before
    assert commits.compact(spark, root, P.KEYS) == 4
    assert {n: table(spark, root, n) for n in P.KEYS} == before
    assert len(table(spark, root, "faq_versions", 1)) == 0 and table(spark, root, "queue_items", 1)["q1",].status == "in_review"


def test_a_write_that_breaks_shows_nothing(spark, desk):
    root, events, links = desk
    batch = asked(spark, ("r1", "q1", "approve", "admin", 1), ("r2", "q1", "publish", "admin", 2))
    before = {n: table(spark, root, n) for n in P.KEYS}
    broken = events.withColumn("answer", F.when(F.col("event_id") == "e1", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("answer")))
    with pytest.raises(Exception, match="lost"):
        P.apply_requests(spark, root, batch, broken, links)
    half = {"queue_items": spark.createDataFrame([("q1", "e1", "published", at(1))], "queue_item_id string, event_id string, status string, updated_at timestamp"), "audit": spark.range(1).select(F.raise_error(F.lit("lost")).alias("x"))}
    with pytest.raises(Exception, match="lost"):
        commits.commit(spark, root, half, 1)  # the queue's rows are written, the audit's are not
    assert {n: table(spark, root, n) for n in P.KEYS} == before and commits.version(spark, root) == 1
    assert P.apply_requests(spark, root, batch, events, links) == 2
    assert table(spark, root, "queue_items")["q1",].status == "published" and len(table(spark, root, "faq_versions")) == 1


def test_of_two_commits_on_one_state_one_is_refused(spark, desk, monkeypatch):
    root = desk[0]
    row = lambda status: {"queue_items": spark.createDataFrame([("q1", "e1", status, at(1))], "queue_item_id string, event_id string, status string, updated_at timestamp")}
    assert commits.commit(spark, root, row("approved"), 1) == 2
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, row("rejected"), 1)
    monkeypatch.setattr(commits, "version", lambda *_: 1)  # as if the other's pointer came after the first look
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, row("rejected"), 1)
    monkeypatch.undo()
    assert table(spark, root, "queue_items")["q1",].status == "approved"


def test_keywords(spark):
    words = " ".join(f"word{chr(97 + i)}" for i in range(20))
    rows = spark.createDataFrame([(words, ["A"] * 3), (words, [f"t{i}" for i in range(15)]), ("What is this Stop, the stop?", ["Stop"]), (None, [])], "q string, t array<string>")
    got = [r[0] for r in rows.select(P.keyword_tokens(F.col("q"), F.col("t"))).collect()]
    assert [len(g) if g is not None else 0 for g in got] == [12, 16, 1, 0]


def test_many_requests_of_one_item(spark):
    """They are streamed through several batches and keep their order."""
    n = 25_000
    items = spark.createDataFrame([("q", "in_review", True)], "queue_item_id string, status string, complete boolean")
    steps = F.element_at(F.array(F.lit("reject"), F.lit("reopen")), (F.col("id") % 2 + 1).cast("int"))
    rows = spark.range(n).select(F.format_string("%06d", "id").alias("request_id"), F.lit("q").alias("queue_item_id"), steps.alias("action"), F.array(F.lit("admin")).alias("roles"), F.lit(at(0)).alias("requested_at"))
    got = P.transitioned(items, rows).groupBy("outcome", "to_status").count().collect()
    assert {(r.outcome, r.to_status): r["count"] for r in got} == {("ok", "rejected"): n // 2, ("ok", "in_review"): n // 2}


# ---- benchmark runs -----------------------------------------------------------------------------------------------


@pytest.fixture
def bank(spark):
    """21 questions, one blank; the wanted ones, with one that isn't there and one given twice."""
    rows = [(i, f"question {i}" if i != 4 else " ", [f"p{i}."], 1) for i in range(21)]
    questions = spark.createDataFrame(rows, "question_id long, question string, patterns array<string>, min_hits int")
    wanted = [(i, f"intent{i % 3}") for i in range(21)] + [(99, "intent0"), (7, "intent1")]
    return questions, spark.createDataFrame(wanted, "question_id long, intent string")


def hold(broken):
    """A retrieval with the right path as the second of two, nothing for question 5, and a failing plan for `broken`."""

    def answer(batch):
        q = F.col("question_id")
        fails = F.when(q.isin(*broken), F.raise_error(F.concat(F.lit("broken "), q.cast("string"))).cast("string"))
        paths = F.array(F.coalesce(fails, F.lit("a.md")), F.concat(F.lit("p"), q.cast("string"), F.lit(".md")))
        return batch.where("question_id <> 5").select("question_id", F.posexplode(paths).alias("nth", "source_path"))

    return answer


def test_broken_questions_are_rows_and_the_run_goes_on(spark, bank):
    questions, wanted = bank
    out = N.run(wanted, questions, hold([3, 11]), size=6)
    rows = {r.question_id: r for r in out.results.collect()}
    assert len(rows) == 22 and {i for i, r in rows.items() if r.error} == {3, 4, 11, 99}
    assert rows[99].error == "not found" and rows[4].error == "empty question" and "broken 3" in rows[3].error
    good = {i: (r.chunks, r.hit_at_5, r.mrr_at_10) for i, r in rows.items() if not r.error}
    assert good == {i: (0, False, 0.0) if i == 5 else (2, True, 0.5) for i in range(21) if i not in (3, 4, 11)}
    assert all((r.elapsed_ms is None) == bool(r.error) for r in rows.values()) and rows[3].hit_at_5 is None
    assert sum(s["questions"] for s in out.stages) == 18 and sum(s["chunks"] for s in out.stages) == 34
    with pytest.raises(ValueError):
        N.run(wanted, questions, hold([]), fail_fast=True)


def test_gates_judge_the_run(spark, bank):
    rows = [(1, "a", 100.0, None), (2, "a", 120.0, None), (3, "b", 300.0, None), (4, "b", None, "lost")]
    frame = lambda rows: spark.createDataFrame([(i, t, ms, 1, e is None, 1.0, e) for i, t, ms, e in rows], "question_id long, intent string, elapsed_ms double, chunks long, hit_at_5 boolean, mrr_at_10 double, error string")
    now, before = frame(rows), frame([(1, "a", 100.0, None), (2, "a", 100.0, None), (3, "c", 320.0, None)])
    one = N.summary(now).first()
    assert (one.questions, one.ok, one.errors, one.p50) == (4, 3, 0.25, 120.0)
    gates = {r.gate: r.passed for r in N.judged(now, "stratified", before).collect()}
    assert gates == {"errors": False, "average": True, "p95": True, "intent a": True, "intent b": True}
    assert {r.gate: r.passed for r in N.judged(now, "canary", before).collect()} == {"errors": False, "p50": False, "p95": True}
    assert [(r.gate, r.passed) for r in N.judged(frame(rows[:3]), "full").collect()] == [("errors", True)]
    none = N.summary(now.where("false")).first()
    assert (none.questions, none.errors, none.average) == (0, 0.0, None)


def test_strata_are_the_same_each_time(spark):
    rows = spark.range(100).select(F.col("id").alias("question_id"), F.when(F.col("id") < 3, "few").otherwise("many").alias("intent"))
    got = {(r.intent, r.question_id) for r in N.stratified(rows, 5).collect()}
    many = sorted(range(3, 100), key=lambda i: sha256(str(i).encode()).hexdigest())[:5]
    assert got == {("few", i) for i in range(3)} | {("many", i) for i in many}
    assert N.stratified(rows.where("false"), 5).count() == 0


# ---- rules --------------------------------------------------------------------------------------------------------


def test_evaluated_rules(spark):
    hits = spark.createDataFrame(
        [(1, n, "Schema", ["SIRI", "NeTEx", None, ""], f"s{n}.xsd", "h", ["a"] if n != 2 else [], None, []) for n in range(6)] + [(2, 1, None, None, "x.md", None, None, None, ["c"]), (3, 1, "guide", ["OpRa"], "y.md", "h", ["a"], [], None)],
        "question_id long, nth int, doc_type string, standards_scope array<string>, source_path string, heading string, required_children array<string>, required_attributes array<string>, concepts array<string>",
    )
    questions = spark.createDataFrame([(1, "A stop shall have a name", None, ["stop"]), (2, "compare them", ["SIRI", "NeTEx"], []), (3, "what is it", [], None), (4, None, None, None)], "question_id long, question string, scope array<string>, terms array<string>")
    registry = spark.createDataFrame([("CQ-STOP", "netex", True, "r"), ("CQ-ROLE", "", False, None), ("", "", False, None)], "id string, standard string, requires_rule boolean, rule_id string")
    out = U.evaluated(hits, questions, registry)
    rows = {(r.question_id, r.rule_id): r for r in out.collect()}
    assert {k for k, r in rows.items() if r.matched} == {(1, "schema_evidence_present"), (1, "mandatory_schema_constraint"), (1, "competency_questions_matched"), (2, "competency_questions_matched"), (2, "cross_standard_review"), (2, "ontology_anchor_present"), (3, "competency_questions_matched")}
    assert (2, "mandatory_schema_constraint") not in rows and all((r.kind is None) != r.matched for r in rows.values())
    assert [a.source_path for a in rows[1, "mandatory_schema_constraint"].artifacts] == ["s0.xsd", "s1.xsd", "s3.xsd"]
    assert rows[2, "cross_standard_review"].standards == ["NeTEx", "SIRI"]  # chunks without standards leave the scope
    assert (rows[1, "competency_questions_matched"].competency_ids, rows[1, "competency_questions_matched"].requires_rule_count) == (["CQ-STOP"], 1)
    assert {r.question_id: (r.evaluated, r.matched) for r in U.counts(out).collect()} == {1: (5, 3), 2: (4, 3), 3: (4, 1), 4: (4, 0)}
    empty = U.evaluated(hits.where("false"), questions, registry.where("false")).where("matched").collect()
    assert [(r.question_id, r.rule_id) for r in empty] == [(2, "cross_standard_review")]  # its scope alone names two standards

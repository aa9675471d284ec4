import json
import unicodedata

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillon.functions import dialogue as D
from quillon.operators import candidates as C
from quillon.operators import governance as G
from quillon.operators import graph as K
from quillon.operators import indexing as I
from quillon.operators import ontology as O


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_normalized_equals_python(spark):
    texts = ["ﬁne　ｔext  x", " plain \n text ", "", None, "Å ½ ℌ\x1c y", "a" * 5000 + "①", "é"]
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", D.normalized("t").alias("n")).orderBy("i").collect()]
    assert got == [" ".join(unicodedata.normalize("NFKC", t or "").split()) for t in texts]


def test_prompt(spark):
    null = F.lit(None).cast("string")
    r = one(spark, s=D.shortened(F.lit("abc  def"), 5), a=D.shortened(F.lit("abc"), 0), b=D.evidence_block(F.lit(2), F.lit("r"), null, F.lit("p"), F.lit(7), F.lit("abcdef"), 3), n=D.user_prompt(null, F.array().cast("array<string>"), F.array(F.lit("x"), F.lit("y")), F.lit("known")))
    assert r.s == "abc\n...[truncated for latency]" and r.a == "abc"
    assert r.b == "[E2] repository=r\n[E2] commit=\n[E2] source=p\n[E2] chunk=7\n[E2] text=abc\n...[truncated for latency]"
    assert r.n == "Question:\n\n\nRequested scope: all approved standards\n\nEditorial baseline:\nknown\n\nEvidence blocks:\nx\n\ny"


def test_controller(spark):
    cases = {
        None: (None, None, None, "payload"),
        'noise {"a": 1} {"route": broken, "confidence": 1}': (None, None, None, "payload"),
        'x {"route": "FAQ", "confidence": 3, "intent": " why "}': ("faq", "why", 1.0, None),
        '{"route": "faq|rag", "confidence": -1}': ("rag", "unknown", 0.0, None),
        '{"route": "none", "confidence": 1}': (None, None, None, "route"),
        '{"route": "rag", "confidence": null}': (None, None, None, "confidence"),
        '{"route": "rag", "confidence": true}': ("rag", "unknown", 1.0, None),
        '{"route": "rag", "intent": "the \\"confidence\\""}': ("rag", 'the "confidence"', 0.0, None),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", D.decision(D.payload("t")).alias("d")).orderBy("i").collect()
    for (text, want), r in zip(cases.items(), rows, strict=True):
        if text and '\\"' in text:  # an escaped key isn't the key itself
            assert r.d == Row(route=None, intent=None, confidence=None, error="payload")
        else:
            assert tuple(r.d) == want, text


def test_names(spark):
    null = F.lit(None).cast("string")
    r = one(spark, a=D.address_standard(null), b=D.address_name(F.lit("x#a#b")), c=D.address_name(null), i=D.instance_name(F.lit("a/Netex_1.2_two_WORDS.x.xml")), h=D.instance_name(null), r=D.repaired_root(F.lit("u/blob/m/x")), s=D.stored_standards(F.array(F.lit("OPRA "), null), F.lit(None).cast("array<string>")), l=D.element_label(F.lit("StopXMLRef")))
    assert r == Row(a="Ontology", b="a", c="", i="nexample:NeTExTwoWords.x", h="nexample:NeTEx", r="u", s=["opra"], l="stop xmlref")


CHUNKS = "chunk_id long, text string, source_path string, label string, heading string, doc_type string, quality_score double, standards_scope array<string>"


def test_alias_places(spark):
    """Each place by substring or by tokens, the first that fits; rank terms; scopes; the text scan only where few are found."""
    rows = [
        (1, "nothing", "examples/stop_place.xml", "l", "h", "example", 0.5, ["A"]),
        (2, "nothing", "a.xsd", "Place of a Stop", "h", "schema", 0.5, ["A"]),
        (3, "a Stop Place here", "b.xsd", None, None, "schema", 0.9, ["A"]),
        (4, "a stop place", "c.md", "stop place", "h", "guide", 0.9, ["A"]),
        (5, "stop place", "d.xsd", "", "", "schema", 0.9, ["B"]),
        (6, None, None, None, None, "schema", None, None),
        (7, "stop place", "stop place.xsd", "", "", "schema", 0.1, ["A"]),
    ]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = spark.createDataFrame([(1, "an xml example", ["A"]), (2, None, None), (3, "none", ["A"])], "question_id long, question string, scope array<string>")
    chosen = spark.createDataFrame([(1, "stop place"), (2, "stop place"), (2, "stop place"), (2, None)], "question_id long, alias string")
    got = {(r.question_id, r.chunk_id): r["rank"] for r in C.graph_candidates(asked, chosen, chunks, 5).collect()}
    size = 2 * 0.12 + 10 * 0.01
    assert set(got) == {(1, 3), (1, 7), (2, 3), (2, 5), (2, 7)}
    assert got[1, 7] == pytest.approx(1.10 + size - 0.12 - 0.10) and got[1, 3] == pytest.approx(0.40 + size - 0.12 - 0.10)
    assert got[2, 5] == pytest.approx(0.40 + size)
    few = C.graph_candidates(asked, chosen, chunks, 5, most=1).collect()
    assert [(r.question_id, r.chunk_id, r.nth) for r in sorted(few)] == [(1, 7, 1), (2, 7, 1)]
    assert C.graph_candidates(asked, chosen.limit(0), chunks, 5).count() == 0 == C.graph_candidates(asked, chosen, chunks.limit(0), 5).count()
    lower = lambda s: F.lower(F.lit(s))
    words = lambda *w: F.array(*map(F.lit, w))
    score = C.alias_score(F.lit("stop place"), [(lower("x"), words("x"), 1.10), (lower("Place of a Stop"), words("place", "of", "a", "stop"), 0.85)])
    assert one(spark, s=score).s == pytest.approx(0.85 + size)
    assert one(spark, s=C.alias_score(F.lit("  "), [(lower("a  b"), words("a", "b"), 1.10)])).s == 0.0


def test_holding_equals_brute_force(spark):
    texts = {1: "banana bandana", 2: None, 3: "", 4: "BAN", 5: "na" * 10000}
    needles = ["an", "ban", "ana", "", None, "x", "nana", "an"]
    rows = spark.createDataFrame(list(texts.items()), "chunk_id long, t string")
    want = {(i, n) for i, t in texts.items() for n in needles if n and t and n in t.lower()}
    for block in (2, 100):
        got = C.holding(rows, ["t"], spark.createDataFrame([(n,) for n in needles], "n string"), block)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_path_hints(spark):
    chunks = spark.createDataFrame([(i, f"docs/README-{i % 2}.xml", ["A" if i < 20 else "B"]) for i in range(60)] + [(99, None, None)], "chunk_id long, source_path string, standards_scope array<string>")
    asked = spark.createDataFrame([(1, "where is readme-1.xml?", None), (2, "README-0.xml", ["A"]), (3, "nothing", None), (4, None, None)], "question_id long, question string, scope array<string>")
    got = [(r.question_id, r.chunk_id) for r in C.path_hint_candidates(asked, chunks, 6).orderBy("question_id", "nth").collect()]
    assert got == [(1, i) for i in range(1, 37, 2)] + [(2, i) for i in range(0, 20, 2)]


def test_anchors(spark):
    triple = "s string, p string, o string, o_kind string"
    rows = [
        ("https://netex.org.uk/v#Stop", "http://x#prefLabel", "Stop", "literal"),
        ("https://netex.org.uk/v#Stop", "http://x#closeMatch", "https://core/x#StopPoint", "iri"),
        ("https://core/x#StopPoint", "http://x#subClassOf", "https://www.siri.org.uk/v#Call", "iri"),
        ("https://core/x#StopPoint", "http://x#subClassOf", "http://purl.org/transmodel", "iri"),
        ("https://core/x#StopPoint", "http://x#type", "http://www.w3.org/2002/07/owl#Class", "iri"),
        ("https://core/x#L1", "http://x#type", "http://www.w3.org/2002/07/owl#Class", "iri"),
        ("https://core/x#L1", "http://x#label", "Line Network", "literal"),
    ]
    t = spark.createDataFrame(rows, triple)
    terms = spark.createDataFrame([(1, "STOP"), (2, " "), (3, None), (4, "stop point")], "question_id long, term string")
    assert [tuple(r) for r in K.anchored(terms, t).collect()] == [(1, "https://core/x#StopPoint")]
    slugs = spark.createDataFrame([("stop-point",), ("Line_Network",), ("x-l1",), ("",), (None,), ("none",)], "slug string")
    cores = K.core_by_slug(slugs, t, "core/x")
    assert {tuple(r) for r in cores.collect()} == {("stop-point", "https://core/x#StopPoint"), ("Line_Network", "https://core/x#L1"), ("x-l1", "https://core/x#L1")}
    assert [tuple(r) for r in K.standards_of(cores, t, "core/x").collect()] == [("https://core/x#StopPoint", ["NeTEx", "SIRI"])]


def test_examples_and_files(spark):
    examples = spark.createDataFrame([("e1", "netex:ServiceJourney"), ("e2", "k"), ("e2", "k"), (None, None)], "example string, concept_id string")
    asked = spark.createDataFrame([(1, O.TEMPLATE), (2, "k"), (2, O.TEMPLATE), (3, "none"), (None, None)], "question_id long, concept_id string")
    got = [(r.question_id, r.concept_id, r.example, r.match) for r in O.concept_examples(asked, examples).orderBy("question_id").collect()]
    assert got == [(1, O.TEMPLATE, "e1", "template_realization"), (2, "k", "e2", "direct_example")]
    files = spark.createDataFrame([(p,) for p in ("xsd/netex_a/x.xsd", "xsd/siri/y.xsd", "xsd/gml/z.xsd", "xsd/netex_a/x.md", "netex_a/x.xsd", None)], "source_path string")
    paths = lambda *a: [r[0] for r in O.schema_files(files, *a).collect()]
    assert paths("netex") == ["xsd/netex_a/x.xsd"] and paths("siri") == ["xsd/siri/y.xsd"] and len(paths("opra")) == 3 and paths("netex", ["gml/z.xsd"]) == ["xsd/gml/z.xsd"]
    with pytest.raises(ValueError):
        O.schema_files(files, "other")


def test_examples_are_cut_before_they_meet_questions(spark):
    rows = [(f"e{i % 90:02d}", ("k", "m", "netex:JourneyPattern", "netex:ServiceJourney")[i % 4]) for i in range(400)] + [("a", "m"), ("a", "k")]
    questions = [(q, ("k", "m", O.TEMPLATE, "none")[(q + j) % 4]) for q in range(30) for j in range(q % 3 + 1)]
    found = O.concept_examples(spark.createDataFrame(questions, "question_id long, concept_id string"), spark.createDataFrame(rows, "example string, concept_id string"), most=7)
    want = set()
    for q in {q for q, _ in questions}:
        own = sorted({(c, e, "direct_example") for p, c in questions if p == q for e, x in rows if x == c})
        own = own or sorted({(c, e, "template_realization") for p, c in questions if p == q and c == O.TEMPLATE for e, x in rows if x in O.REALISED_BY})
        want |= {(q, *x, i + 1) for i, x in enumerate(own[:7])}
    assert {tuple(r) for r in found.collect()} == want and any(x[3] == "template_realization" for x in want)
    joins, *limits = (found._jdf.queryExecution().optimizedPlan().toString().count(x) for x in ("Join Inner", "WindowGroupLimit [concept_id", "GlobalLimit 7"))
    assert sum(limits) >= joins > 0  # each join of questions and examples has its examples cut


def test_alias_choice_skips_short_names(spark):
    rows = [(1, "the id of a stop", a) for a in ("id", "of it", "Stop", "stop", " stop place ", "journey")]
    got = O.alias_choice(spark.createDataFrame(rows, "question_id long, question string, alias string"), 1).orderBy("nth").collect()
    assert [r.form for r in got] == ["stop place", "stop", "journey", "of it"]


def test_queue(spark, tmp_path):
    rows = [(1, None, None), (None, None, None), (3, "other", "high"), (4, "CITATION_GAP", "urgent")]
    got = G.routed(spark.createDataFrame(rows, "event_id long, reason string, priority string")).collect()
    assert [(r.reason, r.priority, r.error, r.status) for r in got] == [("USER_ESCALATION", "normal", None, "in_review"), ("USER_ESCALATION", "normal", "event_id", None), ("other", "high", "reason", None), ("CITATION_GAP", "urgent", "priority", None)]
    items = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "queue_item_id long, event_id long")
    links = spark.createDataFrame([(10, 2, 1, "https://h/a/b/", "c", "x y.md", "k1", "l"), (10, 1, 2, "https://h/a/b", "c", "issues/3.md", "k2", "l")], "event_id long, created_at long, link_id long, repository_url string, commit_sha string, source_path string, chunk_id string, label string")
    cited = {r.queue_item_id: [(c.repository_url, c.chunk_id) for c in r.citations] for r in G.queue_citations(items, links).collect()}
    assert cited == {1: [("https://h/a/b/issues/3", "k2"), ("https://h/a/b/blob/c/x%20y.md", "k1")], 2: [], 3: []}
    path = tmp_path / "registry.json"
    assert G.competency_registry(spark, str(path)).count() == 0
    path.write_text(json.dumps({"competencyQuestions": [{"id": "CQ-STOP-1", "standard": "NeTEx", "requiresRule": True, "ruleId": "R1"}, {"id": "CQ-2"}]}))
    registry = G.competency_registry(spark, str(path))
    asked = spark.createDataFrame([(1, ["netex"], ["stop"], "definition", "mandatory")], "question_id long, scope array<string>, terms array<string>, intent string, normativity string")
    assert {r.id for r in G.competency_matches(asked, registry).collect()} == {"CQ-STOP-1", "CQ-2"}


def test_console_and_export(spark):
    asked = spark.createDataFrame([("a", 1, 0.5, 3, 0), ("b", 2, 0.1, 1, 1), ("c", 3, 0.9, 3, 0)], "request_id string, asked_at long, confidence double, likes long, dislikes long")
    board = spark.createDataFrame([("a", "in_review", 1, 1), ("a", "approved", 1, 2), ("z", "in_review", 1, 3)], "request_id string, status string, created_at long, queue_item_id long")
    rows = G.console_rows(asked, board)
    ids = lambda *o: [r.request_id for r in rows.orderBy(*G.console_order(*o)).collect()]
    assert ids("likes", True) == ["a", "c", "b"] and ids("status") == ["b", "c", "a"] and ids(None) == ["a", "b", "c"] and ids("confidence", True) == ["c", "a", "b"]
    assert [r.request_id for r in G.console_rows(asked, board, "approved").collect()] == ["a"]
    chunks = spark.createDataFrame([("r", 0.5), ("r", None), ("s", 0.9)], "repository_url string, quality_score double")
    assert I.exportable(chunks).count() == 3 and I.exportable(chunks, "r").count() == 2 and I.exportable(chunks, quality=0.5).count() == 2
    with pytest.raises(ValueError):
        I.exportable(chunks, quality=2.0)

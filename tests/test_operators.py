from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.operators import analytics as A
from quillon.operators import chunking, evaluation, indexing
from quillon.operators import governance as G
from quillon.operators import graph as K
from quillon.operators import ontology as O
from quillon.operators import retrieval as R
from quillon.sources import files, turtle
from quillon.streaming import events as S

XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:simpleType name="Kind"><xs:annotation><xs:documentation> A  kind. </xs:documentation></xs:annotation></xs:simpleType>
<xs:element name="Journey" substitutionGroup="n:Trip_"><xs:annotation><xs:documentation>A planned movement</xs:documentation></xs:annotation><xs:complexType><xs:sequence><xs:element name="Stop"/><xs:element ref="Line" minOccurs="0"/></xs:sequence><xs:attribute name="id" use="required"/><xs:attribute name="v"/></xs:complexType></xs:element></xs:schema>"""


def test_xml_and_xsd_chunks(spark):
    rows = [("a/x.xsd", XSD), ("a/bad.xsd", "not xml " * 300), ("a/e.xml", "<r>\n  <a>1</a>\n  <b>\n    <c/>\n  </b>\n</r>"), ("a/t.txt", "word " * 400), ("a/m.md", "intro\n# One\ntext\n#### no\n## Two\n" + "long " * 400), ("a/none.md", None)]
    got = chunking.chunks(spark.createDataFrame(rows, "source_path string, text string").withColumn("path", F.col("source_path")), path="path").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.position):
        by.setdefault(r.source_path, []).append(r)
    assert [r.heading for r in by["a/x.xsd"]] == ["Journey", "Kind"] and "Direct child elements: Stop, Line" in by["a/x.xsd"][0].chunk_text and "Attributes: id (required), v" in by["a/x.xsd"][0].chunk_text
    assert len(by["a/bad.xsd"]) == 3 and len(by["a/e.xml"]) == 1 and len(by["a/t.txt"]) == 2 and "a/none.md" not in by
    assert [(r.heading, r.chunk_type) for r in by["a/m.md"]][:3] == [("", "prose"), ("One", "heading_section"), ("Two", "prose")] and "#### no" in by["a/m.md"][1].chunk_text
    meta = chunking.schema_metadata(spark.createDataFrame(rows, "source_path string, text string"), "source_path", "text").collect()
    assert [(m.declaration_name, m.required_child_elements, m.required_attributes, m.documentation) for m in meta] == [("Journey", ["Stop"], ["id"], "A planned movement"), ("Kind", [], [], "A kind.")]
    found = O.concepts_from_schemas(spark.createDataFrame(rows, "source_path string, text string"), "n").collect()
    assert [tuple(c) for c in found] == [("n:Journey", "Journey", "A planned movement", "n:Trip")]


def test_split_xml_packs_segments():
    body = "<r>\n" + "\n".join(f"  <a{i}>{'x' * 50}</a{i}>" for i in range(30)) + "\n</r>"
    parts = chunking.split_xml(body, 300)
    assert max(map(len, parts)) <= 400 and "\n".join(parts).replace("\n", "") == body.replace("\n", "")
    assert all(len(p) <= 310 for p in chunking.split_xml("<a>\n" + "line line\n" * 300 + "</a>", 300))


def test_index_runs(spark):
    schema = "repository_url string, source_path string, commit_sha string, text string"
    manifest = spark.createDataFrame([], "repository_url string, source_path string, content_hash string")
    none = spark.createDataFrame([], "chunk_id string, repository_url string, source_path string, commit_sha string, position long, heading string, chunk_type string, doc_type string, standards_scope array<string>, quality_score double, text string")
    first = spark.createDataFrame([("u", "docs/a.md", "1", "# Service Frame\nabout frames"), ("u", "README.md", "1", "Overview."), ("u", "skip/b.md", "1", "no"), ("u", "examples/e.xml", "1", "<root><Item>x</Item></root>")], schema)
    chunks, files1 = indexing.index_corpus(first, manifest, none, exclude=["skip/"])
    rows = {r.source_path: r for r in chunks.collect()}
    assert set(rows) == {"docs/a.md", "README.md", "examples/e.xml"} and {r.change for r in rows.values()} == {"created"}
    assert rows["docs/a.md"].doc_type == "frame" and rows["docs/a.md"].quality_score > rows["README.md"].quality_score and "XML semantic summary" in rows["examples/e.xml"].text
    second = spark.createDataFrame([("u", "docs/a.md", "2", "# Service Frame\nabout other frames"), ("u", "README.md", "2", "Overview.")], schema)
    again, files2 = indexing.index_corpus(second, files1, chunks.drop("change"), exclude=["skip/"])
    assert {(r.source_path, r.change) for r in again.collect()} == {("docs/a.md", "created"), ("README.md", "kept"), ("examples/e.xml", "kept")}
    assert files2.count() == 3
    pruned, files3 = indexing.index_corpus(second, files1, chunks.drop("change"), exclude=["skip/"], prune=True)
    assert {r.source_path for r in pruned.collect()} == {"docs/a.md", "README.md"} == {r.source_path for r in files3.collect()}
    metric = indexing.run_metric(first, second.where("false"), chunks, "default", "full").first()
    assert (metric.status, metric.created, metric.files) == ("success", 3, 4)


def test_allowed_repositories(spark):
    df = spark.createDataFrame([("a",), ("b",)], "repository_url string")
    assert indexing.allowed_repositories(df, ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="not allowed"):
        indexing.allowed_repositories(df, ["a"]).collect()


def test_source_files(spark, tmp_path):
    for name, body in {"a.md": b"caf\xc3\xa9 \xff!", "docs/b.txt": b"x", "node_modules/c.md": b"x", "d.bin": b"x", "sub/.git/config": b"x", "sub/e.md": b"x", "UP.MD": b"y"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r.source_path: r.text for r in files.source_files(spark, str(tmp_path), "u").collect()}
    assert got == {"a.md": "café !", "docs/b.txt": "x", "UP.MD": "y"}
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.files.link./in", tmp_path.as_uri())
    for address in (tmp_path.as_uri(), f"file:{tmp_path}/", "viewfs://files/in"):
        assert {r.source_path: r.text for r in files.source_files(spark, address, "u").collect()} == got, address
    assert {r.source_path for r in files.source_files(spark, str(tmp_path), "u", suffixes=[".bin"]).collect()} == {"d.bin"}


def test_profiles_and_questions(spark):
    rules = files.load_profile({"p": {"include": ["docs/", "docs/"], "exclude": ["x"]}}, "p", ["x", "y"])
    assert rules == {"include": ["docs/"], "exclude": ["x", "y"]}
    with pytest.raises(ValueError):
        files.load_profile({}, "q")
    text = '{"questions": [{"id": "1", "question": "q", "tags": ["netex", "opra"], "min_hits": 2}, {"id": "2", "question": "r", "tags": []}]}'
    got = files.benchmark_questions(spark, text, tags=["opra"]).collect()
    assert [(r.id, r.min_hits) for r in got] == [("1", 2)] and files.benchmark_questions(spark, text, ids=["2"]).first().min_hits == 1
    assert files.benchmark_questions(spark, text).select(evaluation.scope_of_tags(F.col("tags")).alias("s")).collect()[0].s == ["NeTEx", "OpRa"]
    seeds = files.seeded(spark.createDataFrame([], "a int"), [(1,), (2,)])
    assert seeds.count() == 2 and files.seeded(seeds.limit(1), [(9,)]).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("netex", "B", 'say "hi"', None), ("netex", "A", "a", "c")], "group string, name string, label string, comment string")
    files.write_text(files.turtle_stanzas(rows), str(tmp_path / "t"))
    body = "\n".join(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    full = "@prefix netex: <http://n#> . @prefix owl: <http://o#> . @prefix rdfs: <http://r#> .\n" + body
    assert {(s, o) for s, p, o, _, _ in turtle.parse(full) if p.endswith("label")} == {("http://n#A", "a"), ("http://n#B", 'say "hi"')} and body.index("netex:A") < body.index("netex:B")
    files.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_turtle(spark):
    text = """@prefix a: <http://a#> . # note
PREFIX b: <http://b#>
a:x a b:Class ; b:label "One"@en, "Un \\"é\\"\\n"@fr ; b:n 3 ; b:d "2024-01-01"^^b:date .
a:y b:related a:x , <http://c/z> ; b:long \"\"\"two
lines\"\"\" ."""
    got = turtle.triples(spark.createDataFrame([("g", text)], "graph string, text string")).collect()
    assert ("http://a#x", turtle.TYPE, "http://b#Class", "iri", "", "g") in map(tuple, got) and ("http://a#x", "http://b#label", 'Un "é"\n', "literal", "fr", "g") in map(tuple, got)
    assert {r.o for r in got if r.p.endswith("related")} == {"http://a#x", "http://c/z"} and len(got) == 8
    edges = {(r.source, r.target) for r in K.edges_of(turtle.triples(spark.createDataFrame([("g", text)], "graph string, text string"))).collect()}
    assert ("http://a#x", "http://a#y") in edges and ("http://a#y", "http://a#x") in edges
    with pytest.raises(ValueError):
        list(turtle.parse("a:x ??? ."))
    t = turtle.triples(spark.createDataFrame([("g", text)], "graph string, text string"))
    assert turtle.replace_graphs(t, t.limit(1)).count() == 1


def test_turtle_nodes_and_lists():
    read = lambda t, **k: sorted(turtle.parse("@prefix o: <http://o#> .\n" + t, **k))
    first = read("o:A o:n 1.5e3, true, -.5E-2, 'one', \'\'\'a\nb\'\'\' .")
    assert [(p, o) for _, p, o, _, _ in first] == [("http://o#n", x) for x in sorted(["1.5e3", "true", "-.5E-2", "one", "a\nb"])]
    got = read("o:A o:of [ a o:B ; o:in ( o:x [ o:y 1 ] () ) ] ; .\n[] o:z _:k . [ o:q _:k ] .")
    blank = {t[2] for t in got if t[3] == "bnode"} | {t[0] for t in got if t[0].startswith("_:")}
    assert len(got) == 12 and sum(t[1] == turtle.FIRST for t in got) == 3 and sum(t[2] == turtle.NIL for t in got) == 2 and len(blank) == 8
    assert got == read("o:A o:of [ a o:B ; o:in ( o:x [ o:y 1 ] () ) ] ; .\n[] o:z _:k . [ o:q _:k ] .") and {t[0] for t in read("_:k o:z 1 .", graph="g")} != {t[0] for t in read("_:k o:z 1 .", graph="h")}
    assert read("@base <http://b/x/y> . <z> <#p> <../w> . BASE <http://c/> <d> o:e o:f:g .") == [("http://b/x/z", "http://b/x/y#p", "http://b/w", "iri", ""), ("http://c/d", "http://o#e", "http://o#f:g", "iri", "")]
    assert len(read("o:a o:b " + "[ o:b " * 5000 + "1" + " ]" * 5000 + " .")) == 5001
    for bad in ("o:a o:b", "o:a o:b o:c o:d .", "o:a o:b [ o:c .", "o:a o:b ( o:c ] .", "o:a \"x\" o:c .", "\"x\" o:a o:b .", "z:a o:b o:c .", "o:a o:b , o:c .", "o:a .  o:b", "@prefix o: .", "o:a o:b \"x\"^^ ."):
        with pytest.raises(ValueError):
            read(bad)


def test_turtle_files(spark, tmp_path):
    for name, body in {"a.ttl": "<http://x> a <http://y> .", "b.ttl": "broken", "r.ttl": "<http://x> <http://p> 1 ."}.items():
        (tmp_path / name).write_text(body)
    graphs, rules = {"a": ("a.ttl", "ga"), "b": ("b.ttl", "gb")}, {"NeTEx": ("r.ttl", "gr"), "siri": ("none.ttl", "gs")}
    rows = turtle.parsed(turtle.ontology_files(spark, tmp_path.as_uri(), graphs, rules)).collect()
    assert [(r.graph, r.s) for r in rows if r.error is None] == [("ga", "http://x")] and [r.graph for r in rows if r.error] == ["gb"]
    with pytest.raises(Exception, match="gb"):
        turtle.triples(turtle.ontology_files(spark, str(tmp_path), graphs)).collect()
    only = turtle.ontology_files(spark, str(tmp_path), {"a": graphs["a"]}, rules, include_rules=True, standards=[" netex "])
    assert {r.graph for r in turtle.triples(only).collect()} == {"ga", "gr"}
    with pytest.raises(ValueError, match="opra"):
        turtle.ontology_files(spark, str(tmp_path), graphs, rules, include_rules=True, standards=["opra"])
    with pytest.raises(FileNotFoundError):
        turtle.ontology_files(spark, str(tmp_path), graphs, rules, include_rules=True)
    lines = ['<http://s> <http://p> "a \\"b\\"\\n\\\\n"@en-GB . # c', "# note", "", "_:x <http://p> <http://o>.", '<http://s> <http://p> "1"^^<http://int> .', "<http://s> <http://p> _:x ."]
    (tmp_path / "n.nt").write_text("\n".join(lines))
    got = sorted(map(tuple, turtle.n_triples(spark, str(tmp_path / "n.nt"), "g").select("s", "o", "o_kind", "lang").collect()))
    x = got[0][0]
    assert x.startswith("_:") and got == sorted([(x, "http://o", "iri", ""), ("http://s", "1", "literal", ""), ("http://s", x, "bnode", ""), ("http://s", 'a "b"\n\\n', "literal", "en-GB")])
    (tmp_path / "bad.nt").write_text("<http://s> <http://p> .")
    with pytest.raises(Exception, match="not a triple"):
        turtle.n_triples(spark, str(tmp_path / "bad.nt"), "g").collect()


def test_concept_mapping(spark):
    rows = [
        ("n:A", ["Service Intensity"], [], None, "nch:Service Intensity", None), ("n:B", ["b"], [], None, None, "n:A"), ("n:C", ["c"], [], None, None, "n:D"), ("n:D", ["Dee Dee"], [], None, None, "n:C"), ("n:E", None, [], "bad:x", None, "n:missing"),
        ("nits:own", [], [], None, None, None), ("n:StopPlace", [], ["n:A", "n:StopPlace", "zz"], "nits:Stop Place", None, None), ("n:F", ["Known label"], [], None, None, None), ("n:G", ["g"], [], None, None, "n:B"),
    ]
    c = spark.createDataFrame(rows, "concept_id string, labels array<string>, related_to array<string>, maps_to string, legacy_maps_to string, synonym_of string")
    core = spark.createDataFrame([("nits:known", ["Known Label"])], "concept_id string, labels array<string>")
    got = dict(map(tuple, K.core_mapping(c, core).collect()))
    assert got == {"n:A": "nits:service-intensity", "n:B": "nits:service-intensity", "n:G": "nits:service-intensity", "n:C": "nits:c", "n:D": "nits:dee-dee", "n:E": "nits:e", "nits:own": "nits:own", "n:StopPlace": "nits:stop-place", "n:F": "nits:known"}
    edges = {tuple(r) for r in K.relation_edges(c, K.core_mapping(c, core)).collect()}
    assert {("n:StopPlace", "n:A"), ("n:A", "n:StopPlace"), ("n:A", "n:B"), ("n:G", "n:A")} <= edges and not any(a == b for a, b in edges)


def test_expansion(spark):
    edges = K.both_ways(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], "source string, target string"))
    got = {(r.concept_id, r.hop) for r in K.expand(spark.createDataFrame([(1, "a")], "question_id long, concept_id string"), edges, 2).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    mapping = spark.createDataFrame([("a", "nits:x"), ("e", "nits:y")], "concept_id string, core_id string")
    near = spark.createDataFrame([("nits:x", "nits:y")], "source string, target string")
    wide = K.expand_by_core(spark.createDataFrame([(1, "a")], "question_id long, concept_id string"), mapping, near, edges)
    assert {r.concept_id for r in wide.collect()} == {"a", "b", "c", "e"}


def test_citations_and_caps(spark):
    rows = [(1, "r1", "src/a", 0.9, 0), (1, "r1", "docs/b.md", 0.5, 1), (1, "r2", "src/c", 0.95, 2), (1, "r1", "docs/b.md", 0.8, 3), (1, "r1", "docs/README.md", 0.99, 4), (1, "", "", 0.1, 5), (1, "", "", 0.2, 6)]
    h = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "question_id long, repository_url string, source_path string, score double, position long, chunk_id long")
    assert [r.chunk_id for r in R.citations(h, 4).orderBy("nth").collect()] == [3, 2, 6, 4]
    capped = R.path_cap(h, 1, F.desc("score")).collect()
    assert sorted(r.chunk_id for r in capped) == [0, 2, 3, 4, 5, 6]


def test_diversity(spark):
    rows = [(1, 10, 0.9, 0, "a b c"), (1, 11, 0.89, 1, "a b c"), (1, 12, 0.85, 2, "x y z"), (2, 13, 0.5, 0, "q")]
    c = spark.createDataFrame(rows, "question_id long, chunk_id long, rank double, position long, source_path string").withColumns({"label": F.lit(""), "repository_url": F.lit("")})
    assert [tuple(r)[:3] for r in R.diversify(c, 2, 0.5).orderBy("question_id", "nth").collect()] == [(1, 10, 1), (1, 12, 2), (2, 13, 1)]


def test_scores(spark):
    score, rank = R.hybrid(F.col("v"), F.col("l"), F.col("q"), F.lit(0.1))
    got = spark.createDataFrame([(0.9, 0.2, 0.5), (0.1, 0.9, 0.5), (2.0, 2.0, 2.0)], "v double, l double, q double").select(score.alias("s"), rank.alias("r")).collect()
    assert abs(got[0].s - 0.71) < 1e-9 and abs(got[1].s - 0.68) < 1e-9 and abs(got[1].r - (0.68 + 0.009 + 0.0005) * 0.6) < 1e-9 and got[2].s == 1.0
    assert spark.range(1).select(R.example_boost(F.lit("xml-example"), F.lit(1)).alias("e")).first().e == 0.15


def test_graph_adjustment(spark):
    """The bonus is for example paths: of direct hits where examples are asked for, of expanded hits always."""
    ab, c, general = ["a", "b"], ["c"], ["siri:SIRI"]
    cases = [
        (ab, ab, c, [], "docs/x.md", 0.20), (ab, ab, c, ["example"], "Examples/x.xml", 0.26), (ab, ab, c, [], "examples/x.xml", 0.20), (ab, ab, c, ["example"], "docs/examples/x.xml", 0.20),
        (c, ab, c, [], "docs/x.md", 0.10), (c, ab, c, [], " examples/x.xml", 0.18), (["c", *general], general, c, ["example"], "x", 0.10), (general, general, general, ["example"], "examples/x", 0.0), ([], ab, c, [], None, 0.0),
    ]
    df = spark.createDataFrame(cases, "own array<string>, asked array<string>, wider array<string>, hints array<string>, path string, want double")
    for r in df.withColumn("got", R.graph_adjustment(*map(F.col, ("own", "asked", "wider", "hints", "path")))).collect():
        assert abs(r.got - r.want) < 1e-9, r


def test_clusters(spark):
    at = datetime(2024, 1, 1)
    vectors = [[1.0, 0.0, 0.0], [0.96, 0.04, 0.0], [0.9, 0.1, 0.0], [0.0, 1.0, 0.0]]
    ev = spark.createDataFrame([(i, f"late bus {i}", at + timedelta(minutes=i), v) for i, v in enumerate(vectors)], "id long, question string, created_at timestamp, vector array<double>")
    members = A.leader_clusters(ev, threshold=0.8)
    got = A.cluster_rollup(members, ev, 2).collect()
    assert members.count() == 4 and len(got) == 1 and got[0].members == 3 and got[0].ids == [2, 1, 0] and got[0].label == "late bus" and got[0].cohesion == 1.0 and got[0].signal == "medium"
    assert A.leader_clusters(ev.where("false")).count() == 0


def test_partitions_and_gates(spark):
    rows = [(1, "u", "p", "", "Journeys shall run", ["NeTEx"], 0.9), (1, "u", "p", "", "they may run", ["SIRI", "NeTEx"], 0.8), (1, "u/siri", "p", "", "optional", [], 0.7), (1, "u", "p", "", "none", [], 0.1)]
    h = spark.createDataFrame(rows, "question_id long, repository_url string, source_path string, label string, text string, standards_scope array<string>, score double")
    got = {r.standard: r for r in G.standard_partitions(h, ("SIRI", "NeTEx")).collect()}
    assert {k: v.evidence_count for k, v in got.items()} == {"NeTEx": 1, "SIRI": 2} and all(r.conflict for r in got.values())
    gates = spark.range(1).select(G.evidence_gate(F.lit(0), F.lit(1.0), F.lit(1), F.lit(1)).alias("a"), G.evidence_gate(F.lit(3), F.lit(0.1), F.lit(1), F.lit(1)).alias("b"), G.evidence_gate(F.lit(3), F.lit(0.9), F.lit(1), F.lit(3)).alias("c"), G.evidence_gate(F.lit(3), F.lit(0.9), F.lit(2), F.lit(3)).alias("d")).first()
    assert tuple(gates) == ("INSUFFICIENT_EVIDENCE", "LOW_RETRIEVAL_CONFIDENCE", "CROSS_STANDARD_GAP", None)


def test_policy_and_grounding(spark):
    cite = lambda *u: F.array(*map(F.lit, u))
    ok = ["https://github.com/o/r"]
    r = spark.range(1).select(
        G.policy(F.lit(" "), cite("x"), ok).alias("a"), G.policy(F.lit("yes"), F.array().cast("array<string>"), ok).alias("b"), G.policy(F.lit("yes"), cite("https://github.com/x/y"), ok).alias("c"), G.policy(F.lit("yes"), cite("https://github.com/o/r/blob/1/f"), ok).alias("d"), G.policy(F.lit("It must"), cite("https://github.com/o/r"), ok, True).alias("e"),
        G.grounded_example(F.lit("```xml\n<line one=1>\n<line two=2>\n<line three=3>\n```"), F.lit("<line one=1>\n <LINE two=2>\n<line three=3>")).alias("g"), G.grounded_example(F.lit("```xml\n<made up=1>\n```"), F.lit("<line one=1>")).alias("h"),
    ).first()
    assert tuple(r) == ("UNKNOWN", "INSUFFICIENT_EVIDENCE", "POLICY_BLOCK", None, "INSUFFICIENT_EVIDENCE", True, False)


def test_workflow(spark):
    rows = [("in_review", "approve", ["reviewer"]), ("in_review", "approve", ["viewer"]), ("in_review", "publish", ["admin"]), ("approved", "revoke", None), ("x", "request_changes", ["admin"])]
    got = G.apply_transitions(spark.createDataFrame(rows, "status string, action string, roles array<string>")).collect()
    assert {(r.action, r.outcome, r.new_status) for r in got} == {("approve", "ok", "approved"), ("approve", "forbidden", "in_review"), ("publish", "not_allowed", "in_review"), ("revoke", "forbidden", "approved"), ("request_changes", "not_allowed", "x")}
    items = spark.createDataFrame([("approved", ["admin"]), ("approved", []), ("rejected", ["editor"])], "status string, roles array<string>")
    assert [r.actions for r in G.allowed_actions(items).collect()] == [["publish", "revoke"], [], ["reopen"]]


def test_rules_and_competency(spark):
    q = spark.createDataFrame([(1, ["NeTEx"], ["stop"], "definition", "mandatory"), (2, [], ["x"], "unknown", "unspecified")], "question_id long, scope array<string>, terms array<string>, intent string, normativity string")
    registry = spark.createDataFrame([("CQ-NETEX-STOP-01", "NeTEx", True, "r1"), ("CQ-OPRA-ROLE-01", "OpRa", False, None), ("CQ-SIRI-RT-01", "SIRI", False, None), ("", "NeTEx", False, None)], "id string, standard string, requires_rule boolean, rule_id string")
    assert {(r.question_id, r.id) for r in G.competency_matches(q, registry).collect()} == {(1, "CQ-NETEX-STOP-01"), (2, "CQ-SIRI-RT-01")}


def test_faqs(spark):
    faqs = spark.createDataFrame([("a", "", ["validation", "schema", "netex"]), ("b", "journey pattern", []), ("c", "", ["time"])], "faq_entry_id string, normalized_intent string, keyword_tokens array<string>")
    asked = spark.createDataFrame([(1, "Validate NeTEx schemas"), (2, "a netex timetable"), (3, "journey example"), (4, "journeys"), (5, None)], "question_id long, question string")
    assert {(r.question_id, r.faq_entry_id, round(r.score, 3)) for r in G.faq_matches(asked, faqs).collect()} == {(1, "a", 1.0), (4, "b", 0.5)}


def test_evaluation(spark):
    rows = [(1, ["docs/A.md", "b.xsd"], ["x", "y/docs/a.md", "z"], 1), (2, [], ["x"], 0), (3, ["q"], ["x"], 1)]
    got = {r.question_id: r for r in evaluation.scored(spark.createDataFrame(rows, "question_id long, patterns array<string>, paths array<string>, min_hits int")).collect()}
    assert (got[1].hit_at_5, got[1].mrr_at_10) == (True, 0.5) and (got[2].hit_at_5, got[2].mrr_at_10) == (True, 0.0) and (got[3].hit_at_20, got[3].mrr_at_20) == (False, 0.0)
    p = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double").agg(evaluation.percentile("v", 0.5).alias("a"), evaluation.percentile("v", 0.95).alias("b")).first()
    assert p.a == 3.0 and abs(p.b - 9.1) < 1e-9
    now = spark.createDataFrame([("a", 112.0), ("b", 130.0), ("c", 5.0)], "intent string, average double")
    base = spark.createDataFrame([("a", 100.0), ("b", 100.0)], "intent string, average double")
    assert {r.intent: r.passed for r in evaluation.intent_gates(now, base).collect()} == {"a": True, "b": False, "c": True}


def test_feedback_and_lookup(spark):
    at = datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, "r", at, False, False, 0), (2, "r", at + timedelta(1), False, False, 1), (3, "2", at, False, False, 0)], "id long, request_id string, created_at timestamp, user_likes boolean, user_dislikes boolean, citation_click_count int")
    fb = spark.createDataFrame([("r", True, False, 2), ("2", True, True, 9)], "request_id string, likes boolean, dislikes boolean, clicks int")
    got = {r.id: (r.user_likes, r.citation_click_count) for r in A.apply_feedback(ev, fb).collect()}
    assert got == {1: (False, 0), 2: (True, 3), 3: (False, 0)}
    assert A.find_event(ev, "2").first().id == 2 and A.find_event(ev, "r").first().id == 2
    assert ev.select(A.iso_time(F.col("created_at")).alias("t")).first().t == "2024-01-01T00:00:00Z"


def test_ontology_tools(spark):
    r = spark.range(1).select(O.category(F.lit("StopPlace")).alias("a"), O.category(F.lit("TypeOfStop")).alias("b"), O.category(F.lit("Quay")).alias("c"), O.category(F.lit("Xyz")).alias("d"), O.noisy_name(F.lit("Zone_Structure")).alias("e"), O.labels(F.lit("StopPlace"), F.lit("A place. More")).alias("f"), O.lexical_signature(F.lit("a/BusStop.xml"), F.lit('<x:Line idRef="1"/>')).alias("g")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("nits:SpatialEntity", "skip", "nits:Stop", "nits:DataArtifact", True) and r.f == ["place more", "stop place", "stopplace"] and {"bus", "stop", "line", "id", "ref"} <= set(r.g)
    names = O.class_names(spark.createDataFrame([("netex:Line a owl:Class .",), ("  netex:Quay a",), ("x",)], "value string"), "netex")
    assert {x.name for x in names.collect()} == {"Line", "Quay"}


def test_stream_of_windows(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(i, f"Late  bus {i % 2}", at + timedelta(minutes=25 * i), i == 3, False, i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, question string, created_at timestamp, review_required boolean, abstained boolean, user_id long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    S.start(S.windowed_questions(stream, late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r.window_start, r.normalized_question, r.ask_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.window_start, r.normalized_question, r.ask_count) for r in S.windowed_questions(df).collect()}
    assert got and got <= want
    assert sum(r.n for r in S.sessions(df, "60 minutes").collect()) == 10


@pytest.mark.parametrize("seed", [1, 2])
def test_closure(spark, seed):
    """Chains of 40, cycles, stars, loops and several graphs against breadth-first search."""
    import random

    r = random.Random(seed)
    names = [f"x#{i}" for i in range(200)]
    r.shuffle(names)
    links = [("g1", names[i], names[i + 1]) for i in range(40)] + [("g1", names[50 + i], names[50 + (i + 1) % 9]) for i in range(9)] + [("g1", names[70], names[71 + i]) for i in range(12)]
    links += [("g2", names[r.randrange(200)], names[r.randrange(200)]) for _ in range(90)] + [("g2", names[199], names[199]), ("g3", names[0], names[50])]
    triples = [(g, s, "http://www.w3.org/2004/02/skos/core#related", o, "iri") for g, s, o in links] + [("g1", names[0], "x#other", names[50], "iri"), ("g1", names[0], "x#related", "a label", "literal")]
    df = spark.createDataFrame(triples, "graph string, s string, p string, o string, o_kind string").repartition(3)
    seeds = [(i, names[i * 5]) for i in range(40)] + [(0, names[55]), (99, "unknown")]
    asked = spark.createDataFrame(seeds, "question_id long, concept string")

    def reached(edges, start, hops):
        near, seen = {start}, set()
        for _ in range(hops):
            near = {b for a, b in edges if a in near} - seen
            if not near:
                break
            seen |= near
        return seen

    for graphs in (("g1", "g2"), None):
        for hops in (1, 2):
            own, members = K.closure(asked, df, hops, graphs=graphs)
            got = {tuple(x) for x in own.join(members, ["graph", "component"]).select("question_id", "graph", "node").collect()}
            want = set()
            for g in graphs or ("",):
                both = {(s, o) for h, s, o in links if not graphs or h == g} | {(o, s) for h, s, o in links if not graphs or h == g}
                want |= {(q, g, n) for q, c in seeds for n in reached(both, c, 1 if hops == 1 else 500)}
            assert got == want, (graphs, hops)
    assert K.graph_components(df.select("graph", F.col("s").alias("source"), F.col("o").alias("target")).limit(0), "graph").count() == 0


def test_ingest_restarts_without_duplicates(spark, tmp_path):
    import json
    import shutil

    schema = "repository_url string, source_path string, text string, updated_at string"
    out, check, landed = str(tmp_path / "out"), str(tmp_path / "check"), tmp_path / "landed"
    landed.mkdir()

    def land(name, *rows):
        (landed / name).write_text("\n".join(json.dumps(dict(zip(("repository_url", "source_path", "text", "updated_at"), r, strict=True))) for r in rows))

    def run():
        query = S.ingest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(landed)), out, check)
        query.awaitTermination()
        assert query.exception() is None

    now = lambda: {(r.source_path, r.text) for r in S.ingested(spark, out).collect()}
    written = lambda: spark.read.parquet(out).count()
    assert S.ingested(spark, out) is None
    land("1.json", ("r", "a", "one", "1"), ("r", "b", "two", "1"), ("r", "b", "late", "0"), ("r", "c", None, None))
    run()
    assert now() == {("a", "one"), ("b", "two"), ("c", None)}
    land("2.json", ("r", "a", "one", "2"), ("r", "b", "three", "2"))
    run()
    assert now() == {("a", "one"), ("b", "three"), ("c", None)} and written() == 4
    # a driver that ends between the write and the commit does its last batch again
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in (tmp_path / "check" / "commits").glob(f".{last.name}*"):
        crc.unlink()
    run()
    assert now() == {("a", "one"), ("b", "three"), ("c", None)} and written() == 4
    # a write that broke off is not seen
    shutil.copytree(tmp_path / "out" / f"batch={last.name}", tmp_path / "out" / "batch=77")
    (tmp_path / "out" / "batch=77" / "_SUCCESS").unlink()
    assert now() == {("a", "one"), ("b", "three"), ("c", None)}
    S.ingest_batch(spark.createDataFrame([("r", "b", "two", "9")], schema), 78, out)
    assert now() == {("a", "one"), ("b", "two"), ("c", None)}

"""Full-text search, the vector index and the composed retrieval against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import fulltext as X
from quillon.operators import graph as K
from quillon.operators import vectorindex as V

CHUNKS = "chunk_id long, text string, source_path string, label string, heading string, standards_scope array<string>"


def test_stems(spark):
    want = {
        "classes": "class", "parties": "parti", "party": "parti", "ties": "tie", "boxes": "box", "bus": "bus", "glass": "glass", "status": "status", "hopping": "hop", "hoping": "hop", "hope": "hop",
        "string": "string", "bring": "bring", "delayed": "delay", "red": "red", "feed": "feed", "stopped": "stop", "boy": "boy", "by": "by", "services": "servic", "service": "servic", "a1s": "a1s", "xx11s": "xx11", "the": "the",
    }
    got = spark.createDataFrame([(w,) for w in want], "w string").select("w", X.stem("w")).collect()
    assert dict(map(tuple, got)) == want


def brute_rank(asked: set[str], held: list[tuple[int, str, float]]) -> float:
    hits = [(p, t, w) for p, t, w in held if t in asked]
    if len(asked) == 1:
        if not hits:
            return 0.0
        weights = [w for _, _, w in sorted(hits)]
        top = max(weights)
        j = weights.index(top) + 1
        return (top + sum(w / (i + 1) ** 2 for i, w in enumerate(weights)) - top / j**2) / 1.64493406685
    rest = 1.0
    for i, (p, t, w) in enumerate(hits):
        for r, u, v in hits[i + 1 :]:
            if t != u and 0 < abs(p - r) <= 100:
                rest *= 1 - math.sqrt(w * v / (1.005 + 0.05 * math.exp(abs(p - r) / 1.5 - 2)))
    return 1 - rest


@pytest.fixture(scope="module")
def library(spark):
    r = np.random.default_rng(2)
    words = [f"w{c}{d}" for c in "abcdefghijkl" for d in "xz"] + ["the", "of"]
    draw = lambda n: " ".join(r.choice(words, n))
    rows = [(i, draw(int(r.integers(1, 160))), f"docs/{draw(1)}.md", draw(1), draw(1) if i % 2 else None, ["a"] if i % 3 else ["b"]) for i in range(150)]
    rows += [(200 + i, rows[3][1], rows[3][2], rows[3][3], rows[3][4], ["a"]) for i in range(40)]
    rows += [(300, None, None, None, None, None), (301, "", "", "", "", []), (302, "wax " * 3000 + "wbx", "x", "x", "x", ["a"]), (303, "wax wax", "x", "wax", "x", ["b"]), (None, "wax wbx", "x", "x", "x", ["a"])]
    questions = [(1, "wax wbx", None), (2, "The wcx of wcx", None), (3, "wdx wex wfx wgx", ["a"]), (4, "the of", None), (5, None, None), (6, "wax, wbx, wcx, wdx, wex, wfx", None), (7, "nothing here", None), (None, "wax wbx", None)]
    return spark.createDataFrame(rows, CHUNKS).repartition(3), rows, spark.createDataFrame(questions, "question_id long, question string, scope array<string>"), questions


def brute_search(rows, questions, most):
    out = Counter()
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())  # noqa: E731  the words used here are their own stems
    for q, text, scope in questions:
        asked = {w for w in words(text) if w not in X.STOP}
        if q is None or not asked:
            continue
        ranks = []
        for c, *fields, standards in rows:
            if c is None or (scope and not set(scope) & set(standards or [])):
                continue
            held, at = [], 0
            for body, (_, weight) in zip(fields, X.FIELDS, strict=True):
                held += [(at + i + 1, w, weight) for i, w in enumerate(words(body)) if w not in X.STOP]
                at += len(words(body))
            rank = round(brute_rank(asked, held), 9)
            if rank > 0:
                ranks.append((-rank, c))
        out.update((q, c, -rank, n + 1) for n, (rank, c) in enumerate(sorted(ranks)[:most]))
    return out


@pytest.mark.parametrize("k", [1, 5, 40])
def test_fulltext(spark, library, tmp_path, k):
    chunks, rows, questions, asked = library
    X.write_index(chunks, str(tmp_path / "index"))
    postings = spark.read.parquet(str(tmp_path / "index"))
    got = X.search(questions, postings, k, scopes=chunks.select("chunk_id", "standards_scope"))
    key = lambda c: Counter((q, d, round(r, 7), n) for (q, d, r, n), m in c.items() for _ in range(m))
    assert key(Counter(map(tuple, got.collect()))) == key(brute_search(rows, asked, max(20, 4 * k)))


@pytest.mark.parametrize("k", [1, 40])
def test_scan_gives_the_same_without_an_index(spark, library, monkeypatch, k):
    chunks, rows, questions, asked = library
    monkeypatch.setattr(X, "SCAN_QUESTIONS", 2)
    monkeypatch.setattr(X, "index", None)
    crowd = [(5000 - i, "wax wbx " * 20 + "Wéx", "x", None, "x", ["a"]) for i in range(500)]  # ranks that round to 1, large ids first
    got = X.scan(questions, chunks.unionByName(spark.createDataFrame(crowd, CHUNKS).coalesce(1)), k)
    key = lambda c: Counter((q, d, round(r, 7), n) for (q, d, r, n), m in c.items() for _ in range(m))
    assert key(Counter(map(tuple, got.collect()))) == key(brute_search([*rows, *crowd[-170:]], [(q, t, None) for q, t, _ in asked], max(20, 4 * k)))


def test_scan_knows_all_words_of_a_stem(spark):
    r = np.random.default_rng(6)
    ends = ["", "s", "es", "ing", "ed", "ings", "e", "y", "ies", "ied", "sses", "ss", "us", "ying", "eed", "edes", "inged"]
    words = ["".join(r.choice(list("abdegimnstuy1"), r.integers(1, 5))) + str(r.choice(ends)) for _ in range(3000)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.stem("w")).collect()
    assert all(X.stem_of(w) == t and w in X.words_of(t) for w, t in got)


def test_fulltext_topk_writes_no_index(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(X, "index", None)
    assert entry.queries()["fulltext_topk"](spark, "/root/testdata/sf0.001").count() > 500


def test_bounds_hold_pairs_back(spark, library):
    """No rank is above its bound, and pairs below the threshold aren't ranked."""
    chunks, _, questions, _ = library
    asked = X.asked_terms(questions)
    postings = X.index(chunks).cache()
    both = X.bounds(asked, postings)
    ranks = X.exact(asked, postings, both).join(both, ["question_id", "chunk_id"])
    assert ranks.where("rank > bound + 1e-9").count() == 0 and ranks.count() > 200
    assert X.search(questions.limit(0), postings).count() == 0 and X.search(questions, postings.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    mids = r.normal(size=(12, 16))
    rows = [(i, (mids[i % 12] + r.normal(size=16) * 0.5).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [1.0] * 3), (2005, [None] + [1.0] * 15), (None, rows[3][1])]
    return spark.createDataFrame(rows, "chunk_id long, b array<double>"), rows


def brute_nearest(rows, queries, k):
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = set()
    for q, a in queries:
        s = sorted(((round(float(a @ v / np.linalg.norm(a) / np.linalg.norm(v)), 6), i) for i, v in fine if i != q), reverse=True)
        out |= {(q, i, x) for x, i in s if len(s) < k or x >= s[k - 1][0]}
    return out


@pytest.mark.parametrize(("cells", "probes", "slice_rows"), [(None, 2, 8192), (12, 1, 20), (1, 1, 8192), (400, 3, 8192)])
def test_nearest_is_exact(spark, vectors, monkeypatch, cells, probes, slice_rows):
    df, rows = vectors
    monkeypatch.setattr(V, "SLICE", slice_rows)
    index = V.build(df, cells)
    asked = [(i, np.array(v)) for i, v in rows[:960] if i % 20 == 0]
    queries = spark.createDataFrame([(i, a.tolist()) for i, a in asked] + [(5000, None), (5001, [1.0]), (None, [1.0] * 16), (5002, [0.0] * 16)], "question_id long, a array<double>")
    got = {tuple(r) for r in V.nearest(queries, index, 10, probes).select("question_id", "chunk_id", "similarity").collect()}
    assert got == brute_nearest(rows, asked, 10)


def test_probes_alone_recall(spark, vectors):
    df, rows = vectors
    index = V.build(df, 24)
    asked = [(i, np.array(v)) for i, v in rows[:900] if i % 20 == 0]
    queries = spark.createDataFrame([(i, a.tolist()) for i, a in asked], "question_id long, a array<double>")
    want = {(q, c) for q, c, _ in brute_nearest(rows, asked, 10)}
    got = {(r[0], r[1]) for r in V.nearest(queries, index, 10, probes=8, exact=False).collect()}
    assert len(want & got) / len(want) >= 0.9
    empty = V.build(df.limit(0))
    assert V.nearest(queries, empty, 10).count() == 0 and V.nearest(queries.limit(0), index, 10).count() == 0


def test_pool_breaks_ties_by_text(spark, vectors):
    df, rows = vectors
    queries = spark.createDataFrame([(1, rows[7][1])], "question_id long, a array<double>")
    index = V.build(df, 12)
    lexical = lambda pairs: pairs.where("chunk_id >= 1040").select("question_id", "chunk_id", (F.col("chunk_id") / 10000).alias("rank"))
    got = [(r.chunk_id, r.lexical > 0) for r in V.hybrid_pool(queries, index, lexical).orderBy("nth").collect()]
    assert got == [(1059 - i, True) for i in range(20)] + [(7, False)] + [(1000 + i, False) for i in range(4)]


# ---- composed retrieval -------------------------------------------------------------------------------------------

COLUMNS = "chunk_id long, text string, source_path string, label string, heading string, repository_url string, standards_scope array<string>, doc_type string, quality_score double, b array<double>"


@pytest.fixture(scope="module")
def evidence(spark):
    r = np.random.default_rng(9)
    words = [f"w{c}{d}" for c in "abcdefghij" for d in "xyz"] + ["alpha", "beta", "gamma", "delta", "late", "journey", "exchange"]
    kinds = ["guide", "schema", "example", "frame", "readme", None]
    rows = []
    for i in range(90):
        kind = kinds[i % 6]
        path = f"examples/file-name-{i % 7}.xml" if kind == "example" else f"schema/part_{i % 5}.xsd" if kind == "schema" else f"docs/page{i % 9}.md"
        b = r.normal(size=8).tolist() if i % 10 else None
        rows.append((i, " ".join(r.choice(words, int(r.integers(3, 60)))), path, str(r.choice(words)), str(r.choice(words)) if i % 2 else None, f"https://x.org/r{i % 4}", ["NeTEx"] if i % 3 else ["SIRI", "NeTEx"] if i % 2 else [], kind, round(0.3 + (i * 7 % 60) / 100, 2), b))
    rows += [(200, None, None, None, None, None, None, None, 0.5, None), (201, rows[3][1], "", "", "", "", [], "guide", 0.8, rows[3][9])]
    asked = [
        (1, "example of alpha in xml file-name-3", None, r.normal(size=8).tolist()), (2, "what is beta and late journey exchange with siri", ["SIRI"], r.normal(size=8).tolist()),
        (3, "wax wby wcz", [], rows[5][9]), (4, None, None, None), (5, "difference between gamma and delta schema part_2", ["NeTEx", "SIRI"], r.normal(size=8).tolist()), (6, "unheard words", ["OpRa"], None),
    ]
    names = [("netex:A", "alpha"), ("netex:B", "beta"), ("netex:G", "gamma"), ("siri:D", "delta"), ("siri:D", "wdx"), ("siri:SIRI", "siri")]
    edges = [("netex:A", "netex:B"), ("netex:B", "netex:A"), ("netex:G", "siri:D"), ("siri:D", "netex:G")]
    return rows, asked, names, edges


def brute_retrieval(spark, evidence, s, sets):
    """Pools, caps and choices of the questions in plain Python; adjustments and graph candidates come from their own operators."""
    rows, asked, names, edges = evidence
    tokens = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    chunks, questions, concepts_of = sets
    alias = {}
    for c, n in names:
        alias.setdefault(c, set()).add(n)
    mentioned = lambda t: {c for c, own in alias.items() if own & set(tokens(t))}
    canonical = {c: max(own, key=lambda n: (len(n), n)) for c, own in alias.items()}
    out, traces = {}, {}
    for q, text, scope, a in asked:
        own = mentioned(text) if s.graph else set()
        wide = own | {t for f, t in edges if f in own} if s.graph else set()
        example_xml = "example" in (text or "") and "xml" in (text or "") and "xsd" not in (text or "")
        wide = set(sorted(wide, key=lambda c: (c not in own, c))[: min(16, s.concepts) if example_xml else s.concepts])
        own &= wide
        fits = lambda r: not scope or bool(set(r[6] or []) & set(scope))
        terms = {w for w in tokens(text) if w not in X.STOP}
        stems = dict(map(tuple, spark.createDataFrame([(w,) for w in {*terms, *(w for r in rows for b in r[1:5] for w in tokens(b))}], "w string").select("w", X.stem("w")).collect()))
        places = lambda r: [(p + 1, stems[w], weight) for p, w, weight in _places(r, tokens)]
        rank = lambda r: brute_rank({stems[w] for w in terms}, places(r)) if terms else 0.0
        cosine = lambda b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if a is not None and b is not None else 0.0
        pool = {}
        if a is not None:
            near = sorted(((-round(cosine(r[9]), 6), -rank(r), r[0]) for r in rows if r[9] is not None and fits(r) and r[0] != q))[: max(25, 5 * s.k)]
            for v, lex, c in near:
                pool[c] = (-v, -lex, False)
        hints = re.findall("file-name-3", text or "")  # names of fewer than eight letters are none
        for c in sorted(r[0] for r in rows if fits(r) and any(h in (r[2] or "").lower() for h in hints))[: max(15, 3 * s.k)]:
            pool.setdefault(c, (None, 0.0, False))
        for c in concepts_of.get(q, []) if s.graph else []:
            pool.setdefault(c, (None, 0.0, True))
        order = {c: i for i, c in enumerate(pool)}
        by = {r[0]: r for r in rows}
        cap = max(12, s.pool)
        kept = set(pool)
        graph = [c for c in pool if pool[c][2]]
        if len(pool) > cap:
            first = set(graph[: s.k * s.multiplier])
            rest = sorted((c for c in pool if c not in first), key=lambda c: (-(pool[c][0] or 0.0), -pool[c][1], -by[c][8], order[c]))
            kept = first | set(rest[: cap - len(first)])
        said = " ".join([text or "", *sorted(canonical[c] for c in wide)])
        candidates = []
        for c in sorted(kept, key=order.get):
            r = by[c]
            if not fits(r):
                continue
            v, lex, _ = pool[c]
            if lex <= 0:
                variants = lambda ts: {X.T.SYNONYMS.get(t, t) for t in ts if len(t) > 2}
                mine, held = variants(tokens(said)), variants(tokens("\n".join(x or "" for x in r[1:5])))
                lex = len(mine & held) / len(mine) if mine else 0.0
            lex, v = min(1.0, lex), max(0.0, min(1.0, v if v is not None else cosine(r[9])))
            held = (mentioned("\n".join(x or "" for x in r[1:5])) if s.graph else set()) - set(X.R.GENERIC_CONCEPTS)
            hit = sorted(held & own) or sorted(held & wide)
            part = 0.0
            if held & own:
                part = 0.26 if "example" in chunks[q, c]["hints"] and (r[2] or "").startswith("examples/") else 0.20
            elif held & wide:
                part = 0.18 if (r[2] or "").startswith("examples/") else 0.10
            raw = max(0.5 * v + 0.3 * lex + 0.2 * r[8], 0.8 * r[8] + 0.2 * lex) + chunks[q, c]["adjusted"] + part
            score = min(1.0, max(0.0, raw))
            if score < s.min_score:
                continue
            value = raw + 0.01 * lex + 0.005 * v
            candidates.append((value * s.penalty if lex > 0.5 and v < 0.35 and not hit else value, score, c, hit))
        candidates.sort(key=lambda x: (-round(x[0], 12), -round(x[1], 12)))
        seen, capped = Counter(), []
        for x in candidates:
            p = by[x[2]][2] or ""
            seen[p] += 1
            if not p or seen[p] <= s.path_cap:
                capped.append(x)
        taken, left, words = [], list(capped), lambda c: set(tokens(" ".join(x or "" for x in (by[c][2], by[c][3], by[c][5]))))
        near = lambda x, y: len(words(x) & words(y)) / len(words(x) | words(y)) if words(x) and words(y) else 0.0
        if not s.diverse or len(left) <= s.k:
            taken = left[: s.k]
        while len(taken) < s.k and len(left) > 0 and s.diverse and len(capped) > s.k:
            values = [s.weight * x[0] - (1 - s.weight) * max((near(x[2], t[2]) for t in taken), default=0.0) for x in left]
            taken.append(left.pop(int(np.argmax(np.round(values, 12)))))
        out[q] = [(c, round(score, 6), hit) for _, score, c, hit in taken]
        traces[q] = (len(pool), len(kept), len(candidates), len(taken), sum(1 for x in taken if x[3]), len(graph))
    return out, traces


def _places(r, tokens):
    at = 0
    for body, (_, weight) in zip(r[1:5], X.FIELDS, strict=True):
        for i, w in enumerate(tokens(body)):
            if w not in X.STOP:
                yield at + i, w, weight
        at += len(tokens(body))


@pytest.mark.parametrize("change", [{}, {"pool": 12, "k": 3, "min_score": 0.2}, {"graph": False, "diverse": False, "path_cap": 1, "min_score": 0.0}])
def test_retrieval(spark, evidence, change):
    from quillon.functions import text as T
    from quillon.operators import candidates as C
    from quillon.operators import composed as Q
    from quillon.operators import retrieval as R

    rows, asked, names, edges = evidence
    s = Q.Settings(**{"min_score": 0.4, **change})
    chunks = spark.createDataFrame(rows, COLUMNS).repartition(3)
    questions = spark.createDataFrame(asked, "question_id long, question string, scope array<string>, a array<double>")
    aliases = spark.createDataFrame(names, "concept_id string, alias string")
    pairs = questions.crossJoin(chunks.drop("b"))  # a fixture of 500 pairs
    hints, kind = T.doc_type_hints("question"), F.when(T.text("doc_type") == "", "guide").otherwise(F.col("doc_type"))
    question, path = F.col("question"), F.col("source_path")
    adjusted = R.doc_type_adjustment(hints, kind) + R.path_adjustment(question, T.path_hints(question), path) + R.path_intent_adjustment(hints, path)
    adjusted = adjusted + R.standard_adjustment(T.standard_hints(question), F.coalesce("standards_scope", F.array().cast("array<string>")), F.col("repository_url"), path) + R.intent_adjustment(question, path, F.col("label"), F.col("text"))
    given = {(r.question_id, r.chunk_id): r.asDict() for r in pairs.select("question_id", "chunk_id", adjusted.alias("adjusted"), hints.alias("hints")).collect()}
    concepts = Q.question_concepts(questions, aliases, spark.createDataFrame(edges, "source string, target string"), s)
    wanted = C.chosen_aliases(questions, concepts.where(~F.col("concept_id").isin(*R.GENERIC_CONCEPTS)), aliases, s.k)
    limits = {r[0]: r[1] for r in questions.select("question_id", Q.graph_limit(question, hints, s)).collect()}
    found = {}
    for r in C.graph_candidates(questions, wanted, chunks, s.k, s.graph_chunks).orderBy("nth").collect():
        if r.nth <= limits[r.question_id]:
            found.setdefault(r.question_id, []).append(r.chunk_id)
    want, traces = brute_retrieval(spark, evidence, s, (given, questions, found))
    postings = X.index(chunks).cache()
    got, told = Q.retrieve(questions, chunks, V.build(chunks.select("chunk_id", "b"), 6), postings, aliases, spark.createDataFrame(edges, "source string, target string"), s)
    mine = {}
    for r in got.orderBy("question_id", "nth").collect():
        mine.setdefault(r.question_id, []).append((r.chunk_id, round(r.score, 6), r.matching))
    assert mine == {q: x for q, x in want.items() if x} and sum(map(len, want.values())) > 10
    for r in told.collect():
        assert (r.candidates, r.candidates_scored, r.candidates_kept, r.chunks, r.graph_evidence_count, r.graph_candidates_added) == traces[r.question_id], r
    assert told.count() == len(asked)


def test_retrieval_without_an_index_of_all_texts(spark, evidence, monkeypatch):
    """The same from the pools' texts, and rows are scored on their way without being kept with texts and vectors."""
    from quillon.operators import composed as Q

    rows, asked, names, edges = evidence
    chunks = spark.createDataFrame(rows, COLUMNS).repartition(3)
    questions = spark.createDataFrame(asked, "question_id long, question string, scope array<string>, a array<double>")
    aliases, links, index = spark.createDataFrame(names, "concept_id string, alias string"), spark.createDataFrame(edges, "source string, target string"), V.build(chunks.select("chunk_id", "b"), 6)
    kept, selected, out = [], Q.selected, []
    monkeypatch.setattr(Q, "selected", lambda rows, s: kept.extend(rows.columns) or selected(rows, s))
    for postings in (X.index(chunks), None):
        got, told = Q.retrieve(questions, chunks, index, postings, aliases, links, Q.Settings(min_score=0.4))
        out.append((sorted((r.question_id, r.nth, r.chunk_id, round(r.score, 9), r.text or "") for r in got.collect()), sorted(map(str, told.collect()))))
    assert out[0] == out[1] and len(out[0][0]) > 10 and any(x[4] for x in out[0][0])
    assert "score" in kept and not {"text", "b", "tokens", "asked_vector"} & set(kept)


def test_mentions_meet_every_alias_that_plain_rules_find(spark):
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(1, 6)))
    texts = {i: " ".join(word() for _ in range(rng.integers(0, 25))) for i in range(60)} | {60: "", 61: None, 62: "abc", 63: "abc, abc! ab"}
    names = [(f"k:{i % 90}", " ".join(word() for _ in range(1 + i % 4))) for i in range(240)] + [("k:1", ""), ("k:2", "ab"), ("k:3", "abc"), ("k:4", "abc"), ("k:4", "abc")]
    want = set()
    for c, t in texts.items():
        body = " ".join(re.findall("[a-z0-9]+", t or ""))
        held = set(body.split())
        for k, a in names:
            p = a.split()
            if a and (len(a) > 2 and a in held if len(p) == 1 else a in body or set(p) <= held):
                want.add((c, k))
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    table = spark.createDataFrame(names, "concept_id string, alias string")
    got = [tuple(r) for r in K.mentions(chunks, table).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert K.mentions(chunks.where("false"), table).count() == 0 and K.mentions(chunks, table.where("false")).count() == 0


def test_vector_search_sends_a_query_once_to_each_region(spark):
    r = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(900)], "chunk_id long, b array<double>")
    index = V.build(rows, 30)
    asked = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("question_id"), F.col("b").alias("a"))
    assert len(index.centroids) == 30 and index.slices.sum() == 1 and V.asked_regions(index, asked, None, 8, 6).count() == 45


def test_hybrid_pool_indexes_texts_of_the_pools_alone(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    r = np.random.default_rng(9)
    words = [f"w{c}{d}" for c in "abcdefg" for d in "xyz"]
    say = lambda n: " ".join(r.choice(words, n))
    tables = {
        "documents": ([(i, say(int(r.integers(1, 60))), "en", f"src{i % 4}", 0) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long"),
        "embeddings": ([(i, r.normal(size=6).round(1).tolist()) for i in range(300)], "vec_id long, embedding array<float>"), "benchmark": ([(1, say(6)), (2, "the")], "item_id long, text string"),
    }
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    indexed, index = [], X.index
    monkeypatch.setattr(X, "index", lambda chunks, terms=None: indexed.append(chunks.count()) or index(chunks, terms))
    got = entry.queries()["hybrid_pool"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(entry.oracle_sql()["hybrid_pool"]).fetchall()) and any(x.lexical > 0 for x in got)
    assert 20 < sum(indexed) < 60

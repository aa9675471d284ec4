"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, embeddings, langid, linededup, mixing, ngramjoin, substrings, tokens, urlfilter, warc
from quillon.llm.shared import components, scratch
from quillon.llm.wavelet import WaveletFile

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANDOM = np.random.default_rng(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def sentence(n):
    return " ".join(RANDOM.choice(VOCABULARY, n))


def changed(text, k):
    words = text.split()
    for i in RANDOM.choice(len(words), k, replace=False):
        words[i] = f"x{RANDOM.integers(1 << 30)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    base, line, passage = sentence(120), "A line that many documents share, word for word.", sentence(60)
    texts = [None, "", " \n\t ", "one two", "ONE two", "one  two", "Über ÜBER naïve", base, base, base.upper().replace("W", "w"), *(changed(base, k) for k in (1, 1, 2, 2, 3, 5, 9, 14, 20))]
    texts += [f"{sentence(30)}\n  {line.upper() if i % 2 else line}  \n{sentence(20)}" for i in range(6)]
    texts += [f"{sentence(15)} {passage} {sentence(15)}" for _ in range(3)] + [f"{passage} {passage}", " ".join(["same"] * 90), sentence(3000), sentence(35), "x" * 5000]
    texts += [f"{line}\n{line}\n{sentence(12)}", sentence(200)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[20], (None, base, "en", "s1", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5), rows


def folded(t, fold=True):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower() if fold else (t or "").encode())


def shingles(t, k=5):
    w = folded(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1), *((100, 200 + i) for i in range(50)), *((300 + i, 301 + i) for i in range(30))]
    got = dict(map(tuple, components(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys((1, 2, 3), 1), **dict.fromkeys((7, 8, 9), 7), 100: 100, **{200 + i: 100 for i in range(50)}, **{300 + i: 300 for i in range(31)}}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("hot", "side"), [(1 << 20, 4096), (1, 2), (1 << 20, 2)])
def test_ngram_join(spark, corpus, hot, side):
    df, rows = corpus
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    linked = [[j for j in range(len(rows)) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(rows))]
    for _ in rows:
        label = [min([label[i], *(label[j] for j in linked[i])]) for i in range(len(rows))]
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[label[i]].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    want = Counter((r[0], len(sets[i]), r[0] if not sets[i] else least[label[i]]) for i, r in enumerate(rows))
    assert Counter(map(tuple, ngramjoin.jaccard_components(spark, df, hot=hot, side=side).collect())) == want


def test_line_dedup(spark, corpus):
    df, rows = corpus
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 40 and r[0] is not None:
                held[key(x)].add(r[0])
    drop = {k: max(v) for k, v in held.items() if len(v) >= 5}
    assert drop
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if key(x) not in drop or drop[key(x)] == r[0]]
        want[r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)] += 1
    clash = df.withColumnsRenamed({"source": "kept", "n_chars": "n_lines"})
    for most in (1000, 0):
        got = linededup.dedup_lines(spark, clash, drop_keys=most).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256", "kept")
        assert Counter(map(tuple, got.collect())) == want
    assert linededup.eligible("é".encode() * 40, 40) and not linededup.eligible("é".encode() * 39, 40)


def test_substrings(spark, corpus):
    df, rows = corpus
    starts = defaultdict(list)
    for i, r in enumerate(rows):
        w = folded(r[1], False)
        for p in range(len(w) - 34):
            starts[tuple(w[p : p + 35])].append((i, p))
    gone = defaultdict(set)
    for places in starts.values():
        if len(places) > 1:
            for i, p in places:
                gone[i].update(range(p, p + 35))
    want = Counter()
    for i, r in enumerate(rows):
        w = folded(r[1], False)
        want[r[0], len(w), len(gone[i]), b" ".join(x for p, x in enumerate(w) if p not in gone[i]).decode()] += 1
    assert Counter(map(tuple, substrings.dedup_substrings(spark, df).collect())) == want


def test_decontamination(spark, corpus):
    df, rows = corpus
    passage = rows[25][1]
    words = passage.split()
    items = [(1, " ".join(words[20:50])), (2, "one TWO"), (3, None), (4, ""), (5, " ".join(words[22:34])), (None, " ".join(words[30:44])), (1, " ".join(words[20:50])), (10, sentence(20)), (7, "über")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    want = Counter()
    for r in rows:
        w, hit, named = split(r[1]), set(), set()
        for name, t in items:
            x = split(t)
            k = min(13, len(x))
            windows = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    named.add(name)
        want[r[0], len(w), len(hit), ",".join(sorted(str(x) for x in named if x is not None)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    clash = df.withColumnsRenamed({"source": "spans", "lang": "items", "n_chars": "row"})
    for part in (clash, clash.withColumnsRenamed({"spans": "digest"}).repartition(2)):
        got = decontaminate.decontaminate(spark, part, bench)
        got = got.select("row.doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated")
        assert Counter(map(tuple, got.collect())) == want
    none = decontaminate.decontaminate(spark, df, bench.where("false"))
    assert none.where("n_hit > 0 OR contaminated").count() == 0 and none.count() == len(rows)


def test_winnowing_keeps_a_print_in_every_window():
    h = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    at = np.concatenate([np.arange(100), 200 + np.arange(200)])
    keep = decontaminate.winnow(h, at, 8)
    for i in range(293):
        if at[i + 7] - at[i] == 7:
            assert keep[i : i + 8].any()


def test_tokens(spark, corpus):
    from tokenizers import Tokenizer

    df, rows = corpus
    extra = [(900, "don't stop… 12,3 naïve—yes <|endoftext|> İstanbul ǅ ﬁ \u00a0x \x1c y e\u0301! WORD%%% it's 'tis", "en", "s", 1), (901, "z" * 300 + " " + "漢字" * 40, "en", "s", 1)]
    df, rows = df.union(spark.createDataFrame(extra, DOCS)), rows + extra
    path = tokens.default_tokenizer()
    t = Tokenizer.from_file(path)
    folder = scratch(spark, "tokens-test")
    manifest = tokens.write_tokens(spark, df, path, 1, folder, shards=4, file_tokens=500)
    assert manifest.count() > 4
    got = sorted(tokens.read_tokens(manifest, tokens.crc).collect(), key=lambda r: r.start)
    want = sorted(((r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows), key=lambda x: (x[0] is not None, x[0], np.array(x[1], "<u2").tobytes()))
    start = 0
    for g, (doc_id, ids) in zip(got, want, strict=True):
        assert tuple(g) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = manifest.orderBy("start").first()
    shard = WaveletFile.open(one.path)
    stream = [x for _, ids in want for x in ids][: shard.n]
    assert [shard.access(i) for i in range(0, shard.n, 11)] == stream[::11] and shard.count(1) == stream.count(1)
    empty = tokens.documents_to_tokens(spark, df.where("false"), path)
    assert empty.count() == 0


def test_token_work_is_by_words_and_memory_is_bounded():
    import cProfile
    from itertools import product

    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    words, marks = ["".join(w) for w in product("aBcDeÉß", repeat=3)], ["".join(m) for m in product("!,.;:-()%", repeat=2)]
    texts = [" ".join(w + m for m in marks) for w in words] + [None, "", " ", "don't", "12 x1 e\u0301\u00a0y\x00 \x1c<|endoftext|> " + "z" * 300, "".join(words), "!" * 100, "\t".join(marks)]
    want = [[*e.ids, 1] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = tokens.Encoder(path, 1)
    encoder.encode(["x"])  # imports what is imported at first use
    with cProfile.Profile() as profile:
        got = encoder.encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want
    assert sum(e.callcount for e in profile.getstats()) < len(words) * len(marks)  # Python calls for fewer than each distinct piece
    small = tokens.Encoder(path, 1, 3, 40)
    for low in range(0, len(texts), 50):
        assert small.encode(texts[low : low + 50]) == got[low : low + 50]
        assert len(small.known_words) <= 40 and len(small.known_pieces) <= 3


def test_whole_text_tokenizers(spark):
    import public_tokenizers

    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 50256)
    assert not encoder.split
    ids = np.frombuffer(encoder.encode(["Hi  there"])[0], encoder.kind)
    assert ids[-1] == 50256 and encoder.tokenizer.decode(ids[:-1].tolist()) == "Hi  there"


def test_warc(spark):
    big, other = "<p>" + "é" * 600, "<p>" + "x" * 1000
    rows = [(i, f"http://h{i % 2}/p\r\n{i}", h) for i, h in enumerate([big, big, other, None, "", "small", "small", big, other + "y"])] + [(7, "http://again", big), (None, None, big), (None, "u", other + "z"), (None, "v", other + "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = scratch(spark, "warc-test")
    manifest = warc.write_warc(spark, df, folder, bundle_bytes=1, frame_bytes=1500)
    got = Counter(map(tuple, warc.read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h] = max(top.get(h, i), i)
    want = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        to = top.get(h) if len(body) >= 1000 and top.get(h) != i else None
        want[i, len(body), hashlib.sha1(body).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert got == want
    fs, base = pafs.FileSystem.from_uri(folder)
    assert len(fs.get_file_info(pafs.FileSelector(base))) == manifest.count() > 1
    assert warc.read_warc(warc.write_warc(spark, df.where("false"), scratch(spark, "warc-test"))).count() == 0


def ranks(edges, seeds, damping, rounds):
    total = Counter()
    for (a, _), n in edges.items():
        total[a] += n
    all_ = sum(seeds.values())
    start = {h: w / all_ for h, w in seeds.items()} if all_ else {}
    r = dict(start)
    for _ in range(rounds):
        new = Counter({h: w * (1 - damping) for h, w in start.items()})
        for (a, b), n in edges.items():
            new[b] += r.get(a, 0) * damping * n / total[a]
        r = new
    return r


def test_url_filters(spark):
    rules = (("good.com", "/", "allow"), ("bad.com", "/", "block"), ("bad.com", "/ok/", "allow"))
    pages = [
        (1, "http://Good.com/a?x", '<a href="http://mid.org/x"><A HREF=\'https://friend.net\'>'), (2, "https://bad.com/x#y", '<a href="/in">'), (3, "http://spam.org/", "<a href=http://bad.com/x><a href=http://bad.com/y>"),
        (4, "http://mid.org?q", '<a href="http://leaf.org/">'), (5, "http://leaf.org/p", None), (6, None, None), (7, "no scheme", ""), (8, "x://www.bad.com/ok/z", ""), (9, "http://friend.net", '<a href="http://spam.org">'), (3, "http://spam.org/", "<a href=http://bad.com/x>"), (10, "http://notbad.com/", ""), (11, "http://mid.org/", "<a href=http://bad.com>"),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, verdict string")
    got = Counter((r.row.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(spark, df, rules).collect())
    parsed, edges, trusted, blocked = [], Counter(), Counter(), Counter()
    for i, url, html in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        parsed.append((i, host, path, rule))
        if rule:
            (trusted if rule[2] == "allow" else blocked)[host] += 1
        if host:
            for to in re.findall(r"(?i)href=[\"']?([a-z]+://[^\"'\s>]+)", html or ""):
                edges[host, re.match(r".*?://([^/?#]*)", to)[1].lower()] += 1
            if inner := len(re.findall(r"(?i)href=[\"']?/(?!/)", html or "")):
                edges[host, host] += inner
    good = ranks(edges, trusted, urlfilter.DAMPING, urlfilter.ROUNDS)
    bad = ranks({(b, a): n for (a, b), n in edges.items()}, blocked, urlfilter.DAMPING, urlfilter.ROUNDS)
    want = Counter((i, h, p, r and r[0] + r[1], r[2] if r else "block" if bad.get(h, 0) > good.get(h, 0) else "allow") for i, h, p, r in parsed)
    assert got == want and any(k[4] == "block" and k[3] is None for k in got)
    assert urlfilter.filter_urls(spark, df.where("false"), rules).count() == 0


def test_mixing(spark, corpus):
    df, rows = corpus
    size = Counter()
    for r in rows:
        size[r[3] or ""] += len(folded(r[1]))
    got = mixing.mix_sources(spark, df, max_repeats=1.6).collect()
    copies = Counter((r.row.doc_id, r.row.text) for r in got)
    rows_of = Counter((r[0], r[1]) for r in rows)
    assert set(copies) == set(rows_of) and all(0 <= r.slot <= 1 for r in got)
    top = max(size.values())
    a = 1 - np.log(1.6) / np.log(top / min(v for v in size.values() if v))
    seen = Counter()
    for r in got:
        seen[r.source] += r.n_tokens
    for s, total in size.items():
        quota = total * (top / total) ** (1 - a)
        longest = max(len(folded(r[1])) for r in rows if (r[3] or "") == s)
        assert quota - 2 * longest - 1 <= seen[s] <= quota + 1, s
    w = {r.source: r.weight for r in got}
    assert abs(sum(w.values()) - 1) < 1e-9
    again = Counter((r.row.doc_id, r.row.text) for r in mixing.mix_sources(spark, df.repartition(2), max_repeats=1.6, most_sources=0).collect())
    assert again == copies
    sums = mixing.sums_of(spark.createDataFrame([(10,), (100,), (1000,)], "total long"))
    e = mixing.exponent(*sums, 0.9, None, None)
    w = np.array([10.0, 100.0, 1000.0]) ** e
    w /= w.sum()
    assert abs(float(-(w * np.log(w)).sum()) - 0.9) < 1e-9
    assert mixing.exponent(*sums, 5.0, None, None) == 0.0 and mixing.exponent(*sums, 0.0, None, None) == 1.0
    assert mixing.mix_sources(spark, df.where("false")).count() == 0
    part = mixing.mix_sources(spark, df, max_repeats=1.0, budget=sum(size.values()) / 2).collect()
    assert sum(r.n_tokens for r in part) <= sum(size.values()) / 2


@pytest.mark.parametrize(("repeats", "budget"), [(2.0, None), (1.3, None), (1.5, 900.0)])
def test_mixing_rows_match_brute_force(spark, corpus, repeats, budget):
    df, _ = corpus
    rows = df.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), mixing.drawn(7).alias("h")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append((r.h, len(folded(r.text)), (r.doc_id, r.text)))
    total = {s: float(sum(n for _, n, _ in v)) for s, v in by.items()}
    low, high = 0.0, 1.0

    def state(a):
        z = sum(t**a for t in total.values() if t)
        w = {s: t**a / z if t else 0.0 for s, t in total.items()}
        return w, budget or max(total[s] / w[s] for s in w if w[s])

    def fits(a):
        w, spend = state(a)
        return max(w[s] * spend / total[s] for s in w if w[s]) <= repeats * (1 + 1e-12)

    for _ in range(60):
        low, high = (low, (low + high) / 2) if fits((low + high) / 2) else ((low + high) / 2, high)
    w, spend = state(0.0 if fits(0.0) else high)
    want = Counter()
    for s, v in by.items():
        each = w[s] * spend / total[s] if total[s] else 1.0
        epochs = int(each + 1e-9)
        rest = int((each - epochs) * total[s] + 1e-6) if total[s] else 0
        order = defaultdict(list)
        for h, n, key in v:
            order[h].append((n, key))
        open_ = rest > 0
        for h in sorted(order):
            rest -= sum(n for n, _ in order[h])
            open_ = open_ and rest >= 0
            for _, key in order[h]:
                want[key] += (max(1, epochs) if budget is None or not total[s] else epochs) + open_
    got = Counter((r.row.doc_id, r.row.text) for r in mixing.mix_sources(spark, df, max_repeats=repeats, budget=budget).collect())
    assert got == +want


def test_language_id(spark):
    def speak(syllables, n):
        return " ".join("".join(RANDOM.choice(syllables, RANDOM.integers(1, 4))) for _ in range(n)).capitalize()

    tongues = {"aa": ["ka", "to", "mi", "ru", "Ñé"], "bb": ["sch", "ung", "ver", "ein", "lich"], "cc": ["tion", "th", "er", "ous", "ly"]}
    rows = [(i, speak(tongues[lang], int(RANDOM.integers(8, 60))), lang) for i in range(300) for lang in [list(tongues)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 + !", None), (1003, "漢字", None), (None, speak(tongues["bb"], 9), "bb"), (1004, speak(tongues["cc"], 20_000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(spark, df.select("doc_id", "text"), df).collect()
    got = {r.row.doc_id: r for r in out}
    test = [r for r in rows if r[0] is not None and r[2] and r[1] and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(test) > 40 and sum(got[r[0]].lang_pred == r[2] for r in test) >= 0.97 * len(test)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in tongues and got[1004].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in out) and len(out) == len(rows)
    silent = langid.identify(spark, df.select("doc_id", "text"), df.where("false")).collect()
    assert {r.lang_pred for r in silent} == {"und"} and {r.score for r in silent} == {0.0}
    flags = dict(map(tuple, df.select("doc_id", langid.held_out("doc_id")).collect()))
    assert all(v == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2) for k, v in flags.items())


def test_embedding_links_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(8)[i % 4] + 0.15 * rng.standard_normal(8)).tolist(), 1) for i in range(150)]
    base = embeddings.classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select(F.col("vec_id").alias("cid"), F.lit(1).cast("long").alias("grp"), "embedding")).cache()
    found = []
    for n in ("1", "5", "90"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, components(spark, embeddings.links(spark, base, 0.93, 2, 8, 1)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and len(found[0]) > 60


def test_embeddings_of_extreme_size(spark):
    rows = [(i, [x * s, 2 * x * s, -x * s], 1) for i, (x, s) in enumerate([(1.0, 1e-200), (3.0, 1e-200), (1.0, 1e200), (1.0, 5e-324), (-1.0, 1.0)])]
    rows += [(9, [1.0, 2.7, -1.0], 1), (10, [1.0, 0.0, 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (4, 0) for i in (0, 1, 2, 3, 9)}, 4: (0, 4), 10: (0, 10)}


@pytest.mark.parametrize(("block", "spreads", "near"), [(2048, 0.05, 64), (8, 0.11, 64), (8, 0.11, 500)])
def test_embeddings(spark, block, spreads, near):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    vectors = np.concatenate([centres[i % 12] + spreads * (1 + i % 3) * rng.standard_normal(16) for i in range(400)]).reshape(400, 16).astype(np.float32)
    rows = [(i, vectors[i].tolist(), int(i % 12) % 4) for i in range(400)]
    rows += [(500, vectors[3].tolist(), 3), (501, (2 * vectors[3]).tolist(), 3), (502, vectors[3].tolist(), None), (503, None, 1), (504, [], 1), (505, [0.0] * 16, 1), (506, [float("nan")] * 16, 1), (507, [None, *vectors[3][1:].tolist()], 3), (3, vectors[3].tolist(), 3), (508, vectors[3][:8].tolist(), 3), (None, vectors[3].tolist(), 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = Counter(map(tuple, embeddings.near_duplicates(spark, df, block=block, near=near).collect()))
    ok = [v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v) and label is not None for _, v, label in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                link[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93
    label = np.arange(n)
    for _ in range(n):
        new = np.minimum(label, np.where(link, label[None, :], n).min(axis=1))
        if (new == label).all():
            break
        label = new
    least = {k: min((rows[i][0] for i in np.flatnonzero(label == k) if rows[i][0] is not None), default=None) for k in set(label.tolist())}
    want = Counter((r[0], int(link[i].sum()), least[label[i]], r[0] is not None and r[0] == least[label[i]]) for i, r in enumerate(rows))
    assert sum((got & want).values()) >= (n if near >= n else 0.97 * n) and link.sum() > 500
    assert embeddings.near_duplicates(spark, df.where("false")).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert ngramjoin.jaccard_components(spark, docs).count() == 0
    assert linededup.dedup_lines(spark, docs).count() == 0
    assert substrings.dedup_substrings(spark, docs).count() == 0
    assert langid.identify(spark, docs.select("doc_id", "text"), docs).count() == 0

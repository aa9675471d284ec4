import zlib
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
from pyspark.sql import functions as F

from quillon.llm import mixing, ngramjoin, tokens


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = np.random.default_rng(2)
    syllables = {"en": ["th", "er", "ing", "on"], "de": ["sch", "ung", "ein", "ver"]}
    speak = lambda lang, n: " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(n))
    secret = speak("en", 30)
    texts = [(speak("en" if i % 3 else "de", 60 + i), "en" if i % 3 else "de", f"s{i % 4 if i < 30 else 0}") for i in range(60)]
    rows = [(i, *t, None) for i, t in enumerate(texts)]
    rows += [(100, texts[5][0], "en", "s1", None), (101, texts[6][0] + " tail", "de", "s2", None), (102, None, "en", "s1", None), (103, "12 34", None, "s1", None), (104, f"{speak('en', 40)} {secret}", "en", "s1", None)]
    rows += [rows[3], rows[3], (None, speak("en", 50), "en", None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, secret)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, names = spark.read.parquet(str(tmp_path / "documents.parquet")), [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_output"]
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "token_output":
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            kept[name] = Counter(r.doc_id for r in docs.collect())
    before = Counter(r[0] for r in rows)
    assert kept["language_id"] == before - Counter([102, 103])
    assert kept["ngram_jaccard_join"] == Counter([*range(60), 104, None])
    assert kept["benchmark_decontamination"] == Counter([*range(60), None])
    assert set(kept["source_mixing"]) == {*range(60), None} and max(kept["source_mixing"].values()) <= 2 < sum(kept["source_mixing"].values()) / 30
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    by = {r[0]: r[1] for r in rows}
    want = Counter()
    for i, n in kept["source_mixing"].items():
        ids = [*t.encode(by[i], add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += n
    got = docs.collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    again = pipeline.run(spark, str(tmp_path))
    assert again.count() == len(got)


def test_keep_one(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (3, "c", 4), (4, "d", 5), (None, "e", 6), (None, "e", 7)], "doc_id long, text string, n long")
    groups = docs.select("doc_id", F.lit(1).alias("n_shingles"), F.when(F.col("doc_id") == 2, 1).otherwise(F.col("doc_id")).alias("component_id"))
    got = Counter(r.doc_id for r in ngramjoin.keep_one(spark, docs, groups).collect())
    assert got == Counter({1: 1, 3: 1, 4: 1, None: 2})
    clash = docs.withColumnsRenamed({"n": "own"}).withColumns({c: F.lit("x") for c in ("n", "_n", "_own", "id", "row", "component_id")})
    kept = ngramjoin.keep_one(spark, clash, groups)
    assert kept.columns == clash.columns and Counter(r.doc_id for r in kept.collect()) == got


def test_mixed_order_follows_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 300 else "b") for i in range(400)], "doc_id long, text string, source string")
    rows = sorted(mixing.mix_sources(spark, docs, max_repeats=2.0).collect(), key=lambda r: r.slot)
    share = sum(r.source == "b" for r in rows) / len(rows)
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        assert abs(sum(r.source == "b" for r in part) / len(part) - share) < 0.08

"""Corpus indexing: profile filters, classification, quality, ids, and the incremental merge by content hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking

# Base quality by document type.
QUALITY = {"frame": 0.88, "object": 0.86, "schema": 0.84, "guide": 0.76, "example": 0.74, "readme": 0.62}


def matches_profile(path: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Any include rule (if there are some) and no exclude rule is part of the path, whatever the case."""
    p = T.lowered(path)
    wanted = T.contains_any(p, [r.lower() for r in include]) if include else F.lit(True)
    return wanted & ~T.contains_any(p, [r.lower() for r in exclude])


def merged_rules(own: Sequence[str], shared: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([*own, *shared]))


def allowed_repositories(df: DataFrame, approved: Sequence[str], column: str = "repository_url") -> DataFrame:
    """Raises for a row of any other repository."""
    told = F.concat(F.lit("repository not allowed: "), T.text(column))
    return df.where(F.when(F.col(column).isin(*approved), True).otherwise(F.raise_error(told).cast("boolean")))


def quality(kind: Column, body: Column, heading: Column, chunk_type: Column, scope: Column, path: Column, words: Column | None = None) -> Column:
    """`words` may give the words of the body, counted once."""
    score = F.lit(0.72)
    for k, v in QUALITY.items():
        score = F.when(kind == k, v).otherwise(score)
    n = T.word_count(body) if words is None else words
    score = score + F.when(n < 20, -0.12).when(n < 60, 0.01).when(n <= 280, 0.06).when(n > 500, -0.04).otherwise(0.0)
    score = score + F.when(T.text(heading) != "", 0.03).otherwise(0.0) + F.when(chunk_type == "heading_section", 0.03).otherwise(0.0)
    score = score + F.when(F.size(scope) > 0, 0.04).otherwise(0.0) - F.when(T.lowered(path).startswith("issues/"), 0.04).otherwise(0.0)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def classified(chunks: DataFrame) -> DataFrame:
    """Chunks (repository_url, source_path, position, chunk_text, chunk_type, heading) with scope, type, quality and id.

    The id is made of the text before XML examples are enriched.
    """
    c = F.col
    out = chunks.withColumn("standards_scope", T.infer_scope(c("source_path"), c("chunk_text"), c("repository_url")))
    out = out.withColumn("doc_type", T.doc_type(c("source_path"), c("chunk_type"), c("heading"), c("chunk_text")))
    out = out.withColumn("chunk_id", T.chunk_id(c("repository_url"), c("source_path"), c("position"), c("chunk_text")))
    out = out.withColumn("n_words_", T.word_count("chunk_text"))
    score = quality(c("doc_type"), c("chunk_text"), c("heading"), c("chunk_type"), c("standards_scope"), c("source_path"), c("n_words_"))
    out = out.withColumn("quality_score", score).drop("n_words_")
    example = c("source_path").endswith(".xml") & (c("doc_type") == "example")
    return out.withColumn("text", F.when(example, T.enriched_xml(c("chunk_text"), c("source_path"))).otherwise(c("chunk_text")))


def content_hash(c: Column | str) -> Column:
    return F.sha1(T.text(c).cast("binary"))


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (repository_url, source_path, content_hash) the manifest doesn't have."""
    return files.join(manifest, ["repository_url", "source_path", "content_hash"], "left_anti")


def upserted(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The snapshot after an upsert; `change` is created, updated or kept."""
    columns = [c for c in existing.columns if c != key]
    old, put = existing.select(key, F.struct(*columns).alias("o")), new.select(key, F.struct(*columns).alias("n"))
    both = old.join(put, key, "full")
    change = F.when(F.col("o").isNull(), "created").when(F.col("n").isNotNull(), "updated").otherwise("kept")
    return both.select(key, change.alias("change"), F.coalesce("n", "o").alias("x")).select(key, "change", "x.*")


def without_stale(existing: DataFrame, seen: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Existing chunks without those of touched files (or of all files) that a run hasn't seen."""
    stale = existing.join(seen, "chunk_id", "left_anti")
    stale = stale if touched is None else stale.join(touched, ["repository_url", "source_path"], "left_semi")
    return existing.join(stale.select("chunk_id"), "chunk_id", "left_anti")


def pruned_manifest(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    return manifest.join(chunks.select("repository_url", "source_path").distinct(), ["repository_url", "source_path"], "left_semi")


def index_corpus(files: DataFrame, manifest: DataFrame, existing: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), incremental: bool = True, prune: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunks, manifest) after a run over files (repository_url, source_path, commit_sha, text).

    A file that the profile leaves out isn't seen; with `prune`, its chunks go.
    """
    kept = files.where(matches_profile(F.col("source_path"), include, exclude)).withColumn("content_hash", content_hash("text"))
    todo = changed(kept, manifest) if incremental else kept
    keyed = todo.withColumn("file", F.struct("repository_url", "source_path", "commit_sha")).withColumn("file_key", F.to_json("file"))
    new = classified(_cut(keyed)).select("chunk_id", "repository_url", "source_path", "commit_sha", "position", "heading", "chunk_type", "doc_type", "standards_scope", "quality_score", "text").dropDuplicates(["chunk_id"])
    fresh = without_stale(existing, new.select("chunk_id"), todo.select("repository_url", "source_path"))
    chunks = upserted(fresh, new)
    if prune:
        chunks = chunks.join(kept.select("repository_url", "source_path").distinct(), ["repository_url", "source_path"], "left_semi")
    own = kept.select("repository_url", "source_path", "content_hash")
    old = manifest.select("repository_url", "source_path", "content_hash").join(own, ["repository_url", "source_path"], "left_anti")
    both = own.unionByName(old)
    return chunks, pruned_manifest(both, chunks) if prune else both


def _cut(files: DataFrame) -> DataFrame:
    """Chunks of files beside repository, path and commit, which travel as a key."""
    with_path = files.withColumn("path", F.col("source_path"))
    cut = chunking.chunks(with_path, "file_key", "path", "text")
    file = F.from_json("file_key", "repository_url string, source_path string, commit_sha string")
    return cut.withColumn("file", file).select("file.*", "position", "chunk_text", "chunk_type", "heading")


def run_metric(files: DataFrame, skipped: DataFrame, chunks: DataFrame, profile: str, mode: str, error: str = "") -> DataFrame:
    """One metrics row of a run."""
    counts = chunks.agg(F.count_if(F.col("change") == "created").alias("created"), F.count_if(F.col("change") == "updated").alias("updated"))
    counts = counts.crossJoin(files.agg(F.count("*").alias("files"))).crossJoin(skipped.agg(F.count("*").alias("skipped")))
    return counts.select(F.lit(profile).alias("profile"), F.lit(mode).alias("mode"), F.lit("failed" if error else "success").alias("status"), "files", "skipped", "created", "updated", F.lit(error).alias("error_message"))


def exportable(chunks: DataFrame, repository: str = "", quality: float = 0.0) -> DataFrame:
    """Chunks of one repository (blank: all) with at least that quality, which is from 0 to 1; null quality passes only 0."""
    if not 0.0 <= quality <= 1.0:
        raise ValueError("quality is from 0 to 1")
    own = chunks.where(F.col("repository_url") == repository.strip()) if repository.strip() else chunks
    return own.where(F.col("quality_score") >= quality) if quality > 0 else own

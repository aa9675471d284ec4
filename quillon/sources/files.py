"""Files: recursive scans, profiles, landed issues, questions, and text or JSON sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T

# Suffixes that are read, and folders that are left out.
SUFFIXES = (".md", ".txt", ".yaml", ".yml", ".xml", ".xsd", ".json")
SKIPPED = (".git", ".venv", "node_modules", "dist", "build")


def source_files(spark: SparkSession, root: str, repository_url: str, commit_sha: str = "unknown", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(repository_url, source_path, commit_sha, text) of files below a folder of any file system; nested checkouts are left out.

    The address may have a scheme or none: paths are relative to it as the file system itself names it. Only files of the
    suffixes, in either case, are opened. Bytes that aren't UTF-8 are dropped.
    """
    base = _qualified(spark, root) + "/"
    either = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(map(either, suffixes)) + "}").load(root)
    files = files.where(F.startswith("path", F.lit(base))).withColumn("source_path", F.substring("path", F.lit(len(base) + 1), F.length("path")))
    parts = F.split("source_path", "/")
    kept = files.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED))))
    for top in nested_checkouts(spark, root):
        kept = kept.where(~F.col("source_path").startswith(_qualified(spark, top).removeprefix(base) + "/"))
    return kept.select(F.lit(repository_url).alias("repository_url"), "source_path", F.lit(commit_sha).alias("commit_sha"), _utf8(F.col("content")).alias("text"))


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as its file system names it, with scheme and host, as Spark's readers give it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def nested_checkouts(spark: SparkSession, root: str) -> list[str]:
    """Folders below a root that hold a .git entry of their own, by listing folders alone (Spark's readers skip hidden names)."""
    jvm, out, todo = spark.sparkContext._jvm, [], [root]
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while todo:
        top = todo.pop()
        entries = list(fs.listStatus(jvm.org.apache.hadoop.fs.Path(top)))
        names = {e.getPath().getName() for e in entries}
        if ".git" in names and top != root:
            out.append(top)
            continue
        todo += [f"{top.rstrip('/')}/{e.getPath().getName()}" for e in entries if e.isDirectory() and e.getPath().getName() not in SKIPPED]
    return out


def _utf8(content: Column) -> Column:
    """Bytes as text without those that aren't UTF-8."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit("")))


def issue_documents(issues: DataFrame, comments: DataFrame, repository_url: str) -> DataFrame:
    """Landed issues (number, title, body, is_pull_request, created_at, updated_at) with comments (number, position, body) as files issues/{n}.md.

    Pull requests and rows without a number are left out.
    """
    said = comments.where(F.trim(T.text("body")) != "").groupBy("number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "body"))), lambda x: x["body"]), "\n\n").alias("said"))
    own = issues.where("number IS NOT NULL AND NOT coalesce(is_pull_request, false)").join(said, "number", "left")
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), T.text("title")), F.when(T.text("body") != "", F.col("body")), F.col("said"))
    return own.select(F.lit(repository_url).alias("repository_url"), F.concat(F.lit("issues/"), F.col("number").cast("string"), F.lit(".md")).alias("source_path"), F.coalesce("updated_at", "created_at", F.lit("issues")).alias("commit_sha"), body.alias("text"))


def load_profile(profiles: dict[str, dict], name: str, shared_exclude: Sequence[str] = ()) -> dict[str, list[str]]:
    """Include and exclude rules of a profile, the shared excludes merged in; an unknown profile is an error."""
    if name not in profiles:
        raise ValueError(f"unknown profile: {name}")
    own = profiles[name]
    return {"include": list(dict.fromkeys(own.get("include", ()))), "exclude": list(dict.fromkeys([*own.get("exclude", ()), *shared_exclude]))}


def benchmark_questions(spark: SparkSession, text: str, ids: Sequence[str] = (), tags: Sequence[str] = ()) -> DataFrame:
    """Questions of a JSON document {"questions": [...]}, filtered by id or tag; min_hits is 1 if absent."""
    schema = "questions array<struct<id: string, question: string, intent: string, tags: array<string>, expected_source_patterns: array<string>, min_hits: int, top_k_threshold: int>>"
    out = spark.range(1).select(F.from_json(F.lit(text), schema).alias("d")).select(F.explode("d.questions").alias("q")).select("q.*")
    out = out.where(F.col("id").isin(*ids)) if ids else out
    out = out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else out
    return out.withColumn("min_hits", F.coalesce("min_hits", F.lit(1)))


def seeded(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """df, or seed rows of its schema where it is empty."""
    return df if not df.isEmpty() else df.sparkSession.createDataFrame(list(rows), df.schema)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(lines: DataFrame, path: str, *order: Column) -> None:
    """One text file for each group: lines (group, line) in order, as parts partitioned by group."""
    body = lines.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("value"))
    body.write.mode("overwrite").partitionBy("group").text(path)


def turtle_stanzas(concepts: DataFrame) -> DataFrame:
    """(group, nth, line) of classes (group, name, label, comment) in Turtle."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(T.text(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"@en'))
    body = F.concat(F.col("group"), F.lit(":"), F.col("name"), F.lit(" a owl:Class ;\n    rdfs:label "), quoted("label"), F.when(T.text("comment") != "", F.concat(F.lit(" ;\n    rdfs:comment "), quoted("comment"))).otherwise(""), F.lit(" ."))
    return concepts.select("group", F.col("name").alias("nth"), body.alias("line"))

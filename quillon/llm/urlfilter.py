"""URL filters: rules first, then link-graph propagation.

A url that a rule fits takes the longest rule's verdict. All other urls take their host's: personalised PageRank runs from
trusted seeds along host edges, and distrust from blocked seeds against them, both as DataFrame joins and sums. Seeds are
weighted by the urls that rules allow or block on a host. A host is blocked where its distrust exceeds `threshold` times
its trust, and allowed otherwise, so hosts that neither reaches are allowed.

Host edges come from the links of a page that name a host (href or src, `//host/...` too), counted by pair of hosts before any
join; all other relative hrefs, empty ones too, are edges of the host to itself. Rank that reaches a host without links ends there.
Steps go on until no further host is reached and the summed change is under TOLERANCE; more than MOST_ROUNDS of them are an error.
Everything is native: no Python code on executors.

Defined results: a null url, or one without `://`, has empty host and path, no rule, and is allowed. A null html has no
links. Repeated rows count as often as they occur. Each input row gives one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import scratch

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 8, 1.0  # ROUNDS: those that the SQL unrolls
TOLERANCE, MOST_ROUNDS = 1e-6, 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) from columns host and html: counted links between hosts."""
    scheme = r"[a-z][a-z0-9+.\-]*:"
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(rf"(?i)\b(?:href|src)\s*=\s*[\"']?\s*((?:{scheme})?//[^\"'\s>]+)"), F.lit(1))
    links = F.transform(links, lambda u: F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u))
    named = rf"(?!\s*(?://|{scheme}))"
    relative = F.regexp_count(F.coalesce("html", F.lit("")), F.lit(rf"(?i)\bhref\s*=\s*+(?:[\"']{named}|(?=[^\s>\"']){named})"))
    pages = pages.where("host <> ''")
    out = pages.select(F.col("host").alias("src"), F.explode(links).alias("url")).select("src", host_of(F.col("url")).alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    inner = pages.groupBy(F.col("host").alias("src")).agg(F.sum(relative).alias("n")).where("n > 0").select("src", F.col("src").alias("dst"), "n")
    return out.unionByName(inner).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(spark: SparkSession, edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) once converged, or an error after `rounds` steps; seeds has host, trusted and blocked weights."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(scratch(spark, "ranks"))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust"), "dst", "src", "n"))
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    steps = both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total") * damping).alias("share")).checkpoint()
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trusted", F.lit("distrust"), "blocked")).alias("kind", "w")).where("w > 0")
    mass = start.groupBy("kind").agg(F.sum("w").alias("all"))
    start = start.join(F.broadcast(mass), "kind").select("kind", "host", (F.col("w") / F.col("all")).alias("r")).checkpoint()
    ranks = start
    for _ in range(rounds):
        moved = ranks.withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("r") * F.col("share")).alias("r"), F.lit(0.0).alias("before"))
        moved = moved.union(start.select("kind", "host", F.col("r") * (1 - damping), F.lit(0.0))).union(ranks.select("kind", "host", F.lit(0.0), "r"))
        ranks = moved.groupBy("kind", "host").agg(F.sum("r").alias("r"), F.sum("before").alias("before")).checkpoint()
        change, fresh = ranks.agg(F.coalesce(F.sum(F.abs(F.col("r") - F.col("before"))), F.lit(0.0)), F.count_if((F.col("before") == 0) & (F.col("r") > 0))).first()
        ranks = ranks.select("kind", "host", "r")
        if change < tolerance and not fresh:
            break
    else:
        raise RuntimeError(f"ranks have not converged after {rounds} rounds")
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(pick("trust"), pick("distrust"))


def filter_urls(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int = MOST_ROUNDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows of pages as struct `row`, with host, path, rule, verdict, and the host's trust and distrust."""
    own = pages.select(F.struct("*").alias("row"), F.col("url").alias("url"))
    own = own.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("m", matched(F.col("host"), F.col("path"), rules))
    count = lambda v: F.count_if(F.col("m.verdict") == v)
    seeds = own.groupBy("host").agg(count("allow").alias("trusted"), count("block").alias("blocked")).where("trusted + blocked > 0")
    ranks = propagate(spark, host_edges(own.select("host", F.col("row.html").alias("html"))), seeds, damping, rounds, tolerance)
    blocked = F.coalesce(F.col("distrust") > threshold * F.col("trust"), F.lit(False))
    judged = own.join(ranks, "host", "left")
    verdict = F.coalesce("m.verdict", F.when(blocked, "block").otherwise("allow"))
    return judged.select("row", "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return filter_urls(spark, pages).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same edges, with ROUNDS rounds unrolled as CTEs in place of convergence."""
    url = r"'^[\s\S]*?://([^/?#]*)([^?#]*)'"
    when = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    verdict = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    scheme, href, quoted = r"[a-z][a-z0-9+.\-]*:", r"(?i)\bhref\s*=\s*", r"(?:[\"'']|[^\s>\"''])"
    steps = [
        f"u AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, {url}, 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, {url}, 2), '') AS path FROM pages)",
        f"r AS (SELECT *, CASE {when} END AS rule FROM u)",
        f"v AS (SELECT *, CASE rule {verdict} END AS said FROM r)",
        f"l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\\b(?:href|src)\\s*=\\s*[\"'']?\\s*((?:{scheme})?//[^\"''\\s>]+)', 1)) AS url FROM u WHERE host <> '')",
        f"o AS (SELECT src, translate(regexp_extract(CASE WHEN starts_with(url, '//') THEN 'http:' || url ELSE url END, {url}, 1), '{_UPPER}', '{_LOWER}') AS dst, 1 AS n FROM l)",
        # hrefs of any kind less those that name a host or another scheme; an unquoted href has a character at least
        f"i AS (SELECT host AS src, host AS dst, len(regexp_extract_all(coalesce(html, ''), '{href}{quoted}')) - len(regexp_extract_all(coalesce(html, ''), '{href}[\"'']?\\s*(?://|{scheme})')) AS n FROM u WHERE host <> '')",
        "e AS (SELECT src, dst, sum(n) AS n FROM (SELECT * FROM o WHERE dst <> '' UNION ALL SELECT * FROM i) GROUP BY ALL HAVING sum(n) > 0)",
        "b AS (SELECT 't' AS kind, src, dst, n FROM e UNION ALL SELECT 'd', dst, src, n FROM e)",
        f"s AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) * {DAMPING} AS share FROM b)",
        "w AS (SELECT 't' AS kind, host, count(*) AS w FROM v WHERE said = 'allow' GROUP BY host UNION ALL SELECT 'd', host, count(*) FROM v WHERE said = 'block' GROUP BY host)",
        "k0 AS (SELECT kind, host, w / sum(w) OVER (PARTITION BY kind) AS r FROM w)",
    ]
    for k in range(ROUNDS):
        steps.append(f"k{k + 1} AS (SELECT kind, host, sum(r) AS r FROM (SELECT k.kind, s.dst AS host, k.r * s.share AS r FROM k{k} k JOIN s ON k.kind = s.kind AND k.host = s.src UNION ALL SELECT kind, host, r * (1 - {DAMPING}) FROM k0) GROUP BY ALL)")
    steps.append(f"h AS (SELECT host, coalesce(sum(r) FILTER (kind = 'd'), 0) > {THRESHOLD} * coalesce(sum(r) FILTER (kind = 't'), 0) AS bad FROM k{ROUNDS} GROUP BY host)")
    return "WITH " + ",\n".join(steps) + "\nSELECT page_id, v.host, path, rule, coalesce(said, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM v LEFT JOIN h ON v.host = h.host"


SQL = _sql()

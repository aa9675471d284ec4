"""Mixing sources to target weights by temperature.

Each source's share p of the tokens becomes a weight p**a, normalised. The exponent a in [0, 1] is bisected over sums of all sources: to the
entropy asked for, or to the largest change for which no source is repeated more often than `max_repeats`. With no budget
given, the budget is the smallest one that uses every document at least once, so nothing is left out.

The weights become whole documents. A source's documents are in a hashed permutation, cut into blocks; its quota is some
full epochs and a part of the next, which ends at the last document that fits. That cut is found block by block: sums over
4096 blocks a source, then over the 4096 parts of the block where the quota ends, and so on, so no task ever sorts a
source. Only (source, hash, tokens) is aggregated; documents themselves are never shuffled: they meet their source's few
numbers in a broadcast of checked size (MOST_SOURCES), or by a join beyond it.

Tokens are words of `[^\\x20\\x09-\\x0D]+`.

Defined results: a null source is the source ''. Documents without tokens, and sources with none, come once in each full epoch, once at
least. Rows alike in doc_id and text share a hash and are taken or left together. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import table

MAX_REPEATS, MOST_SOURCES = 2.0, 200_000
LEVELS, LEVEL_BITS = 5, 12
BITS = LEVELS * LEVEL_BITS
#: Each round tries STEPS - 1 exponents in one aggregation and leaves 1 / STEPS of the range.
ROUNDS, STEPS = 14, 16


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def drawn(seed: int, *salt: Column) -> Column:
    """The document's place in its source's permutation: BITS uniform bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *salt, "doc_id", "text"), 64 - BITS)


def sums_of(totals: DataFrame):
    """(measure, least, most) of a table of sources' totals, as exponent() takes them.

    measure(exponents) gives for each a the sum Z of x**a and the sum of x**a * log(x), where x = total / most: one aggregation over
    the sources for all of them, so their number does not matter.
    """
    least, most = totals.agg(F.min("total"), F.max("total")).first()
    if most is None:
        return None, 0.0, 0.0

    def measure(exponents: list[float]) -> list[tuple[float, float]]:
        log = F.log(F.col("total").cast("double")) - math.log(most)
        row = totals.agg(*(F.sum(x) for a in exponents for x in (F.exp(log * a), F.exp(log * a) * log))).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(exponents))]

    return measure, float(least), float(most)


def entropy(a: float, z: float, s: float) -> float:
    """Entropy of the weights x**a / z, with s the sum of x**a * log(x)."""
    return math.log(z) - a * s / z


def exponent(measure, least: float, most: float, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """Bisects the exponent, STEPS parts at a time. Entropy falls as it grows, and so do repeats; 1 keeps the shares as they are.

    A target that no exponent in [0, 1] meets gives the nearer end. The smallest source is the one most repeated, and the largest
    needs the largest budget.
    """

    def fits(a: float, z: float, s: float) -> bool:
        if target_entropy is not None:
            return entropy(a, z, s) <= target_entropy
        limit = MAX_REPEATS if max_repeats is None else max_repeats
        return (least / most) ** a / z / least * (most * z if budget is None else budget) <= limit * (1 + 1e-12)

    low, high = 0.0, 1.0
    if fits(0.0, *measure([0.0])[0]):
        return 0.0
    for _ in range(ROUNDS):
        tried = [low + (high - low) * i / STEPS for i in range(1, STEPS)]
        ok = [fits(a, *x) for a, x in zip(tried, measure(tried), strict=True)]
        at = ok.index(True) if True in ok else STEPS - 1
        low, high = [low, *tried, high][at : at + 2]
    return high


def plan(spark: SparkSession, narrow: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> DataFrame:
    """(source, total, weight, repeats, epochs, cut): documents whose hash is below cut come once more than epochs."""
    blocks = narrow.groupBy("source", F.shiftrightunsigned("h", BITS - LEVEL_BITS).alias("b")).agg(F.sum("n").alias("n"))
    sources = table(spark, blocks.groupBy("source").agg(F.sum("n").alias("total")), "sources")
    measure, least, most = sums_of(sources.where("total > 0"))
    if not most:
        return sources.select("source", "total", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats"), F.lit(1).cast("long").alias("epochs"), F.lit(0).cast("long").alias("cut"))
    a = exponent(measure, least, most, target_entropy, max_repeats, budget)
    z = measure([a])[0][0]
    spend = most * z if budget is None else float(budget)
    scale = a * math.log(most) + math.log(z)
    weight = F.when(F.col("total") > 0, F.exp(F.log(F.col("total").cast("double")) * a - scale)).otherwise(F.lit(0.0))
    repeats = F.when(F.col("total") > 0, F.col("weight") * spend / F.col("total")).otherwise(F.lit(1.0))
    out = sources.withColumn("weight", weight).withColumn("repeats", repeats)
    out = out.withColumn("epochs", F.floor(F.col("repeats") + 1e-9).cast("long"))
    out = out.withColumn("rest", F.greatest(F.lit(0), F.floor((F.col("repeats") - F.col("epochs")) * F.col("total") + 1e-6)).cast("long"))
    return cuts(spark, narrow, out)


def cuts(spark: SparkSession, narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """Finds where each source's `rest` ends, LEVEL_BITS bits of the hash at a time."""
    known = sources.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("cut"))
    for level in range(1, LEVELS + 1):
        shift = BITS - level * LEVEL_BITS
        inside = narrow.join(known, "source").where(F.shiftrightunsigned("h", shift + LEVEL_BITS) == F.col("cut"))
        sums = inside.groupBy("source", F.shiftrightunsigned("h", shift).alias("b")).agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
        order = Window.partitionBy("source").orderBy("b")  # 4096 rows at most
        sums = sums.withColumn("end", F.sum("n").over(order))
        over = sums.where("end > rest").groupBy("source").agg(F.min(F.struct("b", "end", "n", "rest")).alias("x"))
        known = table(spark, over.select("source", (F.col("x.rest") - F.col("x.end") + F.col("x.n")).alias("rest"), F.col("x.b").alias("cut")), "cuts")
    return sources.drop("rest").join(known.select("source", "cut"), "source", "left").withColumn("cut", F.coalesce("cut", F.lit(0).cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, seed: int = 7, most_sources: int = MOST_SOURCES) -> DataFrame:
    """Rows of docs as struct `row`, once for each copy, with n_tokens, weight (of the source), epoch and slot.

    Ordering by slot (0 to 1) gives a stream in which every stretch has about the target weights.
    """
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    packed = packed.withColumn("n", tokens_of(F.col("text"))).withColumn("h", drawn(seed))
    narrow = table(spark, packed.select("source", "n", "h"), "permuted")
    sources = table(spark, plan(spark, narrow, target_entropy, max_repeats, budget), "mix")
    sources = F.broadcast(sources) if sources.count() <= most_sources else sources
    joined = packed.join(sources, "source")
    least = F.when(F.lit(budget is None) | (F.col("total") == 0), F.greatest(F.col("epochs"), F.lit(1))).otherwise(F.col("epochs"))
    copies = least + F.when((F.col("h") < F.col("cut")), 1).otherwise(0)
    out = joined.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    place = drawn(seed + 1, F.col("epoch")) / F.lit(float(1 << BITS))
    slot = F.least((F.col("epoch") + place) / F.greatest(F.col("repeats"), F.col("copies").cast("double")), F.lit(1.0))
    return out.select("row", "source", F.col("n").alias("n_tokens"), "weight", "epoch", slot.alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(spark, docs).select(F.col("row.doc_id").alias("doc_id"), "source", "n_tokens", "weight", "epoch", "slot")

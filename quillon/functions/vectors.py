"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import retrieval_tokens

DIMENSION = 1536


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, zero and unequally long vectors."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    scale = norm(a) * norm(b)
    return F.when(usable & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def hash_slot(token: Column, dimension: int = DIMENSION) -> Column:
    """Slot of a token: the first two bytes of its SHA-256, modulo the dimension."""
    return (F.conv(F.sha2(token, 256).substr(1, 4), 16, 10).cast("long") % dimension).cast("int")


def hash_weight(token: Column) -> Column:
    """Weight in [-1, 1] of a token: the third byte of its SHA-256."""
    return F.conv(F.sha2(token, 256).substr(5, 2), 16, 10).cast("double") / 127.5 - 1.0


def hash_embedding(df: DataFrame, key: str, body: str, dimension: int = DIMENSION) -> DataFrame:
    """Sparse rows (key, slot, weight) of L2-normalised hash embeddings; texts without tokens have no row."""
    tokens = df.select(key, F.explode(retrieval_tokens(body)).alias("token"))
    sums = tokens.groupBy(key, hash_slot(F.col("token"), dimension).alias("slot")).agg(F.sum(hash_weight(F.col("token"))).alias("w"))
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(norms, key).select(key, "slot", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(F.col("w")).alias("weight"))


def dense_hash_embedding(body: Column, dimension: int = DIMENSION) -> Column:
    """The same as one array, within a row: weights are summed by slot once, then laid out."""
    parts = F.transform(retrieval_tokens(body), lambda t: F.struct(hash_slot(t, dimension).alias("s"), hash_weight(t).alias("w")))
    slots = lambda p: F.array_distinct(F.transform(p, lambda x: x["s"]))
    total = lambda p, i: F.aggregate(F.filter(p, lambda x: x["s"] == i), F.lit(0.0), lambda a, x: a + x["w"])
    # one-element arrays bind what is used for every slot
    summed = F.transform(F.array(parts), lambda p: F.map_from_arrays(slots(p), F.transform(slots(p), lambda i: total(p, i))))
    scaled = F.transform(summed, lambda m: F.struct(m.alias("m"), F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x * x)).alias("n")))
    each = lambda b, i: F.coalesce(b["m"][i], F.lit(0.0)) / F.when(b["n"] > 0, b["n"]).otherwise(1.0)
    return F.transform(scaled, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: each(b, i)))[0]
